"""Named queries: graph hops, keyed joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import relational as R
from ..operators.ordering import ranked
from .registry import query, table


@query("""SELECT c_custkey AS src_id, c_name AS src_name, 'lives_in' AS relation, n_nationkey AS dst_id, n_name AS dst_name, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def graph_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Customers to their nation (JN1), with the nation's region."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    nodes = c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name")).unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name")))
    edges = c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst_id"), F.lit("lives_in").alias("relation"))
    hops = R.one_hop(edges, nodes, relations=["lives_in"])
    key = F.substring("dst_id", 2, 20).cast("int")
    hops = hops.select(F.substring("src_id", 2, 20).cast("long").alias("src_id"), "src_name", "relation", key.alias("dst_id"), "dst_name")
    return hops.join(n.select(F.col("n_nationkey").alias("dst_id"), "n_regionkey"), "dst_id").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("src_id", "src_name", "relation", "dst_id", "dst_name", F.col("r_name").alias("region"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
q AS (SELECT s, p_brand AS b FROM p JOIN part ON p = p_partkey)
SELECT s AS start, b AS "end", count(*) AS support, round(least(0.70::DOUBLE, 0.52::DOUBLE + 0.03::DOUBLE * count(*)), 6) AS confidence FROM q GROUP BY ALL""")
def graph_two_hop_support(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers to brands over the parts they shipped (JN3): paths counted as support."""
    first = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    second = table(spark, sf, "part").select(F.col("p_partkey").alias("src_id"), F.col("p_brand").alias("dst_id"))
    return R.support(R.two_hop(first, second, both_ways=False))


@query("""SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def exists_not_exists_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders but no urgent one (JN9)."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    some = table(spark, sf, "customer").join(orders, "c_custkey", "left_semi")
    return some.join(orders.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT d.doc_id, source, quality, toxic, CASE WHEN l.doc_id IS NULL THEN 'missing_review' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def label_review_join(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their review, or the reason why there is none (JN6)."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return R.joined_or_reason(docs, table(spark, sf, "labels"), ["doc_id"], "missing_review")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND toxic = 1 THEN 'removed' ELSE lang END AS lang, CASE WHEN l.doc_id IS NOT NULL AND toxic = 1 THEN lang END AS original_lang
FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id""")
def override_join(spark: SparkSession, sf: str) -> DataFrame:
    """Human overrides over stored values, the originals kept (JN11)."""
    changes = table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit("removed").alias("lang"))
    return R.overridden(table(spark, sf, "documents").select("doc_id", "lang"), changes, "doc_id", ["lang"])


@query("""SELECT (SELECT count(*) FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)) AS matched, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing,
(SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unknown, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS repeated""")
def cover_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether reviews cover the documents (JN12)."""
    return R.cover(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with an accepting review (JN7)."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unreviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a review (JN8)."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("""SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def case_atomic_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without any returned line, with all their lines (PIP27)."""
    return R.atomic_exclusion(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R")


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_linenumber) OVER w AS previous, coalesce(l_linenumber <> lag(l_linenumber) OVER w + 1, false) AS gap
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)""")
def sequence_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose number does not follow the one before in its stream (SRC12, STM10)."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    before = F.lag("l_linenumber").over(w)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", before.alias("previous"), F.coalesce(F.col("l_linenumber") != before + 1, F.lit(False)).alias("gap"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY r, id) AS n FROM (SELECT 0 AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark))
SELECT r AS source_rank, id, text FROM s WHERE n = 1""")
def first_wins_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Union of two sources by text, the first wins (WIN1, SET2)."""
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.merged_sources([a, b], ["text"], ["id"]).select("source_rank", "id", "text")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY r DESC, id DESC) AS n FROM (SELECT 0 AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark))
SELECT r AS source_rank, id, text FROM s WHERE n = 1""")
def last_wins_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Union of two sources by text, the last wins (WIN2)."""
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.merged_sources([a, b], ["text"], ["id"], last=True).select("source_rank", "id", "text")


@query("""SELECT 's0-' || item_id AS item_id, text FROM benchmark UNION ALL SELECT 's1-' || doc_id, text FROM documents""")
def namespaced_union(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged union with ids by source (SET6)."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return R.namespaced([table(spark, sf, "benchmark").select("item_id", "text"), docs], "item_id")


@query("SELECT text FROM documents EXCEPT ALL SELECT text FROM benchmark")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of documents less those of the benchmark (SET3)."""
    return table(spark, sf, "documents").select("text").exceptAll(table(spark, sf, "benchmark").select("text"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with customers and suppliers (SET4)."""
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS hash_rank FROM documents) SELECT * FROM r WHERE hash_rank <= 20""")
def stratified_bottom_k(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty documents of each language by hash rank (WIN3, WIN4)."""
    return R.hash_ranked(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], F.col("doc_id").cast("string"), 20)


@query("""SELECT doc_id, text, row_number() OVER (ORDER BY sha256('seed:' || doc_id), doc_id) - 1 AS place FROM documents""")
def hash_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """A shuffle that is the same in every run (SRT3): places by the hash of seed and id, numbered by range without one
    task ordering all."""
    key = F.sha2(F.concat(F.lit("seed:"), F.col("doc_id").cast("string")), 256)
    ranged = table(spark, sf, "documents").select("doc_id", "text", key.alias("key"))
    ranged = ranged.withColumn("part", F.conv(F.substring("key", 1, 2), 16, 10).cast("int"))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 256 rows
    placed = ranged.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("key", "doc_id")))
    return placed.join(before, F.col("part") == F.col("p")).select("doc_id", "text", (F.col("before") + F.col("at") - 1).cast("long").alias("place"))


@query("""WITH w AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, n, 100.0::DOUBLE * n / sum(n) OVER () AS x FROM w),
r AS (SELECT *, floor(x) AS b, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS k FROM e)
SELECT lang, n, CAST(b + CASE WHEN k <= 100 - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def largest_remainder_quota(spark: SparkSession, sf: str) -> DataFrame:
    """A quota of 100 shared by language (MTH6)."""
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return R.largest_remainder(counts, "lang", "n", 100)


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)
SELECT doc_id, source, place, CAST(floor((row_number() OVER (ORDER BY place, source) - 1) / 50) AS BIGINT) AS batch FROM p""")
def round_robin_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of 50 interleaved over the sources (MTH7)."""
    return R.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 50).select("doc_id", "source", "place", F.col("batch").cast("long").alias("batch"))


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""")
def history_tail_k(spark: SparkSession, sf: str) -> DataFrame:
    """The last three turns of each conversation (WIN5)."""
    return R.tail(table(spark, sf, "conversations"), "conv_id", "turn", 3)


@query("""SELECT event_type, count(value) AS n, min(value) AS min, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """min, p50, p95, max, mean by type (AGG9, AGG12)."""
    return R.summary(table(spark, sf, "events"), "value", ["event_type"])


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN r = CAST(ceil(0.95 * n) AS BIGINT) THEN value END) AS nearest, max(CASE WHEN r = CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1 THEN value END) AS rounded,
(SELECT round(quantile_cont(e.value, 0.95), 6) FROM events e WHERE e.event_type = s.event_type) AS linear FROM s GROUP BY event_type""")
def percentile_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Three 95th percentiles: nearest rank, rounded index, interpolated (AGG9-11)."""
    events = table(spark, sf, "events").select("event_type", "value")
    rows = R.placed(events, ["event_type"], ["value"], "r")
    sizes = events.groupBy(F.col("event_type").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(F.broadcast(sizes), F.col("event_type").eqNullSafe(F.col("of")))  # a row for each type
    at = lambda rank: F.max(F.when(F.col("r") == rank, F.col("value")))
    place = (F.col("n") - 1) * 0.95
    below, above, part = at(F.floor(place) + 1), at(F.ceil(place) + 1), F.max(place - F.floor(place))
    linear = F.round(below + part * (above - below), 6)
    return rows.groupBy("event_type").agg(at(F.ceil(0.95 * F.col("n"))).alias("nearest"), at(F.floor(place + 0.5) + 1).alias("rounded"), linear.alias("linear"))


@query("""SELECT event_type, count(*) AS runs, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS slow, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS slow_rate, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP(event_type)""")
def benchmark_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and rates by category and in total (AGG4, AGG5, AGG13, PIP21)."""
    slow = F.sum((F.col("value") > 50).cast("long"))
    return table(spark, sf, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("runs"), slow.alias("slow"), V.rate(slow, F.count(F.lit(1))).alias("slow_rate"), F.countDistinct("user_id").alias("users"))


@query("""WITH g AS (SELECT sha256(coalesce(text, '')) AS k, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT first_id, n, (SELECT count(*) FROM g) AS n_groups, (SELECT CAST(sum(n) AS BIGINT) FROM g) AS n_rows FROM g ORDER BY n DESC, first_id LIMIT 20""")
def duplicate_group_report(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty largest groups of equal texts (AGG17)."""
    return R.duplicate_report(table(spark, sf, "documents"), V.sha(F.col("text")), "doc_id")


@query("""SELECT substr(sha256(coalesce(text, '')), 1, 16) AS signature, min(doc_id) AS first_id, count(*) AS occurrence_count, list_sort(list(DISTINCT source)) AS sources, list_sort(list(doc_id)) AS doc_ids FROM documents GROUP BY 1""")
def exact_dedup_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures with their occurrences (AGG2, AGG18)."""
    key = F.substring(V.sha(F.col("text")), 1, 16).alias("signature")
    return table(spark, sf, "documents").groupBy(key).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("occurrence_count"), F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


@query("""SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS "F", count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS "O", count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS "P", count(*) AS total FROM orders GROUP BY 1""")
def nested_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Category by decision, with the total (AGG4)."""
    orders = table(spark, sf, "orders")
    is_ = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(s)
    return orders.groupBy("o_orderpriority").agg(is_("F"), is_("O"), is_("P"), F.count(F.lit(1)).alias("total"))


@query("""SELECT l_suppkey, count(DISTINCT l_partkey) AS support, bool_or(l_returnflag = 'R') AS any_return, min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS first_return, list_sort(list(DISTINCT l_linestatus)) AS statuses FROM lineitem GROUP BY 1""")
def support_with_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Support, flags and collected terms of each candidate (AGG16)."""
    returned = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("support"), F.bool_or(returned).alias("any_return"), F.min(F.when(returned, F.col("l_shipdate"))).alias("first_return"), F.sort_array(F.collect_set("l_linestatus")).alias("statuses"))


@query("""WITH n AS (SELECT n_nationkey, lower(n_name) AS name FROM nation), p AS (SELECT n_nationkey AS id, name, substr(name, 1, greatest(length(name) - 1, 1)) AS heard FROM n),
m AS (SELECT a.id, a.heard, b.name AS matched, levenshtein(a.heard, b.name) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY levenshtein(a.heard, b.name), b.name) AS k FROM p a JOIN n b ON levenshtein(a.heard, b.name) <= 2)
SELECT id, heard, matched, CAST(distance AS INTEGER) AS distance FROM m WHERE k = 1""")
def levenshtein_match(spark: SparkSession, sf: str) -> DataFrame:
    """Names that were cut short, matched within edit distance 2 (JN19). The names are a dictionary of 25 rows."""
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    heard = names.select("id", F.col("name").substr(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1))).alias("heard"))
    right = names.select(F.col("name").alias("matched"))
    out = R.best_match(heard, right, F.levenshtein("heard", "matched") <= 2, [F.levenshtein("heard", "matched"), F.col("matched")], "id")
    return out.withColumn("distance", F.levenshtein("heard", "matched"))


@query("""SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 64 AS batch, (row_number() OVER (ORDER BY item_id) - 1) % 64 AS place FROM (SELECT doc_id AS item_id FROM documents)""")
def sliced_batches(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in order, in slices of 64: each row's slice and its place there (LIM3)."""
    rows = ranked(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id")), [F.col("item_id")], "rank")
    return rows.select("item_id", F.floor(F.col("rank") / 64).alias("batch"), (F.col("rank") % 64).alias("place"))
