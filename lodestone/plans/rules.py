"""Named queries: coded rules, polarity, gates, decision tables, evidence, and text functions without a query elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import values as V
from ..operators import relational, retrieval
from ..operators.ordering import ranked
from .registry import query, table

#: Small rule tables in the shape of a consultation's, over the words that the tables have.
NEGATION = r"(?:^| )(?:no|not|pas|sin|nicht) "
FLAGS = [("legal", "licen[sc]e|rights reserved"), ("insult", "idiot|moron|stupid"), ("secret", "password|akia"), ("mail", "[a-z]@[a-z]")]
COMBINED = [("number_and_mark", "[0-9]{3}", ["[&][&][&]", "###"]), ("shout_and_list", "!!", ["[|]"])]
TERMS = ["license", "licensed", "rights", "rights reserved", "the", "then", "und", "que", "pas que", "software"]
TOPICS = [("licen|rights", ["Which license is meant?", "Are all rights kept?"]), ("[0-9]{3}", ["Which number is right?"])]
GENERAL = ["Which language is it?", "Where does the text come from?"]

_X = "SELECT doc_id, lower(text) AS x FROM documents"


def _asserted(pattern: str) -> str:
    return f"(regexp_matches(x, '{pattern}') AND NOT regexp_matches(regexp_extract(regexp_extract(x, '(?s)^(.*?)(?:{pattern})', 1), '([^，。！？；,.!?;]*)$', 1), '{NEGATION}'))"


_CODES = ", ".join(
    [f"CASE WHEN {_asserted(p)} THEN '{code}' END" for code, p in FLAGS] + [f"CASE WHEN {_asserted(head)} AND ({' OR '.join(map(_asserted, more))}) THEN '{code}' END" for code, head, more in COMBINED]
)


@query(f"SELECT doc_id, list_slice(list_filter([{_CODES}], lambda c: c IS NOT NULL), 1, 5) AS codes FROM ({_X})")
def coded_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of the rules that a text asserts, negations heeded, with combinations of two (CLS2)."""
    return table(spark, sf, "documents").select("doc_id", R.coded_rules(F.lower("text"), FLAGS, NEGATION, COMBINED).alias("codes"))


_ORDERED = "[" + ", ".join(f"'{t}'" for t in sorted(TERMS, key=lambda t: (-len(t), t))) + "]"
_POLAR = f"""c AS (SELECT doc_id, x, regexp_split_to_array(x, '[，。！？；,.!?;]') AS parts FROM ({_X})),
h AS (SELECT doc_id, x, list_transform(parts, lambda p: regexp_replace(p, '(?s){NEGATION}.*$', '')) AS heads, list_transform(parts, lambda p: regexp_extract(p, '(?s)({NEGATION}.*)$', 1)) AS tails FROM c),
f AS (SELECT doc_id, x, list_filter({_ORDERED}, lambda t: len(list_filter(heads, lambda p: contains(p, t))) > 0) AS a, list_filter({_ORDERED}, lambda t: len(list_filter(tails, lambda p: contains(p, t))) > 0) AS b FROM h),
l AS (SELECT doc_id, x, list_filter(a, lambda t: len(list_filter(a, lambda o: o <> t AND contains(o, t))) = 0) AS a, list_filter(b, lambda t: len(list_filter(b, lambda o: o <> t AND contains(o, t))) = 0) AS negative FROM f),
pol AS (SELECT doc_id, x, list_filter(a, lambda t: NOT list_contains(negative, t)) AS positive, negative FROM l)"""


@query(f"WITH {_POLAR} SELECT doc_id, positive, negative FROM pol")
def term_polarity(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that a text holds asserted and negated, longest first, contained ones left out (CLS3)."""
    return table(spark, sf, "documents").select("doc_id", R.polarity(F.lower("text"), TERMS, NEGATION).alias("p")).select("doc_id", "p.*")


@query(f"SELECT doc_id, regexp_matches(CASE WHEN regexp_matches(x, '(?s): *(.+?) *$') THEN regexp_extract(x, '(?s):\\s*(.+?)\\s*$', 1) ELSE x END, 'licen|grant') AND lang = 'en' AS allowed FROM (SELECT doc_id, lang, lower(text) AS x FROM documents)")
def confirmed_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A gate that wants a cue in the answer behind a mark, and an exact match beside it (CLS4)."""
    return table(spark, sf, "documents").select("doc_id", R.confirmed(F.lower("text"), "licen|grant", F.col("lang") == "en", ":").alias("allowed"))


@query("""SELECT doc_id, CASE WHEN contains(text, '!!') THEN 'urgent' WHEN contains(text, '|') THEN 'ambiguous' WHEN doc_id % 11 = 0 THEN 'need_more_info' WHEN intent = 'department_recommendation' AND k > 2 THEN 'ok'
WHEN intent IN ('department_recommendation', 'symptom_consultation') THEN 'need_more_info' WHEN n > 0 AND k = 0 THEN 'evidence_gap' WHEN n = 0 AND k = 0 THEN 'not_found' ELSE 'ok' END AS status
FROM (SELECT doc_id, text, CASE lang WHEN 'de' THEN 'department_recommendation' WHEN 'fr' THEN 'symptom_consultation' ELSE lang END AS intent, n_chars % 3 AS n, n_chars % 5 AS k FROM documents)""")
def status_table(spark: SparkSession, sf: str) -> DataFrame:
    """Nine ordered branches that name a status (CLS5)."""
    intent = F.when(F.col("lang") == "de", "department_recommendation").when(F.col("lang") == "fr", "symptom_consultation").otherwise(F.col("lang"))
    n, k = F.col("n_chars") % 3, F.col("n_chars") % 5
    status = R.consult_status(F.col("text").contains("!!"), F.col("text").contains("|"), F.col("doc_id") % 11 == 0, intent, n, k, k, F.greatest(k - 2, F.lit(0)))
    return table(spark, sf, "documents").select("doc_id", status.alias("status"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    f"""WITH {_POLAR}, d AS (SELECT doc_id, negative, list_reduce(list_concat([x], negative), lambda t, n: replace(t, n, '')) AS y FROM pol),
q AS (SELECT doc_id, negative, CASE WHEN regexp_matches(y, '{TOPICS[0][0]}') THEN {_sql_list(TOPICS[0][1])} WHEN regexp_matches(y, '{TOPICS[1][0]}') THEN {_sql_list(TOPICS[1][1])} ELSE {_sql_list(GENERAL)} END AS asked FROM d),
r AS (SELECT doc_id, list_filter(asked, lambda a: len(list_filter(negative, lambda n: contains(a, n))) = 0) AS questions FROM q)
SELECT doc_id, CASE WHEN len(questions) > 0 THEN questions ELSE ['What else?'] END AS questions FROM r"""
)
def follow_up_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions by topic, without those about terms that the text denies (CLS6)."""
    rows = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("x")).withColumn("p", R.polarity(F.col("x"), TERMS, NEGATION))
    return rows.select("doc_id", R.follow_up(F.col("x"), TOPICS, GENERAL, F.col("p.negative"), "What else?").alias("questions"))


@query("""WITH a AS (SELECT unnest(['src1', 'src3', 'src5']) AS source, unnest([1, 2, 3]) AS aspect_rank),
f AS (SELECT lang AS subject, d.source AS aspect, n_chars % 100 AS quality, doc_id AS line, left(text, 40) AS answer FROM documents d),
j AS (SELECT subject, aspect, answer, min((aspect_rank, -quality, line)) AS k FROM f JOIN a ON f.aspect = a.source WHERE length(trim(answer)) > 0 GROUP BY subject, aspect, answer),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY k) AS rank FROM j) SELECT subject, aspect, answer, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def fact_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """For each subject asked about the two best facts on the wanted aspects: aspects in order, then quality, then line; equal answers once (PIP5)."""
    aspects = spark.createDataFrame([("src1", 1), ("src3", 2), ("src5", 3)], "aspect string, aspect_rank int")
    facts = table(spark, sf, "documents").select(F.col("lang").alias("subject"), F.col("source").alias("aspect"), (F.col("n_chars") % 100).alias("quality"), F.col("doc_id").alias("line"), F.substring("text", 1, 40).alias("answer"))
    asked = facts.select("subject").distinct()
    return retrieval.fact_evidence(asked, facts, aspects, 2)


@query("""WITH t AS (SELECT conv_id, turn, left(text, 60) AS s FROM conversations), c AS (SELECT conv_id, list(s ORDER BY turn) AS items, list(CAST(turn AS VARCHAR) ORDER BY turn) AS terms FROM t GROUP BY conv_id),
k AS (SELECT *, unnest(range(0, greatest(len(items) - 1, 0) + greatest(len(terms) - 2, 0) + 1)) AS k FROM c),
z AS (SELECT conv_id, k, max(k) OVER (PARTITION BY conv_id) AS last, list_slice(items, 1, len(items) - least(k, greatest(len(items) - 1, 0))) AS items, list_slice(terms, 1, len(terms) - least(greatest(k - greatest(len(items) - 1, 0), 0), greatest(len(terms) - 2, 0))) AS terms FROM k),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS first FROM z WHERE strlen(CAST(json_object('items', items, 'terms', terms) AS VARCHAR)) <= 300 OR k = last)
SELECT conv_id, items, terms FROM y WHERE first = 1""")
def size_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of a conversation and their numbers, cut from the end until their JSON fits 300 bytes (PRJ7)."""
    turns = table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.substring("text", 1, 60).alias("s")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    lists = {"items": (F.transform("t", lambda x: x["s"]), 1), "terms": (F.transform("t", lambda x: x["turn"].cast("string")), 2)}
    return rows.select("conv_id", R.within_budget(lists, 300).alias("r")).select("conv_id", "r.*")


@query(r"""SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[，。！？、；：“”‘’（）《》【】,.!?;:()\s\x27\x22-]+', '', 'g')) = '' AS blank FROM documents""")
def blank_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without anything but punctuation and blanks (PRJ1)."""
    return table(spark, sf, "documents").select("doc_id", (F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[，。！？、；：“”‘’（）《》【】,.!?;:()\s'\"-]+", "")) == "").alias("blank"))


@query("""SELECT doc_id, left(trim(regexp_replace(replace(replace(coalesce(text, ''), 'the ', ''), 'und ', ''), '\\s+', ' ', 'g')), 80) AS core FROM documents""".replace("\\\\", "\\"))
def filler_free(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without filler phrases, at most 80 characters (STR-j)."""
    return table(spark, sf, "documents").select("doc_id", T.strip_fillers("text", ["the ", "und "], 80).alias("core"))


@query(r"""SELECT page_id, trim(regexp_replace(CASE WHEN inner_text <> '' THEN inner_text ELSE trim(html) END, '^```[a-z]*\s*|\s*```$', '', 'g')) AS body FROM (SELECT page_id, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS inner_text FROM pages)""")
def unwrapped(spark: SparkSession, sf: str) -> DataFrame:
    """What stands in an envelope, without a fence (STR-v)."""
    return table(spark, sf, "pages").select("page_id", T.unwrap("html", "title").alias("body"))


@query(r"""WITH s AS (SELECT conv_id, turn, list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '[^。！？.!?;；\n]*[。！？.!?;；]|[^。！？.!?;；\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS s FROM conversations),
c AS (SELECT conv_id, turn, flatten(list_transform(s, lambda x: list_transform(regexp_extract_all(x, '\s*(.{1,80}\z|.{40,80}[，,、 ]|.{80})', 1), lambda y: trim(y)))) AS c FROM s)
SELECT conv_id, turn, list_filter(c, lambda y: y <> '') AS chunks FROM c""")
def speech_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as speech chunks of at most 80 characters (STR-r)."""
    return table(spark, sf, "conversations").select("conv_id", "turn", T.chunk_text("text", 80).alias("chunks"))


@query("""SELECT event_id, ['1', CAST(event_id AS VARCHAR), 't', CAST(json_extract(props, '$.k') AS VARCHAR)] AS found FROM events""")
def values_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """All values under a key of a JSON text, at any depth (JSN2)."""
    body = F.concat(F.lit('{"k":1,"x":[{"k":'), F.col("event_id").cast("string"), F.lit('},{"y":{"k":"t"}}],"z":'), F.col("props"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", V.values_of_key(body, "k").alias("found"))


@query("""SELECT conv_id, len(list_filter(list_distinct(list(role)), lambda r: r NOT IN ('user', 'assistant'))) = 0 AS allowed FROM conversations GROUP BY conv_id""")
def evidence_contained(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose roles are all allowed (JN20)."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return rows.select("conv_id", R.contained(F.col("roles"), F.array(F.lit("user"), F.lit("assistant"))).alias("allowed"))


@query("""SELECT doc_id, list_distinct([x FOR x IN [trim(lang), trim(source), trim(coalesce(left(text, 3), ''))] IF x <> '']) AS tags FROM documents""".replace("list_distinct([x FOR", "list_sort(list_distinct([x FOR").replace("<> '']) AS", "<> ''])) AS"))
def flattened_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Nested lists of texts as one list, each text once (PRJ3)."""
    nested = F.array(F.array("lang", F.concat(F.lit(" "), "source")), F.array("lang", F.substring("text", 1, 3)))
    return table(spark, sf, "documents").select("doc_id", F.sort_array(R.flat_unique(nested)).alias("tags"))


@query("""SELECT doc_id, lang, CASE WHEN trim(left(text, 1)) <> '' THEN left(text, 1) END AS head, CASE WHEN lang IS NULL THEN 0 ELSE 1 END + CASE WHEN trim(left(text, 1)) <> '' THEN 1 ELSE 0 END AS n_fields FROM documents""")
def allowed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields allowed that hold anything (PRJ4)."""
    rows = table(spark, sf, "documents").select("doc_id", R.kept_fields({"lang": F.col("lang"), "head": F.substring("text", 1, 1)}).alias("f"))
    return rows.select("doc_id", F.col("f")["lang"].alias("lang"), F.col("f")["head"].alias("head"), F.size("f").alias("n_fields"))


@query("SELECT doc_id FROM documents WHERE source LIKE '%1'")
def provenance_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose source ends in a mark (FLT9, FLT1)."""
    return table(spark, sf, "documents").filter(F.col("source").endswith("1")).select("doc_id")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 1000) * round(x::DOUBLE * 1000))) / len(embedding)) / 32768, 8) AS rms FROM embeddings""")
def block_loudness(spark: SparkSession, sf: str) -> DataFrame:
    """Root mean square of blocks of 16-bit samples (AGG21)."""
    samples = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000))
    return table(spark, sf, "embeddings").select("vec_id", F.round(R.root_mean_square(samples), 8).alias("rms"))


@query("""SELECT event_id, list_filter([CASE WHEN event_type = 'purchase' AND NOT value > 90 THEN 'completed' END, CASE WHEN value > 80 THEN 'overflow' END, CASE WHEN value > 90 THEN 'error' END], lambda x: x IS NOT NULL) AS sets FROM events""")
def run_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The sets, which may overlap, that a run belongs to (CLS10)."""
    return table(spark, sf, "events").select("event_id", R.run_sets(F.col("event_type") == "purchase", F.col("value") > 80, F.col("value") > 90).alias("sets"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'P0' WHEN quality = 0 OR doc_id % 100 < 10 THEN 'P1' ELSE 'P2' END AS priority FROM labels""")
def review_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows a person looks at first (CLS7)."""
    return table(spark, sf, "labels").select("doc_id", R.review_priority(F.col("toxic") == 1, F.col("quality") == 0, F.col("doc_id") % 100, 10).alias("priority"))


@query("""SELECT min(doc_id) AS doc_id, count(*) AS occurrences, count(DISTINCT source) > 1 AS conflict FROM documents GROUP BY text""")
def dedup_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Equal texts once, told apart by whether their sources agree (PIP13)."""
    docs = table(spark, sf, "documents")
    return relational.exact_dedup_or_conflict(docs, F.sha2("text", 256), F.col("source"), "doc_id")


@query("""WITH r AS (SELECT doc_id, lang, source, sha256('bank:' || doc_id) AS h, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('bank:' || doc_id), doc_id) AS k FROM documents),
f AS (SELECT doc_id, lang, source, false AS refill FROM r WHERE k <= 2),
s AS (SELECT doc_id, lang, source, true AS refill, row_number() OVER (ORDER BY h, doc_id) AS n FROM r WHERE k > 2)
SELECT * FROM f UNION ALL SELECT doc_id, lang, source, refill FROM s WHERE n <= 180 - (SELECT count(*) FROM f)""")
def balanced_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Two documents of each language and source, refilled by hash to 180 (PIP16, PIP15)."""
    return relational.quota_bank(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "bank", 2, 180)


@query("""SELECT conv_id, turn, role, CAST(row_number() OVER (ORDER BY conv_id, turn, sha256(coalesce(text, ''))) AS BIGINT) AS place FROM conversations""")
def canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places of all rows in a total order of keys and content hash (SRT2, WIN8), by ranges of that order."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    numbered = ranked(rows, [F.col("conv_id"), F.col("turn"), F.col("h")], "rank")
    return numbered.select("conv_id", "turn", "role", (F.col("rank") + 1).alias("place"))
