"""Named queries: consultations. A question is an order: its urgency is the priority, its intent the status; the parts it
has much of are matched directly, its suppliers lead to brands over the parts that they ship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consult as C
from ..operators.retrieval import top_k
from .registry import query, table

_SQL = """d AS (SELECT DISTINCT l_orderkey AS q, 'p' || l_partkey AS entity FROM lineitem WHERE l_quantity > 40), i AS (SELECT DISTINCT l_orderkey AS q, 's' || l_suppkey AS entity FROM lineitem),
b AS (SELECT 'p' || p_partkey AS entity, p_brand AS department FROM part),
e AS (SELECT 'p' || p_partkey AS src, p_name AS src_name, 'is of type' AS relation, p_type AS dst_name FROM part UNION ALL SELECT 'p' || p_partkey, p_name, 'has brand', p_brand FROM part UNION ALL SELECT 'p' || p_partkey, p_name, 'has size', CAST(p_size AS VARCHAR) FROM part),
a0 AS (SELECT DISTINCT q, src_name AS matched, relation, dst_name AS related, CASE relation WHEN 'is of type' THEN 20 ELSE 19 END AS score FROM d JOIN e ON entity = src WHERE relation <> 'has size'),
a AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, relation, related, matched) AS rank FROM a0 QUALIFY rank <= 3),
p AS (SELECT src, department, count(*) AS paths FROM (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem) JOIN b ON dst = entity GROUP BY ALL),
m AS (SELECT q, entity, department, 1 AS paths, true AS direct FROM d JOIN b USING (entity) UNION ALL SELECT q, entity, department, paths, false FROM i JOIN p ON entity = src),
g AS (SELECT q, department, CAST(sum(paths) AS BIGINT) AS support, bool_or(direct) AS direct, list_sort(list(DISTINCT entity))[1:3] AS terms FROM m GROUP BY ALL),
dep AS (SELECT q, department, CASE WHEN direct THEN 'direct' ELSE 'two_hop' END AS basis, support, terms, CASE WHEN direct THEN 0.95::DOUBLE ELSE round(least(0.70::DOUBLE, 0.52::DOUBLE + 0.03::DOUBLE * support), 3) END AS confidence, row_number() OVER (PARTITION BY q ORDER BY direct DESC, support DESC, department) AS rank FROM g QUALIFY rank <= 3),
ev AS (SELECT q, entity, row_number() OVER (PARTITION BY q ORDER BY p_retailprice DESC, entity) AS rank FROM d JOIN part ON entity = 'p' || p_partkey WHERE p_size > 25 QUALIFY rank <= 2)"""


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Direct and indirect matches, associations, departments and evidence."""
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    direct = lines.filter("l_quantity > 40").select(F.col("l_orderkey").alias("q"), name("p", "l_partkey").alias("entity")).distinct()
    indirect = lines.select(F.col("l_orderkey").alias("q"), name("s", "l_suppkey").alias("entity")).distinct()
    first = lines.select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"))
    belongs = part.select(name("p", "p_partkey").alias("entity"), F.col("p_brand").alias("department"))
    edge = lambda relation, c: part.select(name("p", "p_partkey").alias("src"), F.col("p_name").alias("src_name"), F.lit(relation).alias("relation"), F.col(c).cast("string").alias("dst_name"))
    edges = edge("is of type", "p_type").unionByName(edge("has brand", "p_brand")).unionByName(edge("has size", "p_size"))
    linked = C.associations(direct, edges, ["type", "brand"])
    term = lambda df: df.withColumn("term", F.col("entity"))
    places = C.departments(term(direct), term(indirect), first, belongs)
    known = part.filter("p_size > 25").select(name("p", "p_partkey").alias("of"), "p_retailprice")
    evidence = top_k(direct.join(known, F.col("entity") == F.col("of")), ["q"], [F.desc("p_retailprice"), F.col("entity")], 2)
    return direct, indirect, linked, places, evidence


@query(f"WITH {_SQL} SELECT q, matched, relation, related, rank FROM a")
def edge_associations(spark: SparkSession, sf: str) -> DataFrame:
    """What the matched parts of each order are linked to, three at most (PIP7)."""
    return _parts(spark, sf)[2].withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_SQL} SELECT * FROM dep")
def department_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The brands that an order's parts and suppliers speak for, direct ones first, three at most (PIP8, JN2, JN3, AGG16)."""
    return _parts(spark, sf)[3].withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_SQL}, n AS (SELECT q, count(DISTINCT entity) AS n FROM (SELECT * FROM d UNION ALL SELECT q, entity FROM i WHERE q % 3 = 0) GROUP BY q),
o AS (SELECT o_orderkey AS q, o_orderpriority = '1-URGENT' AS urgent, o_orderkey % 17 = 0 AS ambiguous, o_totalprice < 20000 AS blocked, CASE o_orderstatus WHEN 'F' THEN 'department_recommendation' WHEN 'P' THEN 'symptom_consultation' ELSE 'overview' END AS intent, coalesce(n, 0) AS n_matches,
  coalesce((SELECT list(entity ORDER BY rank) FROM ev WHERE ev.q = o_orderkey), []) AS evidence, coalesce((SELECT list(related ORDER BY rank) FROM a WHERE a.q = o_orderkey), []) AS associations, coalesce((SELECT list(department ORDER BY rank) FROM dep WHERE dep.q = o_orderkey), []) AS departments FROM orders LEFT JOIN n ON n.q = o_orderkey)
SELECT q, n_matches, evidence, associations, departments, CASE WHEN urgent THEN 'urgent' WHEN ambiguous THEN 'ambiguous' WHEN blocked THEN 'need_more_info' WHEN intent = 'department_recommendation' AND len(departments) > 0 THEN 'ok' WHEN intent IN ('department_recommendation', 'symptom_consultation') THEN 'need_more_info'
WHEN n_matches > 0 AND len(evidence) = 0 AND len(associations) = 0 AND len(departments) = 0 THEN 'evidence_gap' WHEN n_matches = 0 AND len(evidence) = 0 THEN 'not_found' ELSE 'ok' END AS status FROM o""")
def consult(spark: SparkSession, sf: str) -> DataFrame:
    """From each order to its matches, evidence, associations, departments and status, in one plan (PIP2, CLS5)."""
    direct, indirect, linked, places, evidence = _parts(spark, sf)
    intent = F.when(F.col("o_orderstatus") == "F", "department_recommendation").when(F.col("o_orderstatus") == "P", "symptom_consultation").otherwise("overview")
    questions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("q"), "o_orderpriority", "o_totalprice", "o_orderstatus")
    found = {"evidence": (evidence, "entity"), "associations": (linked, "related"), "departments": (places, "department")}
    out = C.answered(questions, direct.unionByName(indirect.filter("q % 3 = 0")), found, F.col("o_orderpriority") == "1-URGENT", F.col("q") % 17 == 0, F.col("o_totalprice") < 20000, intent)
    return out.select("q", "n_matches", "evidence", "associations", "departments", "status")
