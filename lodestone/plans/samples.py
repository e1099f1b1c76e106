"""Named queries: samples projected from audited conversations, their index, and those of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import samples as S
from .registry import query, table

_SQL = """m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CAST(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS part FROM conversations),
a AS (SELECT DISTINCT conv_id, CASE conv_id % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'semantic_review_required' ELSE 'accept' END AS decision FROM m),
t AS (SELECT conv_id, greatest(max(part), 1) AS turns FROM m WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT conv_id, part, turn, '<tool>{"tool_call":"' || CASE length(text) % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'act' ELSE 'look' END || '"}</tool>' || rtrim(text, ' ') AS output, CASE length(text) % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'act' END AS action FROM m WHERE role = 'assistant' AND length(text) <= 900),
s AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'unknown' ELSE 'c' || conv_id % 4 END AS category, decision, CASE WHEN turns > 1 THEN 'multi_turn' ELSE 'single_turn' END AS conversation_type, part, turn, action, output FROM c JOIN a USING (conv_id) JOIN t USING (conv_id)
  WHERE action IS NOT NULL AND (decision = 'accept' OR (decision = 'semantic_review_required' AND conv_id % 2 = 0)))"""


def _hash(case: str, output: str) -> str:
    return f"""sha256('{{"action":"' || action || '","case":' || {case} || ',"external_turn":' || part || ',"iteration":' || turn || ',"output_sha256":"' || sha256({output}) || '"}}')"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    part = F.sum((F.col("role") == "user").cast("long")).over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf, "conversations").withColumns({"text": F.coalesce("text", F.lit("")), "part": part, "case": F.col("conv_id")})
    i, n = F.col("conv_id"), F.length("text")
    decision = F.when(i % 5 == 0, "reject").when(i % 5 == 1, S.REVIEW).otherwise("accept")
    audit, cases = rows.select("case", decision.alias("decision")).distinct(), rows.filter("conv_id % 4 <> 0").select("case", F.concat(F.lit("c"), (i % 4).cast("string")).alias("category")).distinct()
    action = F.when(n % 3 == 0, "plan").when(n % 3 == 1, "act").otherwise("look")
    calls = rows.filter("role = 'assistant'").select("case", F.col("part").alias("external_turn"), F.col("turn").alias("iteration"), F.concat(F.lit('<tool>{"tool_call":"'), action, F.lit('"}</tool>'), "text").alias("output"), (n > 900).alias("overflow"))
    return S.projected(audit, cases, calls, ["accept", S.REVIEW], rows.filter("conv_id % 2 = 0").select("case"))


@query(f"WITH {_SQL} SELECT conv_id AS \"case\", category, decision, conversation_type, part AS external_turn, turn AS iteration, action, sha256(output) AS output_sha256, {_hash('conv_id', 'output')} AS sample_sha256 FROM s")
def sft_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of the conversations that an audit lets through (PIP18)."""
    return _samples(spark, sf).drop("output")


@query(f"WITH {_SQL} SELECT conv_id AS \"case\", category, count(*) AS samples, count(*) FILTER (WHERE action = 'plan') AS plans, count(*) FILTER (WHERE action = 'act') AS acts, list_sort(list(DISTINCT part)) AS turns FROM s GROUP BY ALL")
def sft_case_index(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping sets of samples merged by hash, and indexed by case (PIP19)."""
    samples = _samples(spark, sf)
    return S.case_index(S.merged([samples.filter("iteration % 3 <> 0"), samples]))


@query(f"""WITH {_SQL}, v AS (SELECT CAST(conv_id AS VARCHAR) AS variant, conv_id, 'o' AS kind FROM a UNION ALL SELECT conv_id || '-v1', conv_id, 'e' FROM a WHERE conv_id % 3 = 0),
r AS (SELECT variant, category, part, turn, action, CASE kind WHEN 'o' THEN output ELSE replace(output, 'e', 'é') END AS output FROM v JOIN s USING (conv_id))
SELECT variant AS "case", category, part AS external_turn, turn AS iteration, action, {_hash("'\"' || variant || '\"'", 'output')} AS sample_sha256 FROM r""")
def augmented_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of conversations and of their respelled variants (PIP23, PIP22)."""
    cases = table(spark, sf, "conversations").select("conv_id").distinct()
    name = F.col("conv_id").cast("string")
    variants = cases.select(name.alias("variant"), name.alias("root")).unionByName(cases.filter("conv_id % 3 = 0").select(F.concat(name, F.lit("-v1")).alias("variant"), name.alias("root")))
    out, _ = S.compiled(_samples(spark, sf), variants, F.replace(F.col("output"), F.lit("e"), F.lit("é")))
    return out.select("case", "category", "external_turn", "iteration", "action", "sample_sha256")
