"""Named queries: failures of turns and the calls to correct."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import failures
from .registry import query, table

#: A turn is what a user says; the other side's turns until the next one are its calls. What is known of them is derived
#: from the lengths of their texts.
_SQL = """m AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM conversations),
t AS (SELECT conv_id, part, n % 11 = 0 AS runtime_error, CASE WHEN n % 3 = 0 THEN ['missing:speak'] WHEN n % 5 = 0 THEN ['order', 'order'] ELSE [] END AS contract_errors, n % 4 <> 1 AS clean, CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN 'stop' WHEN 2 THEN 'query' ELSE 'speak' END AS terminal FROM m WHERE role = 'user'),
c AS (SELECT conv_id, part, turn AS call, n % 5 <> 0 AS enveloped, CASE WHEN n % 7 = 0 THEN 'length' ELSE 'end' END AS stop, (n % 6 = 0)::INT AS attempts, CASE WHEN n % 12 = 0 THEN ['schema', 'tool'] ELSE ['schema'] END AS categories, n % 13 AS contract, CASE n % 3 WHEN 0 THEN 'speak' WHEN 1 THEN 'query' ELSE '' END AS preferred,
  lead(n % 6 = 0) OVER w AS next_repair, lead(CASE WHEN n % 12 = 0 THEN ['repair:schema', 'repair:tool'] ELSE ['repair:schema'] END) OVER w AS next_codes, lead(turn) OVER w IS NULL AS final FROM m WHERE role <> 'user' AND part > 0 WINDOW w AS (PARTITION BY conv_id, part ORDER BY turn)),
p AS (SELECT conv_id, part, count(*) AS n_calls, bool_or(attempts > 0) AS repaired, bool_or(stop = 'length') AS cut, bool_and(contract < 12) AS current, arg_max(preferred, call) AS prefers FROM c GROUP BY ALL),
k AS (SELECT t.*, coalesce(n_calls, 0) AS n_calls, current, prefers, list_filter(list_concat([CASE WHEN runtime_error THEN 'runtime_error' END], list_transform(CASE WHEN len(contract_errors) = 2 THEN ['order'] ELSE contract_errors END, lambda x: 'contract:' || x),
  [CASE WHEN NOT clean THEN 'invalid_model_envelope' END, CASE WHEN terminal IS NULL OR terminal NOT IN ('query', 'speak') THEN 'missing_terminal_action' END, CASE WHEN repaired THEN 'required_repair_attempt' END, CASE WHEN cut THEN 'generation_truncated' END]), lambda x: x IS NOT NULL) AS codes FROM t LEFT JOIN p USING (conv_id, part)),
o AS (SELECT *, CASE WHEN len(codes) > 0 THEN CASE WHEN n_calls = 0 OR (list_contains(codes, 'contract:missing:speak') AND prefers = 'query') THEN 'workflow' ELSE 'model' END END AS owner FROM k),
j AS (SELECT *, CASE WHEN conv_id % 8 = 0 THEN 'unknown_case' WHEN n_calls = 0 AND len(codes) > 0 THEN 'workflow_failure' WHEN n_calls = 0 THEN 'scheduler_only_pass' WHEN NOT current THEN 'stale_contract' WHEN len(codes) = 0 THEN 'baseline_pass' WHEN owner = 'workflow' THEN 'workflow_failure' ELSE 'baseline_failure' END AS outcome FROM o)"""


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumns({"n": F.length(F.coalesce("text", F.lit(""))), "part": F.sum((F.col("role") == "user").cast("int")).over(w)})
    n, some = F.col("n"), lambda *x: F.array(*[F.lit(y) for y in x]).cast("array<string>")
    errors = F.when(n % 3 == 0, some("missing:speak")).when(n % 5 == 0, some("order", "order")).otherwise(some())
    terminal = F.when(n % 5 == 0, None).when(n % 5 == 1, "stop").when(n % 5 == 2, "query").otherwise("speak")
    turns = rows.filter("role = 'user'").select("conv_id", "part", F.col("conv_id").alias("case"), (n % 11 == 0).alias("runtime_error"), errors.alias("contract_errors"), (n % 4 != 1).alias("clean"), terminal.alias("terminal"))
    calls = rows.filter("role <> 'user' AND part > 0").select(
        "conv_id", "part", F.col("turn").alias("call"), (n % 5 != 0).alias("enveloped"), F.when(n % 7 == 0, "length").otherwise("end").alias("stop"), (n % 6 == 0).cast("int").alias("attempts"),
        F.when(n % 12 == 0, some("schema", "tool")).otherwise(some("schema")).alias("categories"), (n % 13).alias("contract"), F.when(n % 3 == 0, "speak").when(n % 3 == 1, "query").otherwise("").alias("preferred"),
    )
    cases = rows.filter("conv_id % 8 <> 0").select(F.col("conv_id").alias("case"))
    live = rows.filter("n % 13 < 12").select((n % 13).alias("contract"))
    return turns, calls, failures.judged_turns(turns, calls, cases, live, ["conv_id", "part"])


@query(f"WITH {_SQL} SELECT conv_id, CAST(part AS BIGINT) AS part, codes, n_calls, owner, outcome FROM j")
def turn_failures(spark: SparkSession, sf: str) -> DataFrame:
    """What went wrong in each turn, and whether the workflow or the model has to mend it (CLS8, PIP25)."""
    return _tables(spark, sf)[2].select("conv_id", "part", "codes", "n_calls", "owner", "outcome")


@query(f"""WITH {_SQL}, b AS (SELECT c.conv_id, c.part, call, final, codes, list_distinct([]::VARCHAR[]) AS none, list_filter(list_concat([CASE WHEN NOT enveloped THEN 'invalid_model_envelope' END, CASE WHEN stop = 'length' THEN 'generation_truncated' END], CASE WHEN next_repair THEN list_concat(['caused_repair_attempt'], next_codes) ELSE [] END,
  CASE WHEN final THEN list_concat([CASE WHEN runtime_error THEN 'runtime_error' END], list_transform(CASE WHEN len(contract_errors) = 2 THEN ['order'] ELSE contract_errors END, lambda x: 'contract:' || x), [CASE WHEN terminal IS NULL OR terminal NOT IN ('query', 'speak') THEN 'missing_terminal_action' END]) ELSE [] END), lambda x: x IS NOT NULL) AS own
  FROM c JOIN j ON c.conv_id = j.conv_id AND c.part = j.part WHERE outcome = 'baseline_failure'),
r AS (SELECT *, CASE WHEN max(len(own)) OVER (PARTITION BY conv_id, part) > 0 THEN own WHEN final THEN codes ELSE [] END AS blamed FROM b)
SELECT conv_id, CAST(part AS BIGINT) AS part, call, blamed AS codes FROM r WHERE len(blamed) > 0""")
def calls_to_correct(spark: SparkSession, sf: str) -> DataFrame:
    """The calls to blame for failed turns, each with its own codes (PIP25, JN22)."""
    _, calls, judged = _tables(spark, sf)
    return failures.corrections(judged, calls, ["conv_id", "part"]).select("conv_id", "part", "call", "codes")
