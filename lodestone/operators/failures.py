"""What went wrong in a turn, which of its calls is to blame, and who has to mend it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How a turn may end, and the code of a contract that asks for a tool that was not used.
TERMINAL, MISSING = ["query", "speak"], "contract:missing:"


def _codes(*parts: Column) -> Column:
    """One list of distinct codes, in the order of the lists given."""
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def _if(condition: Column, code: str) -> Column:
    return F.array(F.when(F.coalesce(condition, F.lit(False)), F.lit(code)))


def _contract(errors: Column) -> Column:
    return F.transform(F.coalesce(errors, F.array().cast("array<string>")), lambda x: F.concat(F.lit("contract:"), x))


def judged_turns(turns: DataFrame, calls: DataFrame, cases: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """``turns`` (``key``, ``case``, ``runtime_error``, ``contract_errors``, ``clean``, ``terminal``) with ``codes``, ``n_calls``,
    ``owner`` and ``outcome``, from their ``calls`` (``key``, ``call``, ``stop``, ``attempts``, ``contract``, ``preferred``).

    ``outcome``: ``unknown_case`` (not among ``cases``), ``workflow_failure``, ``scheduler_only_pass`` (no calls, nothing
    wrong), ``stale_contract`` (a call whose ``contract`` is not ``live``), ``baseline_pass`` or ``baseline_failure``. The
    workflow owns a failure without calls, and one where the last call's state preferred another tool than those the
    contract misses; the model owns all others. A turn's calls are summed up before they are joined."""
    known = calls.join(live.select(F.col("contract").alias("__live")).distinct(), F.col("contract") == F.col("__live"), "left")
    per = known.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("attempts", F.lit(0)) > 0).alias("repaired"), F.bool_or(F.col("stop") == "length").alias("cut"),
        F.bool_and(F.col("__live").isNotNull()).alias("current"), F.max_by(F.coalesce("preferred", F.lit("")), "call").alias("prefers"),
    )
    met = turns.join(per.withColumnsRenamed({k: f"__{k}" for k in key}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left").drop(*[f"__{k}" for k in key])
    met = met.join(cases.select(F.col("case").alias("__case")).distinct(), F.col("case") == F.col("__case"), "left")
    codes = _codes(
        _if(F.col("runtime_error"), "runtime_error"), _contract(F.col("contract_errors")), _if(~F.coalesce(F.col("clean"), F.lit(False)), "invalid_model_envelope"),
        _if(~F.coalesce(F.col("terminal").isin(*TERMINAL), F.lit(False)), "missing_terminal_action"), _if(F.col("repaired"), "required_repair_attempt"), _if(F.col("cut"), "generation_truncated"),
    )
    missing = F.transform(F.filter("codes", lambda x: x.startswith(MISSING)), lambda x: F.substring(x, len(MISSING) + 1, 1 << 20))
    n, wrong = F.coalesce("n", F.lit(0)), F.size("codes") > 0
    upstream = (n == 0) | ((F.size("missing") > 0) & (F.col("prefers") != "") & ~F.array_contains("missing", F.col("prefers")))
    met = met.withColumn("codes", codes).withColumn("missing", missing).withColumn("owner", F.when(wrong, F.when(upstream, "workflow").otherwise("model")))
    outcome = (
        F.when(F.col("__case").isNull(), "unknown_case").when((n == 0) & wrong, "workflow_failure").when(n == 0, "scheduler_only_pass")
        .when(~F.col("current"), "stale_contract").when(~wrong, "baseline_pass").when(F.col("owner") == "workflow", "workflow_failure").otherwise("baseline_failure")
    )
    return met.select(*turns.columns, "codes", n.cast("long").alias("n_calls"), "owner", outcome.alias("outcome"))


def corrections(judged: DataFrame, calls: DataFrame, key: list[str]) -> DataFrame:
    """(``key``, case, call, codes) for each call to be corrected: those to blame for a ``baseline_failure`` of ``judged``.

    A call answers for its own broken envelope (``enveloped`` false) and cut; for a repair that the next call had to make,
    with its ``categories``; and the last one for how the turn ended. If no call is to blame by these, the last one has
    all the turn's codes."""
    failed = judged.filter("outcome = 'baseline_failure'").select(*key, "case", "codes", "runtime_error", "contract_errors", "terminal").withColumnRenamed("codes", "turn_codes")
    w = W.partitionBy(*key).orderBy("call")
    seen = calls.withColumns({"next_attempts": F.lead("attempts").over(w), "next_categories": F.lead("categories").over(w), "last": F.lead("call").over(w).isNull()})
    met = seen.join(failed.withColumnsRenamed({k: f"__{k}" for k in key}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    nothing = F.array().cast("array<string>")
    repair = F.when(F.coalesce("next_attempts", F.lit(0)) > 0, F.concat(F.array(F.lit("caused_repair_attempt")), F.transform(F.coalesce("next_categories", nothing), lambda x: F.concat(F.lit("repair:"), x)))).otherwise(nothing)
    ended = F.when(F.col("last"), F.concat(_if(F.col("runtime_error"), "runtime_error"), _contract(F.col("contract_errors")), _if(~F.coalesce(F.col("terminal").isin(*TERMINAL), F.lit(False)), "missing_terminal_action"))).otherwise(nothing)
    own = _codes(_if(~F.coalesce(F.col("enveloped"), F.lit(False)), "invalid_model_envelope"), _if(F.col("stop") == "length", "generation_truncated"), repair, ended)
    blamed = met.withColumn("own", own).withColumn("any", F.max(F.size("own")).over(W.partitionBy(*key)) > 0)
    codes = F.when(F.col("any"), F.col("own")).when(F.col("last"), F.col("turn_codes")).otherwise(nothing)
    return blamed.select(*key, "case", "call", codes.alias("codes")).filter(F.size("codes") > 0)
