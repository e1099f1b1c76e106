"""Cases for teaching: grounded in rows of several tables, and checked before use in rounds of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import written
from .relational import placed


def grounded(cases: DataFrame, sources: dict[str, DataFrame], allowed: Column, chars: int = 600) -> DataFrame:
    """``cases`` (``source_table``, ``source_row``, ``source_sha256``, ...) with the text they cite, read from ``sources``
    (name to a table of ``row_id``, ``answer``, ``dataset``) and never taken from the case.

    All sources are one table keyed by name and row, met in one join. Adds ``dataset``, ``answer_sha256`` (recomputed),
    ``reference`` (the answer's first ``chars`` characters, as the record keeps it) and ``problem``: ``unknown_table``,
    ``missing_row``, ``hash_mismatch`` (a hash was stored, and is another), ``not_allowed`` (by a condition on
    ``dataset``), else null. A null answer is an empty text; a case without a stored hash takes the recomputed one."""
    parts = [df.select(F.lit(name).alias("__table"), F.col("row_id").cast("long").alias("__row"), F.coalesce("answer", F.lit("")).alias("__answer"), "dataset") for name, df in sources.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    met = cases.join(rows, (F.col("source_table") == F.col("__table")) & (F.col("source_row").cast("long") == F.col("__row")), "left")
    sha = V.sha(F.col("__answer"))
    stored = F.nullif(F.coalesce("source_sha256", F.lit("")), F.lit(""))
    problem = V.first_reason({
        "unknown_table": ~F.coalesce(F.col("source_table").isin(*sources), F.lit(False)),
        "missing_row": F.col("__row").isNull(),
        "hash_mismatch": stored != sha,
        "not_allowed": ~F.coalesce(allowed, F.lit(False)),
    })
    return met.withColumns({"answer_sha256": F.when(F.col("__row").isNotNull(), sha), "reference": F.substring("__answer", 1, chars), "problem": problem}).drop("__table", "__row", "__answer")


UNCLEAR, FINAL = ["need_more_info", "ambiguous"], ["ok", "urgent"]


def preflight(cases: DataFrame, consult: Callable[[DataFrame], DataFrame], most: int = 3) -> DataFrame:
    """(case, decision, reasons, statuses, turns): whether each of ``cases`` (case, ``turns``, ``replies``: texts) can be
    answered as it should be.

    ``consult`` adds ``status``, ``n_questions`` and ``success`` to rows (case, step, query). All given turns are consulted
    at once. A case of one turn that is left unclear then takes its next reply as a further turn, up to ``most`` turns: a
    round for each, with all such cases side by side. A case of one turn must end answered; one of several must ask
    something at first and end answered. Blank replies are left out; null lists are empty, and a case without turns has
    one empty turn."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    given = F.coalesce("turns", F.array().cast("array<string>"))
    given = F.when(F.size(given) == 0, F.array(F.lit(""))).otherwise(given)
    rows = written(cases.select("case", given.alias("turns"), F.transform(F.filter(F.coalesce("replies", F.array().cast("array<string>")), lambda x: ~blank(x)), F.trim).alias("replies")), "cases")
    asked = rows.select("case", F.posexplode("turns").alias("step", "query"))
    checks = written(consult(asked.withColumn("query", F.coalesce("query", F.lit("")))).select("case", "step", "query", "status", "n_questions", "success"), "checks")
    seen = checks
    for step in range(1, most):
        open_ = rows.filter(F.size("turns") == 1).join(checks.filter((F.col("step") == step - 1) & F.col("status").isin(*UNCLEAR)).select("case"), "case", "left_semi")
        more = open_.select("case", F.lit(step).alias("step"), F.get("replies", F.lit(step - 1)).alias("query")).filter("query IS NOT NULL")
        checks = written(consult(more).select("case", "step", "query", "status", "n_questions", "success"), "checks")
        seen = seen.unionByName(checks)
        if checks.isEmpty():
            break
    at = F.struct("step", "query", "status", "n_questions", "success")
    per = seen.groupBy("case").agg(F.array_sort(F.collect_list(at)).alias("c"))
    first, last, n = F.col("c")[0], F.element_at("c", -1), F.size("c")
    reason = lambda name, status: F.concat(F.lit(f"{name}:"), F.coalesce(status, F.lit("None")))
    unanswered = ~F.coalesce(last["status"].isin(*FINAL), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.exists("c", lambda x: ~F.coalesce(x["success"], F.lit(False))), F.lit("TOOL_FAILED")),
        F.when((n == 1) & unanswered, reason("SINGLE_TURN_NOT_ANSWERABLE", first["status"])),
        F.when((n > 1) & ~F.coalesce(first["status"].isin(*UNCLEAR), F.lit(False)), reason("FIRST_TURN_DOES_NOT_REQUEST_FOLLOWUP", first["status"])),
        F.when((n > 1) & (F.coalesce(first["n_questions"], F.lit(0)) == 0), F.lit("FIRST_TURN_HAS_NO_QUESTION")),
        F.when((n > 1) & unanswered, reason("FINAL_TURN_NOT_ANSWERABLE", last["status"])),
    ))
    out = per.select("case", reasons.alias("reasons"), F.transform("c", lambda x: x["status"]).alias("statuses"), F.transform("c", lambda x: x["query"]).alias("turns"))
    return out.withColumn("decision", F.when(F.size("reasons") == 0, "eligible").otherwise("reject"))


def claims_checked(answers: DataFrame, evidence: DataFrame, key: str = "case", turn: str = "turn") -> DataFrame:
    """(case, turn, n_claims, uncited, unseen, accepted) for each of ``answers`` (case, turn, ``claims``: a list of text and
    ``evidence`` ids): how many claims cite nothing, and how many cite what the case had not seen by that turn
    (``evidence``: case, turn, ``evidence_id``). An answer is accepted if it claims something and both are none.

    Evidence is joined by case and id, once for each citation; a null list is empty, and blank ids cite nothing."""
    nothing = F.array().cast("array<string>")
    each = answers.select(F.col(key).alias("c"), F.col(turn).alias("t"), F.posexplode_outer("claims").alias("i", "claim"))
    cited = each.select("c", "t", "i", F.explode_outer(F.filter(F.coalesce("claim.evidence", nothing), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")).alias("id"))
    first = evidence.groupBy(F.col(key).alias("__c"), F.col("evidence_id").alias("__id")).agg(F.min(turn).alias("since"))
    met = cited.join(first, F.col("c").eqNullSafe(F.col("__c")) & (F.col("id") == F.col("__id")), "left")
    seen = F.coalesce(F.col("since") <= F.col("t"), F.lit(False))
    claims = met.groupBy("c", "t", "i").agg(F.count("id").alias("n"), F.bool_and(seen).alias("all_seen"))
    made = F.col("i").isNotNull()
    per = claims.groupBy("c", "t").agg(F.count("i").alias("n_claims"), F.count_if(made & (F.col("n") == 0)).alias("uncited"), F.count_if(made & (F.col("n") > 0) & ~F.col("all_seen")).alias("unseen"))
    fine = (F.col("n_claims") > 0) & (F.col("uncited") == 0) & (F.col("unseen") == 0)
    return per.withColumn("accepted", fine).withColumnsRenamed({"c": key, "t": turn})


def gap_filled(candidates: DataFrame, have: DataFrame, category: str, target: int, order: list[str]) -> DataFrame:
    """The ``candidates`` that fill each category's gap to ``target``, in ``order``: as many as ``have`` (rows of a category)
    lacks. A category without rows lacks them all; a full one takes none."""
    held = have.groupBy(F.col(category).alias("__category")).agg(F.count(F.lit(1)).alias("__have"))
    rows = placed(candidates, [category], order, "__place")
    met = rows.join(held, F.col(category).eqNullSafe(F.col("__category")), "left")
    return met.filter(F.col("__place") <= target - F.coalesce("__have", F.lit(0))).select(*candidates.columns)
