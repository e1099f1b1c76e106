"""Traces, sessions and token accounting over event tables (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trace_summary(events: DataFrame, key: str, ts: str, kind: str, ended: list[str], failed: list[str], most: int = 200) -> DataFrame:
    """One row for each trace: first and last time, events, those kept in view, status by its last ending or failing event."""
    status = F.max_by(F.when(F.col(kind).isin(*ended), "done").when(F.col(kind).isin(*failed), "error"), F.when(F.col(kind).isin(*ended, *failed), F.struct(ts, "event_id")))
    return events.groupBy(key).agg(
        F.min(ts).alias("started"), F.max(ts).alias("updated"), F.count(F.lit(1)).alias("n_events"), F.least(F.count(F.lit(1)), F.lit(most)).cast("long").alias("n_kept"), F.coalesce(status, F.lit("running")).alias("status")
    )


def latest(traces: DataFrame, updated: str, key: str, k: int = 100) -> DataFrame:
    """The k traces updated last."""
    return traces.orderBy(F.desc(updated), key).limit(k)


def sliding_text(events: DataFrame, key: str, ts: str, text: str, seconds: int, pattern: str) -> DataFrame:
    """The texts of each key's last seconds joined in order, and whether they match ``pattern``."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    seen = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "event_id", text)).over(w)), lambda x: x[text]), " ")
    return events.withColumn("__at", at).withColumn("window_text", seen).withColumn("hit", F.col("window_text").rlike(pattern)).drop("__at")


def sessions(events: DataFrame, key: str, ts: str, gap: Column) -> DataFrame:
    """Sessions of each key, split where nothing came for longer than ``gap`` (an interval): number, bounds, events."""
    w = W.partitionBy(key).orderBy(ts, "event_id")
    new = F.coalesce((F.col(ts) - F.lag(ts).over(w) >= gap).cast("int"), F.lit(1))
    marked = events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w).cast("long"))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n_events"))


def token_rollup(turns: DataFrame, conv: str, tokens: Column, limit: int = 8192, near: float = 0.9) -> DataFrame:
    """Tokens of each conversation: sum, peak, and where its running context stands to the limit."""
    per = turns.withColumn("__t", tokens).groupBy(conv).agg(F.sum("__t").alias("total_tokens"), F.max("__t").alias("peak_turn_tokens"), F.count(F.lit(1)).alias("n_turns"))
    share = F.round(F.col("total_tokens") / limit, 6)
    return per.withColumns({"utilisation": share, "near_limit": F.col("total_tokens") >= near * limit, "overflow": F.col("total_tokens") > limit})


def shared_prefix(requests: DataFrame, key: str, order: str, tokens: Column) -> DataFrame:
    """Tokens that each request shares at its start with the one before (what a prefix cache could reuse)."""
    w = W.partitionBy(key).orderBy(order)
    rows = requests.withColumn("__t", tokens).withColumn("__p", F.lag("__t").over(w))
    same = F.zip_with(F.slice("__t", 1, F.least(F.size("__t"), F.greatest(F.size("__p"), F.lit(0)))), F.slice("__p", 1, F.least(F.size("__t"), F.size("__p"))), lambda a, b: a == b)
    first_gap = F.array_position(same, False)
    length = F.when(F.col("__p").isNull(), 0).when(first_gap > 0, first_gap - 1).otherwise(F.size(same)).cast("long")
    return rows.withColumns({"n_tokens": F.size("__t").cast("long"), "shared": length}).drop("__t", "__p")


def attributed(turns: DataFrame, key: str, order: str, repairing: Column) -> DataFrame:
    """Each row with ``blamed``: the next row of its key repairs it."""
    w = W.partitionBy(key).orderBy(order)
    return turns.withColumn("blamed", F.coalesce(F.lead(repairing).over(w), F.lit(False)))
