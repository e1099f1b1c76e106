"""Writers: atomic tables, first-wins inserts, accept and reject, resumed work, manifests, text reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import first_wins


def publish(df: DataFrame, path: str) -> None:
    """A new table; Spark's commit makes it visible at once, an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def insert_or_ignore(df: DataFrame, key: list[str], order: list[Column], path: str) -> None:
    """The first row of each key."""
    first_wins(df, key, order).write.mode("errorifexists").parquet(path)


def accept_reject(df: DataFrame, reasons: Column, path: str) -> None:
    """One table, split by decision, each row with its reasons."""
    df.withColumn("reasons", reasons).withColumn("decision", F.when(F.size("reasons") == 0, "accepted").otherwise("rejected")).write.partitionBy("decision").mode("errorifexists").parquet(path)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key has no result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def canonical_lines(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order and nulls kept."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def manifest(spark: SparkSession, df: DataFrame, path: str, **facts: object) -> dict:
    """Writes rows and an order-free checksum of a table, with more facts, as one JSON document; returns it."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.sum(part)).first()
    out = {"rows": n, "checksum": f"{int(total or 0):x}", "columns": df.dtypes, **facts}
    spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return out


def review_packet(df: DataFrame, title: Column, body: Column, path: str) -> None:
    """A markdown section for each row, for human review."""
    df.select(F.concat(F.lit("## "), title, F.lit("\n\n"), body, F.lit("\n")).alias("value")).write.mode("errorifexists").text(path)
