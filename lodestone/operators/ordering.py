"""A place in a total order for every row, without any task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with the gapless number ``out`` from 0 in ``order``, as a written table.

    Rows are sorted by ranges of that order; a row's number is its place in its range after the rows of all ranges before,
    which are as many numbers as there are ranges. Rows that ``order`` does not tell apart are numbered anyhow."""
    placed = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = written(placed, "ranges")
    ranges = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = ranges.select(F.col("__part").alias("__of"), before.alias("__first"))
    joined = placed.join(F.broadcast(firsts), F.col("__part") == F.col("__of"))
    return joined.select(*df.columns, (F.col("__first") + F.col("__place")).cast("long").alias(out))
