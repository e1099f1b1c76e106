"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. A document's label is its shard. In each round every
group of linked documents weighs the shards that hold its members; members outside the heaviest
shard that still has room ask to move there, and a shard takes requests until its quota (an equal
share of all bytes, less what it holds) is used up. A group larger than a shard thus settles in as
few shards as it needs. Documents without a link cut no edge wherever they are, so they fill the
shards up to the equal share, large ones first, until the sizes are as even as the small ones allow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, written

#: Bytes that a document counts beside its text.
ROW_BYTES = 16


def running_start(df: DataFrame, within: list[str], value: str, order: list[str], out: str, parts: int = 64) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are dealt to hash parts; the sums of the parts (few rows) give where each part begins."""
    keys = [*within, "__part"]
    df = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    begin = sums.select(*[F.col(k).alias(f"{k}__b") for k in keys], F.coalesce(F.sum("__sum").over(W.partitionBy(*within).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__begin"))
    inner = F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"{k}__b"))
    return df.withColumn("__inner", inner).join(begin, cond).withColumn(out, F.col("__begin") + F.col("__inner")).drop("__inner", "__begin", "__part", *[f"{k}__b" for k in keys])


def lookup(values: list[float], at: Column) -> Column:
    """The value of a shard, from a list as long as there are shards."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), at.cast("int") + 1)


def held(df: DataFrame, label: str, n: int) -> list[int]:
    """Bytes by shard: n numbers."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).agg(F.sum("size")).collect()}
    return [int(sizes.get(s) or 0) for s in range(n)]


def propagate(members: DataFrame, n_shards: int, quota: float) -> DataFrame:
    """Label propagation over ``members`` (node, group, size, label): the same rows with their last labels.

    It ends when no request is granted, and not before. Every granted move goes to a shard that holds at least as much
    of the group, so the sum of the squares of what shards hold of groups grows until then. Ties between shards go by
    a hash of group and shard, so no shard is favoured."""
    while True:
        room = [quota - b for b in held(members, "label", n_shards)]
        weights = members.groupBy("group", "label").agg(F.sum("size").alias("weight"), F.max("size").alias("largest"))
        open_ = lookup(room, F.col("label")) >= F.col("largest")
        best = weights.groupBy("group").agg(
            F.max_by(F.col("label"), F.when(open_, F.struct("weight", F.xxhash64("group", "label")))).alias("target"),
            F.max(F.when(open_, F.col("weight"))).alias("target_weight"),
        )
        own = weights.select(F.col("group").alias("g"), F.col("label").alias("l"), F.col("weight").alias("own_weight"))
        best = best.filter(F.col("target").isNotNull()).withColumnRenamed("group", "of")
        plan = own.join(best, F.col("g") == F.col("of")).filter((F.col("l") != F.col("target")) & ((F.col("own_weight") < F.col("target_weight")) | ((F.col("own_weight") == F.col("target_weight")) & (F.xxhash64("g", "l") < F.xxhash64("g", "target"))))).select("g", "l", "target")
        asking = members.join(plan, (F.col("group") == F.col("g")) & (F.col("label") == F.col("l"))).select("node", "target", "size")
        granted = running_start(asking, ["target"], "size", ["node"], "before").filter(F.col("before") + F.col("size") <= lookup(room, F.col("target")))
        granted = granted.select(F.col("node").alias("moved"), F.col("target").alias("new_label"))
        members = written(members.join(granted, F.col("node") == F.col("moved"), "left").select("node", "group", "size", F.coalesce("new_label", "label").alias("label"), F.col("moved").isNotNull().alias("has_moved")), "labels")
        if members.filter("has_moved").isEmpty():
            return members.select("node", "group", "size", "label")


def fill(singles: DataFrame, loads: list[int], n_shards: int) -> DataFrame:
    """``singles`` (node, size) with ``label``: dealt by size class, largest first, each class laid out on a line
    that is cut by what each shard still lacks."""
    classed = singles.withColumn("class", F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    lined = written(running_start(classed, ["class"], "size", ["node"], "before"), "line")
    totals = {r[0]: r[1] for r in lined.groupBy("class").agg(F.sum("size")).collect()}
    loads, label = list(loads), F.lit(0)
    for kind in sorted(totals, reverse=True):
        goal = (sum(loads) + totals[kind]) / n_shards
        lacks = [max(0.0, goal - x) for x in loads]
        scale = totals[kind] / sum(lacks) if sum(lacks) else 0.0
        cuts, at = [], 0.0
        for x in lacks[:-1]:
            at += x * scale
            cuts.append(at)
        cut = F.array(*[F.lit(c) for c in cuts])
        of_kind = F.size(F.filter(cut, lambda c: c <= F.col("before") + F.col("size") / 2))
        got = held(lined.filter(F.col("class") == kind).select("size", of_kind.alias("label")), "label", n_shards)
        loads = [a + b for a, b in zip(loads, got, strict=True)]
        label = F.when(F.col("class") == kind, of_kind).otherwise(label)
    return lined.select("node", "size", label.cast("int").alias("label"))


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard: id, ``size`` (UTF-8 bytes and 16), ``text_crc32``, ``law`` ("bytes": sizes
    near equal), ``shard``, ``slot`` (gapless from 0 in the shard), ``grown_shard`` (null under this law), ``n_equal``
    (documents with this text).

    A null text has no bytes and no link; equal texts, the empty one included, are linked; repeated rows are rows
    of their own with equal texts; a null id is a value like any other. An empty table gives an empty result."""
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        text.isNotNull().alias("linkable"),
    )
    rows = written(base.withColumn("node", F.monotonically_increasing_id()), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.filter("linkable").groupBy("hash", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n_equal"), F.min("node").alias("group")).filter("n_equal > 1")
    groups = groups.withColumnsRenamed({"hash": "h", "text_crc32": "c", "size": "s"})
    same = F.col("linkable") & (F.col("hash") == F.col("h")) & (F.col("text_crc32") == F.col("c")) & (F.col("size") == F.col("s"))
    rows = written(rows.join(groups, same, "left").select("id", "size", "text_crc32", "node", "group", F.coalesce("n_equal", F.lit(1).cast("long")).alias("n_equal")), "linked")
    linked = rows.filter("group IS NOT NULL")
    start = written(linked.select("node", "group", "size", F.pmod(F.xxhash64("node"), F.lit(n_shards)).cast("int").alias("label")), "labels")
    placed = propagate(start, n_shards, total / n_shards)
    filled = fill(rows.filter("group IS NULL").select("node", "size"), held(placed, "label", n_shards), n_shards)
    labels = placed.select("node", "label").unionByName(filled.select("node", "label")).withColumnsRenamed({"node": "n", "label": "shard"})
    out = written(rows.join(labels, F.col("node") == F.col("n")).drop("n", "group"), "shards")
    out = numbered(out, "slot", ["shard"], [], ["id", "node"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_equal")


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: linked documents and those apart from their text's largest part, from ``shard``'s result."""
    by = sharded.filter("n_equal > 1").groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    each = by.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return each.agg(F.sum("n").alias("linked"), F.sum(F.col("n") - F.col("most")).alias("apart"))


def imbalance(sharded: DataFrame) -> float:
    """Largest shard over the mean, in bytes; nan for no rows."""
    sizes = [r[0] for r in sharded.groupBy("shard").agg(F.sum("size")).collect()]
    return max(sizes) * len(sizes) / sum(sizes) if sizes else math.nan
