"""Graph and relational operators: bounded hops, keyed joins, checks of cover, keyed dedup, quotas, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .ordering import ranked

# --- graph -------------------------------------------------------------------------------------------------------


def one_hop(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None, relations: list[str] | None = None) -> DataFrame:
    """Edges (src_id, dst_id, relation) with the names of both ends, of the given sources (id) and relations."""
    if relations is not None:
        edges = edges.filter(F.col("relation").isin(*relations))
    if sources is not None:
        edges = edges.join(sources.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    a = nodes.select(F.col("id").alias("src_id"), F.col("name").alias("src_name"))
    b = nodes.select(F.col("id").alias("dst_id"), F.col("name").alias("dst_name"))
    return edges.join(a, "src_id").join(b, "dst_id").select("src_id", "src_name", "relation", "dst_id", "dst_name")


def two_hop(first: DataFrame, second: DataFrame, both_ways: bool = True) -> DataFrame:
    """Paths (start, middle, end) over first (src_id, dst_id), in either direction if ``both_ways``, then second."""
    steps = first.select(F.col("src_id").alias("start"), F.col("dst_id").alias("middle"))
    if both_ways:
        steps = steps.unionByName(first.select(F.col("dst_id").alias("start"), F.col("src_id").alias("middle")))
    return steps.distinct().join(second.select(F.col("src_id").alias("middle"), F.col("dst_id").alias("end")).distinct(), "middle").select("start", "middle", "end")


def support(paths: DataFrame, base: float = 0.52, step: float = 0.03, cap: float = 0.70) -> DataFrame:
    """End nodes by start: paths that support them and the confidence that grows with these."""
    counted = paths.groupBy("start", "end").agg(F.count(F.lit(1)).alias("support"))
    return counted.withColumn("confidence", F.round(F.least(F.lit(cap), base + step * F.col("support")), 6))


# --- keyed joins -------------------------------------------------------------------------------------------------


def joined_or_reason(left: DataFrame, right: DataFrame, key: list[str], reason: str) -> DataFrame:
    """Left join; rows without a partner get ``reason``, others null."""
    mark = right.withColumn("__there", F.lit(True))
    return left.join(mark, key, "left").withColumn("reason", F.when(F.col("__there").isNull(), reason)).drop("__there")


def overridden(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the values that ``changes`` gives; the originals stay as original_<column>."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(new, key, "left")
    return out.select(*[c for c in base.columns if c not in columns], *[F.coalesce(f"__{c}", c).alias(c) for c in columns], *[F.when(F.col(f"__{c}").isNotNull(), F.col(c)).alias(f"original_{c}") for c in columns])


def cover(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids in both, missing in b, unknown to a, repeated in b."""
    left = a.select(key).distinct().withColumn("in_a", F.lit(1))
    right = b.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = left.join(right, key, "full_outer")
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    return both.agg(
        count(F.col("in_a").isNotNull() & F.col("n").isNotNull()).alias("matched"),
        count(F.col("n").isNull()).alias("missing"),
        count(F.col("in_a").isNull()).alias("unknown"),
        count(F.coalesce("n", F.lit(0)) > 1).alias("repeated"),
    )


def require_all(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join on a composite key; fails, naming a few, if keys have no partner."""
    missing = left.join(right, key, "left_anti").select(*key).distinct().limit(5).collect()
    if missing:
        raise ValueError(f"no partner for {[tuple(r) for r in missing]}")
    return left.join(right, key, "left")


def atomic_exclusion(rows: DataFrame, case: str, bad: Column) -> DataFrame:
    """All rows of the cases without a bad row: one bad decision drops its whole case."""
    return rows.join(rows.filter(bad).select(case).distinct(), case, "left_anti")


def best_match(left: DataFrame, right: DataFrame, cond: Column, order: list[Column], key: str) -> DataFrame:
    """For each left row its best right row among those that fulfil ``cond``; the right side is a small dictionary of
    rules or names, joined as such."""
    pairs = left.join(right, cond)
    return pairs.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__rank = 1").drop("__rank")


# --- dedup and order ---------------------------------------------------------------------------------------------


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def merged_sources(sources: list[DataFrame], key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """Rows of several sources, one for each key: the earliest source and place wins, or the latest if ``last``. Keys meet by
    their hash, and each task sends one row of a key."""
    tagged = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    pick = F.max_by if last else F.min_by
    best = pick(F.struct(*union.columns), F.struct("source_rank", *order)).alias("__row")
    return union.groupBy(F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256).alias("__key")).agg(best).select("__row.*")


def namespaced(sources: list[DataFrame], id_col: str) -> DataFrame:
    """The union of the sources with ids ``s<i>-<id>``."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(id_col, F.concat(F.lit(f"s{i}-"), F.col(id_col).cast("string"))) for i, df in enumerate(sources)])


def hash_ranked(df: DataFrame, group: list[str], text: Column, n: int) -> DataFrame:
    """The n rows of each group with the least SHA-256: a sample that is the same in every run."""
    order = W.partitionBy(*group).orderBy(F.sha2(text, 256), text)
    return df.withColumn("hash_rank", F.row_number().over(order).cast("long")).filter(F.col("hash_rank") <= n)


def tail(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The last k rows of each key."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("__n") <= k).drop("__n")


def placed(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the place ``out`` of each row in its group, from 1, by ranges of one total order; no group is in one task."""
    rows = ranked(df, [*map(F.col, group), *map(F.col, order)], "__rank")
    firsts = rows.groupBy(*[F.col(c).alias(f"__of_{c}") for c in group]).agg(F.min("__rank").alias("__first"))
    joined = rows.join(firsts, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group]))
    return joined.select(*df.columns, (F.col("__rank") - F.col("__first") + 1).alias(out))


def round_robin(df: DataFrame, group: str, order: list[str], batch: int) -> DataFrame:
    """Rows interleaved over the groups, cut into batches: adds ``place`` (in the group) and ``batch``.

    Batches follow from each row's place and the group sizes (few rows), so no task orders the whole table or a group."""
    rows = placed(df, [group], order, "place")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).select(F.col(group).alias("__g"), "size")
    levels = F.broadcast(sizes.agg(F.sort_array(F.collect_list(F.struct("__g", "size"))).alias("sizes")))  # one row, an entry for each group
    before = F.expr(f"aggregate(sizes, 0L, (acc, s) -> acc + least(s.size, place - 1) + if(s.__g < {group} AND s.size >= place, 1L, 0L))")
    return rows.join(levels, F.lit(True)).withColumn("batch", F.floor(before / batch)).drop("sizes")


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, weight, quota): total shared by weight; the largest remainders get what rounding left, ties by key.

    One row for each category: a small table."""
    everything = W.partitionBy(F.lit(0))
    exact = F.lit(float(total)) * F.col(weight) / F.sum(weight).over(everything)
    parts = weights.select(key, weight, exact.alias("exact")).withColumn("base", F.floor("exact"))
    left = F.lit(total) - F.sum("base").over(everything)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), key))
    return parts.select(key, weight, (F.col("base") + (rank <= left).cast("long")).cast("long").alias("quota"))


# --- aggregates --------------------------------------------------------------------------------------------------


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, min, p50, p95 (nearest rank), max and mean."""
    return df.groupBy(*(by or [])).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"),
        F.max(value).alias("max"),
        F.round(F.avg(value), 6).alias("mean"),
    )


def duplicate_report(df: DataFrame, key: Column, id_col: str, top: int = 20) -> DataFrame:
    """The largest groups of equal keys: size, least id, and how many groups and rows there are in all."""
    groups = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")
    whole = F.broadcast(groups.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows")))  # one row
    return groups.orderBy(F.desc("n"), "first_id").limit(top).join(whole, F.lit(True)).select("first_id", "n", "n_groups", "n_rows")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def exact_dedup_or_conflict(df: DataFrame, key: Column, value: Column, id_col: str) -> DataFrame:
    """The row of the least id of each key, with ``occurrences`` and ``conflict``: whether rows of the key differ in value."""
    rows = df.withColumns({"__key": key, "__value": value})
    by = rows.groupBy("__key").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("occurrences"), (F.min("__value") != F.max("__value")).alias("conflict"))
    return by.select(id_col, "occurrences", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def quota_bank(df: DataFrame, stratum: list[str], id_col: str, seed: str, each: int, total: int) -> DataFrame:
    """A balanced bank: from every stratum the ``each`` rows of the least hashes, then from all that is left the next by
    hash until there are ``total``; with ``refill``, whether a row came in the second step.

    The second step is a top n of hashes, which tasks prune before they send rows."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), F.col(id_col)]
    place = F.row_number().over(W.partitionBy(*stratum).orderBy(*order))
    # tasks keep the first of each stratum and send no others
    first = written(df.withColumn("__place", place).filter(F.col("__place") <= each).drop("__place"), "bank")
    room = max(total - first.count(), 0)
    taken = first.select(F.col(id_col).alias("__taken"))
    rest = df.join(taken, F.col(id_col) == F.col("__taken"), "left_anti").orderBy(*order).limit(room)
    return first.withColumn("refill", F.lit(False)).unionByName(rest.withColumn("refill", F.lit(True)))
