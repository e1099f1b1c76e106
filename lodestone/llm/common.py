"""Shared pieces of the training-data operators: scratch tables, batch slicing, row numbering."""

from __future__ import annotations

import atexit
import uuid
import weakref
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete, shared_dir

#: The contract's words: runs of anything but the ASCII blanks 0x20 and 0x09 to 0x0D.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: The sessions that wrote tables, with their paths; what is known of each table still in use.
_SESSIONS: dict[int, tuple[SparkSession, list[str]]] = {}
_KEPT: weakref.WeakKeyDictionary[DataFrame, Kept] = weakref.WeakKeyDictionary()


@dataclass(frozen=True)
class Kept:
    """What is known of a written table: where it is, its rows, about how many bytes they take in memory, and what was
    summed up over them as they were written."""

    path: str
    rows: int
    size: int
    sums: dict


def written(df: DataFrame, name: str, **sums: Column) -> DataFrame:
    """``df`` as a table written in the shared folder and read again; ``sums`` are aggregates taken on the way.

    It cuts lineage the way ``checkpoint()`` does, but columnar and compressed, and a lost executor costs only the
    reading task, not the work behind the table. Results read these tables as long as they are used, so they
    are deleted when the driver's Python ends (``forget`` deletes one earlier)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        size = size + width(F.col(f"`{f.name}`"), f.dataType)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("size"), *[c.alias(f"_{k}") for k, c in sums.items()]).write.option("compression", "zstd").parquet(path)
    got = seen.get
    _SESSIONS.setdefault(id(spark), (spark, []))[1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _KEPT[out] = Kept(path, got.get("rows") or 0, got.get("size") or 0, {k: got.get(f"_{k}") for k in sums})
    return out


def kept(df: DataFrame) -> Kept:
    """What is known of a table that ``written`` made."""
    return _KEPT[df]


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that no later result reads."""
    for table in tables:
        if known := _KEPT.pop(table, None):
            delete(table.sparkSession, known.path)


def _sweep() -> None:
    for spark, paths in _SESSIONS.values():
        for path in paths:
            delete(spark, path)


atexit.register(_sweep)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch in pieces of about ``most`` bytes of ``column`` (one row at least), with that
    column's values as ``bytes`` (or None)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts.cast(pa.binary()) if not pa.types.is_large_string(texts.type) else texts.cast(pa.large_binary())
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, end - at), texts.slice(at, end - at).to_pylist()
            at = end
        del batch, texts
        pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the fold rule of the held-out rows. Null id: 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def numbered(df: DataFrame, out: str, within: list[str], lead: list[Column], order: list[str], parts: int = 256) -> DataFrame:
    """Adds the gapless number ``out`` from 0 in each group ``within``, in the order of ``lead``.

    Rows are dealt to ``parts`` hash parts; the counts of the parts (few rows) give each
    part's first number, so no group is ever in one task. Equal rows get neighbouring numbers."""
    lead_names = [f"__lead{i}" for i in range(len(lead))]
    df = df.withColumns({n: c for n, c in zip(lead_names, lead, strict=True)} | {"__part": F.pmod(F.xxhash64(*order), F.lit(parts))})
    keys = [*within, *lead_names, "__part"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*within).orderBy(*lead_names, "__part").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(*[F.col(k).alias(f"{k}__f") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}__f")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = ranked.join(firsts, cond)
    return joined.withColumn(out, (F.col("__first") + F.col("__rank") - 1).cast("long")).drop("__first", "__rank", "__part", *lead_names, *[f"{k}__f" for k in keys])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
        size = F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + width(x, kind.elementType).cast("long"))
    elif isinstance(kind, T.ArrayType):
        size = F.size(value) * 8 + 16
    elif isinstance(kind, T.StructType):
        size = F.lit(16)
        for f in kind.fields:
            size = size + width(value[f.name], f.dataType)
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(8))


def small(df: DataFrame, rows: int = 2_000_000, most: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and takes at most about ``most`` bytes; else as it
    is, for a shuffle join. Of a written table both are known; any other is written first."""
    if df not in _KEPT:
        df = written(df, "small")
    known = kept(df)
    return F.broadcast(df) if known.rows <= rows and known.size <= most else df


#: Rows of one key from which they are not dealt by it.
HOT = 1_000_000


def join_counted(left: DataFrame, right: DataFrame, on: Column, n: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has each key once with the number ``n`` of left rows that it has about.

    A right side that fits is broadcast. A longer one is joined by key but for its hottest keys: those of over ``HOT``
    rows are few (together they can't have more than all rows), and are broadcast if they fit. The left side may be read
    several times, so give it written."""
    right = right if right in _KEPT else written(right, "right")
    sent = small(right)
    if sent is not right:
        return left.join(sent, on, how)
    hot = F.col(n) > HOT
    top = written(right.filter(hot), "hot")
    if not kept(top).rows:
        return left.join(right, on, how)
    top = small(top)
    return left.join(top, on).unionByName(left.join(top, on, "left_anti").join(right.filter(~hot), on, how))


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def least_ranked(df: DataFrame, rank: Column, n: int, size: Column, most: int = 64 << 20) -> DataFrame:
    """At most n rows of together at most ``most`` bytes by ``size``, those of the least ranks (even hashes), one for
    each rank. Tasks send ranks and sizes, never the rows that do not stay, and of those only the part of the ranks that
    should hold n: that part is widened if many rows have equal ranks."""
    ranked = df.withColumn("__rank", rank)
    part = min(1.0, 8 * n / max(df.count(), 1))
    while True:
        low = ranked if part >= 1 else ranked.filter(F.col("__rank") <= int(-(2**63) + part * 2**64))
        got = low.groupBy("__rank").agg(F.max(size).cast("long").alias("size")).orderBy("__rank").limit(n).collect()
        if len(got) >= n or part >= 1:
            break
        part = min(1.0, 8 * part)
    total, last = 0, None
    for r in got:
        total += r["size"] or 0
        if total > most:
            break
        last = r["__rank"]
    return ranked.filter(F.col("__rank") <= last if last is not None else F.lit(False)).dropDuplicates(["__rank"]).orderBy("__rank").drop("__rank")
