"""Near duplicates: SuperMinHash signatures, banding, exact verification, union-find groups.

A document is the set of its distinct word shingles, as 64-bit hashes. SuperMinHash gives each
element one value in each of m places, drawn along a random permutation, so that the ranks of an
element are correlated and the signature has a lower variance than m independent hashes; levels that
can no longer improve a place are not drawn (early stopping). Signatures are cut into bands; documents
that agree on a band meet in a bucket.

Documents with equal sets are one class from the start. In a bucket, members of one group are already
linked, so only pairs across groups are compared. First each class meets one other, the leader of most
of its buckets; that links most of what is alike, and moves each set about once. Buckets that still hold several
groups are then worked off in waves, in blocks of bounded bytes: signatures first, which tell by far
which members have nobody near them in another group, then the exact intersections of the full sets of those left.
Blocks return a spanning forest of the links found (local union-find), and the forests are merged by
distributed star contraction. Buckets with the same members are compared once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, join_counted, kept, mix64, slices, small, written

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of sets, and of signatures, in a block.
BLOCK_BYTES = 4 << 20
#: What a row of a block counts for at least, so that blocks of small sets are bounded by rows (2,048): each pair of rows
#: takes a place in a matrix.
ROW_BYTES = 2048
#: Bytes of the sets that meet their leader in one place.
STAR_BYTES = 256 << 10
#: Members of buckets up to which all buckets are worked off at once.
FEW = 1_000_000
#: How far below the threshold the share of equal places must be for a pair not to be compared: of 252 places, it is at
#: least 4.8 standard deviations at a similarity of 0.8.
MARGIN = 0.12


def shingle_set(raw: bytes | None, n: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles (with fewer words, of the whole sequence)."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix64(out * GOLDEN + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets: float64, a row for each.

    Level j gives every element the value j + u at the j-th place of its own random permutation (built
    by swaps as far as needed). A set is done after level j once all its places hold values below j + 1."""
    sig = np.full(len(sets) * m, np.inf)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    seed = np.concatenate(sets)
    places = None
    for level in range(m):
        draw = mix64(seed + np.uint64((level + 1) * int(GOLDEN) % (1 << 64)))
        value = (draw >> np.uint64(40)).astype(np.float64) / (1 << 24) + level
        other = level + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            at, first = other, other
        else:
            if places is None:  # the permutations as the first level's swap left them
                places = np.tile(np.arange(m, dtype=np.uint16), (len(seed), 1))
                rows = np.arange(len(seed))
                places[rows, first] = 0
                places[:, 0] = first
            rows = np.arange(len(seed))
            at = places[rows, other].astype(np.int64)
            places[rows, other] = places[:, level]
            places[:, level] = at
        np.minimum.at(sig, owner * m + at, value)
        open_sets = np.flatnonzero(sig.reshape(-1, m).max(axis=1) >= level + 1)
        if not len(open_sets):
            break
        stay = np.isin(owner, open_sets)
        if not stay.all():
            owner, seed, first = owner[stay], seed[stay], first[stay]
            places = places[stay] if places is not None else None
    return sig.reshape(-1, m)


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """Hash of each band of each signature: int64, a row for each signature."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        out = mix64(out * GOLDEN + bits[:, :, i])
    return out.view(np.int64)


def digest_of(elements: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set, as two signed longs."""
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, bands, marks): two hashes of the whole set, the band hashes, and a byte of each
    place of the signature; empty sets: nulls."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 256 << 10):
            sets = [shingle_set(raw, shingle) for raw in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes, marks, a, b = ([None] * len(sets) for _ in range(4))
            if full:
                signed = super_minhash([sets[i] for i in full], bands * rows)
                places = (mix64(np.ascontiguousarray(signed).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                for i, h, m in zip(full, band_hashes(signed, bands), places, strict=True):
                    hashes[i], marks[i] = h, m.tobytes()
                    a[i], b[i] = digest_of(sets[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["id", "n_shingles", "set_a", "set_b", "bands", "marks"],
            )

    rows_ = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows_.mapInArrow(sign, "id long, n_shingles long, set_a long, set_b long, bands array<long>, marks binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, elements): the full sets of ``wanted`` (node, set_a, set_b): of the rows of each id, those with the very
    text that stands for its class."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            sets = [shingle_set(raw, shingle) for raw in texts]
            same = [digest_of(s) == (a, b) for s, a, b in zip(sets, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = [i for i, ok in enumerate(same) if ok]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["node", "elements"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small(wanted), F.col("id") == F.col("node"))
    return rows.select("id", "text", "set_a", "set_b").mapInArrow(build, "node long, elements binary")


def links_of_star(ids: np.ndarray, center: int, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """The links of one node of ``ids`` with the others."""
    where = int(np.flatnonzero(ids == center)[0])
    own, size = sets[where], np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    common = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(size) - size)
    linked = 100 * common >= threshold * (size + len(own) - common)
    return [(int(center), int(x)) for x in ids[linked] if x != center]


def close_pairs(marks: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of ``marks`` (bytes, a row for each signature) that agree in at least that share of places.

    Matrix products count where the two low bits agree; pairs that are near by those, with a margin, are looked at
    byte by byte."""
    n, width = marks.shape
    rough = np.zeros((n, n), np.float32)
    for v in range(4):
        part = (marks & 3 == v).astype(np.float32)
        rough += part @ part.T
    x, y = np.nonzero(np.triu(rough >= width * (0.25 + 0.75 * (least - 0.05)), 1))
    keep = np.zeros(len(x), bool)
    step = max(1, (16 << 20) // max(width, 1))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        keep[part] = np.count_nonzero(marks[x[part]] == marks[y[part]], axis=1) >= least * width
    return x[keep], y[keep]


def with_neighbours(bucket: int, groups: np.ndarray, probe: np.ndarray, marks: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Which rows have a close one in another group, one of the two probing, for which ``bucket`` is the first that both
    are in (``own``: a row's buckets by band, 0 for none), so that a pair is compared in one bucket only."""
    x, y = close_pairs(marks, least)
    keep = (groups[x] != groups[y]) & (probe[x] | probe[y])
    x, y = x[keep], y[keep]
    near, step = np.zeros(len(marks), bool), 1 << 15
    for at in range(0, len(x), step):
        i, j = x[at : at + step], y[at : at + step]
        same = (own[i] == own[j]) & (own[i] != 0)
        first = own[i, same.argmax(axis=1)] == bucket
        near[i[first]] = near[j[first]] = True
    return near


def links_of_block(ids: np.ndarray, groups: np.ndarray, probe: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different groups, one of each pair probing.

    Intersections come from products of 0/1 matrices over slices of the shared elements."""
    n = len(ids)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    elements, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column, width = owner[keep], renumber[column[keep]], int(shared.sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    step = 4096
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        part = np.zeros((n, min(step, width - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    size = np.array([len(s) for s in sets], np.float64)
    root = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for at in range(0, n, 256):
        rows = slice(at, at + 256)
        both = common[rows].astype(np.float64)
        linked = (100 * both >= threshold * (size[rows, None] + size[None, :] - both)) & (groups[rows, None] != groups[None, :]) & (probe[rows, None] | probe[None, :])
        for i, j in zip(*np.nonzero(np.triu(linked, at + 1)), strict=True):
            a, b = find(groups[at + i]), find(groups[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                forest.append((int(groups[at + i]), int(groups[j])))
    return forest


def components(links: DataFrame) -> DataFrame:
    """The nodes of ``links`` (a, b) that are not the least of their component, as a, with the least, as b; a written table.

    Alternating star contraction: every node is hung on the least of its neighbours, large and small
    neighbours in turn, until all are stars; a node of many links is summed before it is shuffled."""
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while kept(links).rows:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"), "n")
        large = written(join_counted(both, least, F.col("a") == F.col("at"), "n").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "at")
        hung = large.join(least, F.col("a") == F.col("at")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        hung = written(hung, "links")
        forget(links, large)
        links = hung
        # done once every node is hung on one other, upon which no node is hung that hangs itself
        times = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if times.join(links.select(F.col("b").alias("upon")).distinct(), F.col("a") == F.col("upon"), "left").filter("n > 1 OR upon IS NOT NULL").isEmpty():
            break
    return links


def dealt(part: DataFrame, weight: str, most: int) -> DataFrame:
    """The rows of ``part`` (bucket, node, grp, and ``weight`` in bytes) dealt to pairs of blocks that meet: bucket, node,
    grp, ``probe``, i, j, vs_main; only of buckets with several groups.

    The largest group of a bucket is only compared with; all others probe. Blocks are cut by hashes so that one has
    about ``most`` bytes."""
    counts = part.groupBy("bucket", "grp").agg(F.sum(weight).alias("n"), F.count(F.lit(1)).alias("rows"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("n", "grp")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows")).filter("groups > 1")
    blocks = lambda n: F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    main = main.select(F.col("bucket").alias("of"), F.col("main.grp").alias("main"), blocks(F.col("main.n")).alias("main_blocks"), blocks(F.col("all") - F.col("main.n")).alias("probe_blocks"), "rows")
    open_ = join_counted(part, main, F.col("bucket") == F.col("of"), "rows").withColumn("probe", F.col("grp") != F.col("main"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("probe"), F.col("probe_blocks")).otherwise(F.col("main_blocks"))).cast("int")
    pairs = F.expr("""if(probe,
        concat(transform(sequence(0, probe_blocks - 1), j -> struct(least(block, j) AS i, greatest(block, j) AS j, false AS vs_main)),
               transform(sequence(0, main_blocks - 1), j -> struct(block AS i, j AS j, true AS vs_main))),
        transform(sequence(0, probe_blocks - 1), i -> struct(i AS i, block AS j, true AS vs_main)))""")
    return open_.withColumn("block", block).select("bucket", "node", "grp", "probe", F.inline(pairs))


def parts_for(rows: int, each: int) -> int:
    """Parts of a shuffle of so many rows."""
    return max(8, -(-rows // each))


class _Linker:
    """The search for links between the classes of ``members`` (bucket, node, leader)."""

    def __init__(self, members: DataFrame, payload: DataFrame, sets: DataFrame, threshold: int):
        self.members, self.payload, self.sets, self.threshold = members, payload, sets, threshold
        self.groups: DataFrame | None = None  # (node, root) of the nodes that are not their own root

    def merge(self, links: DataFrame) -> None:
        """Adds links between roots (or nodes, at first)."""
        found = components(links)
        if self.groups is not None and not kept(found).rows:
            return
        if self.groups is not None:
            moved = self.groups.join(found, F.col("root") == F.col("a"), "left").select("node", F.coalesce("b", "root").alias("root"))
            self.groups = written(moved.unionByName(found.select(F.col("a").alias("node"), F.col("b").alias("root"))), "groups")
        else:
            self.groups = found.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def meet_leaders(self) -> None:
        """Compares each class with the leader of most of its buckets."""
        votes = self.members.filter("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("leader")).alias("before"))).alias("b")).select("node", (-F.col("b.before")).alias("leader"))
        star = written(best.join(self.payload.select("node", "n_shingles"), "node"), "stars")
        parts = star.groupBy("leader").agg(F.greatest(F.ceil(8 * F.sum("n_shingles") / STAR_BYTES), F.lit(1)).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
        parts = written(parts.withColumnRenamed("leader", "of"), "parts")
        planets = join_counted(star, parts, F.col("leader") == F.col("of"), "n").select("node", "leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("block"))
        suns = parts.select(F.col("of").alias("node"), F.col("of").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
        threshold = self.threshold

        def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            found = links_of_star(frame["node"].to_numpy(), key[0], [np.frombuffer(x, np.uint64) for x in frame["elements"]], threshold)
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        rows = self.sets.join(small(planets.unionByName(suns)), "node").repartition(parts_for(kept(star).rows, 4000), "leader", "block")
        self.merge(rows.groupBy("leader", "block").applyInPandas(compare, "a long, b long"))

    def work_off(self, buckets: Column) -> None:
        """Compares the members of the buckets that meet a condition, across groups."""
        part = self.members.filter(buckets).join(self.payload.select("node", "n_shingles"), "node")
        roots = self.groups.select(F.col("node").alias("n"), "root")
        part = written(part.join(roots, F.col("node") == F.col("n"), "left").select("bucket", "node", F.coalesce("root", "node").alias("grp"), F.greatest(8 * F.col("n_shingles"), F.lit(ROW_BYTES)).alias("bytes"), F.lit(1024).cast("long").alias("mark")), "wave")
        least, threshold = self.threshold / 100 - MARGIN, self.threshold

        def look(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            marks = np.frombuffer(b"".join(frame["marks"]), np.uint8).reshape(len(frame), -1)
            own = np.stack(frame["own"].to_numpy()).astype(np.int64)
            near = with_neighbours(key[0], frame["grp"].to_numpy(), frame["probe"].to_numpy(), marks, own, least)
            return pd.DataFrame({"bucket": key[0], "node": frame["node"][near]})

        def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            found = links_of_block(frame["node"].to_numpy(), frame["grp"].to_numpy(), frame["probe"].to_numpy(), [np.frombuffer(x, np.uint64) for x in frame["elements"]], threshold)
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        meet = ["bucket", "i", "j", "vs_main"]
        looks = written(dealt(part, "mark", 1 << 20), "looks")
        if not kept(looks).rows:
            return
        # the work is in the pairs, not in the bytes, so the number of parts goes by rows
        rows = self.payload.select("node", "marks", "own").join(small(looks), "node").repartition(parts_for(kept(looks).rows, 2000), *meet)
        near = written(rows.groupBy(*meet).applyInPandas(look, "bucket long, node long").distinct(), "near")
        if not kept(near).rows:
            return
        left = written(part.join(small(near), ["bucket", "node"]), "left")
        open_ = written(dealt(left, "bytes", BLOCK_BYTES), "dealt")
        blocks = self.sets.join(small(open_), "node").repartition(parts_for(kept(open_).rows, 1000), *meet)
        self.merge(blocks.groupBy(*meet).applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80, bands: int = 42, rows: int = 6) -> DataFrame:
    """Each id of ``docs`` once: id, ``n_shingles``, ``component_id`` (the least id that links reach), ``kept`` (id = component_id).

    Two documents are linked if 100 * shared >= threshold * united shingles, on full sets. Two with the least
    linked similarity, 0.8, miss each other in all of 42 bands of 6 with probability 3e-6, and are told too far apart
    by their signatures with less than 1e-6; any path of links joins them as well. Ids are integers. A text that is null or has no word has
    an empty set and no link. Rows with one id are one document, that of the text whose set has the least hash. Rows with
    a null id are each returned, with a null component, and kept. An empty table gives an empty result."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    signed = written(signatures(docs, id_col, text_col, shingle, bands, rows), "signed")
    named = signed.filter("id IS NOT NULL")
    one = written(named.groupBy("id").agg(F.min(F.struct("set_a", "set_b", "n_shingles")).alias("s")).select("id", "s.*"), "documents")
    classes = written(one.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    same = (F.col("id") == F.col("node")) & (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b"))
    reps = named.join(classes.select("node", F.col("set_a").alias("a"), F.col("set_b").alias("b")), same).select("node", "set_a", "set_b", "n_shingles", "bands", "marks")
    repeated = named.count() > kept(one).rows
    reps = written(reps.dropDuplicates(["node"]) if repeated else reps, "classes")
    buckets = reps.select("node", F.explode("bands").alias("bucket"))  # a band's number is part of its hash
    crowd = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("bucket", "of")
    crowded = written(join_counted(buckets, crowd, F.col("bucket") == F.col("of"), "n").select("bucket", "node"), "buckets")
    # buckets with the same members are worked off once
    alike = crowded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"), F.min("node").alias("leader"))
    alike = alike.groupBy("n", "members").agg(F.min("bucket").alias("of"), F.min("leader").alias("leader")).select("of", "leader", "n")
    members = written(join_counted(crowded, alike, F.col("bucket") == F.col("of"), "n").select("bucket", "node", "leader"), "members")
    wanted = written(members.select("node").distinct().join(reps.select("node", "set_a", "set_b"), "node"), "wanted")
    sets = shingle_sets(docs.filter(F.col(id_col).isNotNull()), wanted, id_col, text_col, shingle)
    sets = written(sets.dropDuplicates(["node"]) if repeated else sets, "sets")
    in_buckets = members.groupBy("node").agg(F.collect_list("bucket").alias("in_buckets"))  # at most one a band
    own = F.expr("transform(bands, b -> if(array_contains(in_buckets, b), b, 0L))").alias("own")
    payload = written(reps.select("node", "n_shingles", "marks", "bands").join(small(in_buckets), "node").select("node", "n_shingles", "marks", own), "marks")
    linker = _Linker(members, payload, sets, threshold)
    linker.meet_leaders()
    eighth = F.pmod("bucket", F.lit(8)) == 0
    # links between those left show in many buckets: unless they are few, an eighth of the buckets goes first
    for wave in (eighth, ~eighth) if kept(members).rows > FEW else (F.lit(True),):
        linker.work_off(wave)
    roots = linker.groups.select(F.col("node").alias("of_node"), "root")
    classed = classes.join(roots, F.col("node") == F.col("of_node"), "left").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "n", F.coalesce("root", "node").alias("component_id"))
    out = join_counted(one, classed, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")), "n", "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("component_id") == F.col("id"))
    nameless = signed.filter("id IS NULL").select("id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document leads its group; rows with a null id stay, and so do all rows of an id
    that leads; all columns stay, whatever their names."""
    gone = near_duplicates(docs, id_col, **options).filter(~F.col("kept")).select(F.col(id_col).alias("gone"))
    return docs.select(F.struct("*").alias("doc")).join(small(gone), F.col(f"doc.{id_col}") == F.col("gone"), "left_anti").select("doc.*")
