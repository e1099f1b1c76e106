"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A window is a run of a document's words as long as a benchmark item (the whole text, if that is shorter). Two are
compared by the weighted Jaccard similarity of their shingles. A window that reaches the wanted similarity must
hold shingles of the item that weigh at least that share of the item. Every start with so much is taken, by a running sum over
the places where a document has a shingle of the item, whatever their order there: no window that could pass is left out,
and windows that can't pass are not built. Each window gets a 64-bit SimHash of its words. Fingerprints are cut
into blocks; two within the radius have a block in which they differ by no more than radius / blocks bits, so the
index lists for each item all values that near to each of its blocks, and an equality join finds all pairs
within the radius. Pairs are verified on their full shingles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small, written

SHINGLE = 5
RADIUS = 15
BLOCKS = 4
#: A shingle's weight is its number of letters and digits, at most this.
HEAVIEST = 65_535


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null text: none."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def runs(values: str, n: int, joined) -> Column:
    """``joined`` over each n neighbours of an array, one value for each first of them."""
    out = F.col(values)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(values, i + 1, F.greatest(F.size(values) - i, F.lit(0))), joined)
    return F.slice(out, 1, F.greatest(F.size(values) - (n - 1), F.lit(0)))


def gram_hashes(hashes: str, n: int) -> Column:
    """Hashes of the n-word runs of an array of word hashes."""
    return runs(hashes, n, lambda a, b: F.xxhash64(a, b))


def gram_weights(lengths: str, n: int) -> Column:
    """Weights of the n-word runs of an array of word lengths."""
    return F.transform(runs(lengths, n, lambda a, b: a + b), lambda x: F.least(x, F.lit(HEAVIEST)).cast("long"))


def fingerprint(hashes: str) -> Column:
    """64-bit SimHash of an array of word hashes: a bit is set if over half of the words have it.

    Votes are summed several bits at once, in lanes of a long: eight lanes while a lane of eight bits can hold the
    sum, else two."""

    def votes(lane: int) -> str:
        ones = sum(1 << at for at in range(0, 64, lane))
        sums = f"transform(sequence(0, {lane - 1}), r -> aggregate({hashes}, 0L, (v, h) -> v + (shiftrightunsigned(h, r) & {ones}L)))"
        return f"""transform(array({sums}), sums -> aggregate(sequence(0, 63), 0L, (fp, b) ->
            fp | if((shiftrightunsigned(sums[b % {lane}], {lane} * int(b div {lane})) & {(1 << lane) - 1}L) * 2 > size({hashes}), shiftleft(1L, b), 0L)))[0]"""

    return F.expr(f"if(size({hashes}) < 128, {votes(8)}, {votes(32)})")


def blocks(fp: str, n: int = BLOCKS) -> Column:
    """The fingerprint's n blocks: numbers of block and bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L").alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def probes(fp: str, radius: int, n: int = BLOCKS) -> Column:
    """The fingerprint's blocks and all values within radius / n bits of each: every fingerprint within the radius has
    one of them as its block."""
    width = 64 // n
    masks = [sum(1 << bit for bit in bits) for k in range(radius // n + 1) for bits in combinations(range(width), k)]
    near = ", ".join(f"{m}L" for m in masks)
    edges = [64 * i // n for i in range(n + 1)]
    own = ", ".join(f"struct({i} AS block, shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L AS bits)" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return F.expr(f"flatten(transform(array({own}), b -> transform(array({near}), m -> struct(b.block AS block, b.bits ^ m AS bits))))")


def keys(grams: str, weights: str) -> Column:
    """A multiset of weighted shingles as a set of longs: a hash of the shingle and its how-manieth occurrence, with
    the weight in the low 16 bits. Occurrences are counted only where shingles repeat."""
    seen = f"if(size(array_distinct({grams})) = size({grams}), array_repeat(1, size({grams})), transform({grams}, (g, i) -> size(filter(slice({grams}, 1, i + 1), y -> y = g))))"
    return F.expr(f"zip_with(zip_with({grams}, {weights}, (g, w) -> struct(g AS g, w AS w)), {seen}, (x, k) -> (xxhash64(x.g, k) & -65536L) | x.w)")


def weight(of: str) -> Column:
    return F.expr(f"aggregate({of}, 0L, (s, x) -> s + (x & 65535L))")


def read_items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item, len, n, i_hashes, i_grams, i_fp, i_keys, total) of the items with a word; n: words of a shingle."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("i_words")).filter("size(i_words) > 0")
    items = items.select("item", F.size("i_words").alias("len"), F.transform("i_words", lambda w: F.xxhash64(w)).alias("i_hashes"), F.transform("i_words", lambda w: F.length(w)).alias("i_lengths"))
    # as gram_hashes and gram_weights, for a number of words that differs by row
    grams = F.expr("transform(sequence(1, len - n + 1), i -> aggregate(slice(i_hashes, i + 1, n - 1), i_hashes[i - 1], (a, b) -> xxhash64(a, b)))")
    weights = F.expr(f"transform(sequence(1, len - n + 1), i -> cast(least(aggregate(slice(i_lengths, i, n), 0, (a, b) -> a + b), {HEAVIEST}) AS long))")
    items = items.withColumn("n", F.least("len", F.lit(SHINGLE))).withColumns({"i_grams": grams, "i_weights": weights, "i_fp": fingerprint("i_hashes")})
    items = items.withColumn("i_keys", keys("i_grams", "i_weights"))
    return written(items.select("item", "len", "n", "i_grams", "i_weights", "i_fp", "i_keys", weight("i_keys").alias("total")), "items")


def window_starts(hashed: DataFrame, items: DataFrame, n: int, similarity: float) -> DataFrame:
    """(k_doc, k_hash, len, start, room) of the windows of n-word shingles that could be similar to an item; ``room``:
    the most that such a window's shingles can weigh.

    H(start), the weight of the places in a window where the text has a shingle of the item, goes up where a place
    comes in at the window's end and down where it leaves at the start: a running sum over these events."""
    grams = items.filter(F.col("n") == n).select("item", "len", "total", F.explode(F.zip_with("i_grams", "i_weights", lambda g, w: F.struct(g.alias("gram"), w.alias("w")))).alias("g"))
    grams = small(grams.select("item", "len", "total", "g.gram", "g.w").dropDuplicates(["item", "gram"]))
    hits = hashed.select("k_doc", "k_hash", "k_row", F.size("hashes").alias("n_words"), F.posexplode(gram_hashes("hashes", n)).alias("pos", "gram")).join(grams, "gram")
    text_item = ["k_doc", "k_hash", "k_row", "item"]
    some = hits.withColumn("held", F.sum("w").over(W.partitionBy(*text_item))).filter(F.col("held") >= similarity * F.col("total"))
    places = F.col("len") - (n - 1)
    events = some.withColumn("event", F.explode(F.array(F.struct((F.col("pos") - places + 1).alias("at"), F.col("w").alias("by")), F.struct((F.col("pos") + 1).alias("at"), (-F.col("w")).alias("by")))))
    line = W.partitionBy(*text_item).orderBy("event.at")
    stretch = events.select(*text_item, "len", "total", "n_words", F.col("event.at").alias("at"), F.sum("event.by").over(line).alias("h"), F.lead("event.at").over(line).alias("next"))
    first, last = F.greatest("at", F.lit(0)), F.least(F.col("next") - 1, F.greatest(F.col("n_words") - F.col("len"), F.lit(0)))
    stretch = stretch.filter((F.col("h") >= similarity * F.col("total")) & (first <= last))
    starts = stretch.select("k_doc", "k_hash", "len", F.explode(F.sequence(first, last)).alias("start"), (F.col("h") * (1 + similarity) / similarity - F.col("total")).alias("room"))
    return starts.groupBy("k_doc", "k_hash", "len", "start").agg(F.max("room").alias("room"))


def seeded_windows(docs: DataFrame, items: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame | None:
    """(k_doc, k_hash, len, start, n_words, fp, keys, weight): all windows that could be similar to an item; None without items."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # a text is named by its id and hash, a row of it by its number
    hashed = texts.select(F.col("doc").alias("k_doc"), F.xxhash64("text").alias("k_hash"), F.monotonically_increasing_id().alias("k_row"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    found = None
    for n in sorted(r[0] for r in items.select("n").distinct().collect()):  # at most SHINGLE
        starts = window_starts(hashed, items, n, similarity)
        wanted = starts.groupBy("k_doc", "k_hash").agg(F.collect_list(F.struct("len", "start", "room")).alias("wanted"))
        match = F.col("doc").eqNullSafe(F.col("k_doc")) & (F.xxhash64("text") == F.col("k_hash"))
        opened = texts.join(small(wanted), match).select("k_doc", "k_hash", words(F.col("text")).alias("d_words"), "wanted")
        opened = opened.select("k_doc", "k_hash", F.transform("d_words", lambda w: F.xxhash64(w)).alias("hashes"), F.transform("d_words", lambda w: F.length(w)).alias("lengths"), "wanted")
        opened = opened.select("k_doc", "k_hash", "hashes", gram_hashes("hashes", n).alias("grams"), gram_weights("lengths", n).alias("weights"), F.explode("wanted").alias("want"))
        begin, places = F.col("want.start") + 1, F.col("want.len") - (n - 1)
        windows = opened.select("k_doc", "k_hash", "want.*", F.slice("hashes", begin, F.col("want.len")).alias("hashes"), F.slice("grams", begin, places).alias("grams"), F.slice("weights", begin, places).alias("weights"))
        windows = windows.withColumn("weight", F.aggregate("weights", F.lit(0).cast("long"), lambda s, x: s + x)).filter(F.col("weight") <= F.col("room"))
        windows = windows.select("k_doc", "k_hash", "len", "start", F.size("hashes").alias("n_words"), fingerprint("hashes").alias("fp"), keys("grams", "weights").alias("keys"), "weight")
        found = windows if found is None else found.unionByName(windows)
    return None if found is None else written(found, "windows")


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(k_doc, k_hash, item, start, n_words, hamming, similarity): all windows within the radius and similar to an item."""
    items = read_items(benchmark, item_col, item_text)
    windows = seeded_windows(docs, items, similarity, id_col, text_col)
    if windows is None:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"k_doc {kind}, k_hash long, item {items.schema['item'].dataType.simpleString()}, start int, n_words int, hamming int, similarity double")
    prints = windows.select("len", "fp").distinct().select("len", "fp", F.inline(blocks("fp")))
    index = items.select("item", "len", "i_fp", F.inline(probes("i_fp", radius)))
    near = prints.join(index, ["len", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("i_fp")))).filter(F.col("hamming") <= radius)
    near = near.select("len", "fp", "item", "hamming").distinct()
    pairs = windows.join(small(near), ["len", "fp"]).join(small(items.select("item", "i_keys", "total")), "item")
    shared = F.expr("aggregate(array_intersect(keys, i_keys), 0L, (s, x) -> s + (x & 65535L))")
    pairs = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.col("weight") + F.col("total") - F.col("shared")))
    return pairs.filter(F.col("similarity") >= similarity).select("k_doc", "k_hash", "item", "start", "n_words", "hamming", "similarity")


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item: id, item id, ``start`` (word), ``n_words``, ``hamming``, ``similarity``; for
    each document and item the most similar window (the first of equals).

    A text or item without a word, or null, matches nothing. Equal items are found each. Rows of one id are one
    document, whatever their texts; equal texts under other ids are found each. Empty tables give an empty result."""
    found = matches(docs, benchmark, similarity, radius, id_col, text_col, item_col, item_text)
    best = found.groupBy("k_doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words", "hamming")).alias("b"))
    return best.select(F.col("k_doc").alias(id_col), F.col("item").alias(item_col), (-F.col("b.before")).alias("start"), "b.n_words", "b.hamming", F.round("b.similarity", 6).alias("similarity"))


def remove(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose text holds a benchmark item; all columns stay, whatever their names."""
    leaks = matches(docs, benchmark, similarity, radius, id_col, text_col, item_col, item_text).select("k_doc", "k_hash").distinct()
    same = F.col(f"doc.{id_col}").eqNullSafe(F.col("k_doc")) & (F.xxhash64(f"doc.{text_col}") == F.col("k_hash"))
    return docs.select(F.struct("*").alias("doc")).join(small(leaks), same, "left_anti").select("doc.*")
