"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to rows of an embedding; filters of several widths slide over the whole text, the
largest response of each filter is kept and a logistic layer weighs them. Gradients reach only the
windows that won the pooling, so training is sparse and cheap. Thresholds are calibrated by
language; the language is told from the text's own frequent words, never from a column.

Training reads every labelled row. Words are counted by Spark; weights are learned in parts of ``Training.part`` rows, one
in a task, whose changes are averaged after each of two rounds (one part learns alone); thresholds come from the logits of
all rows, each by a model that was fitted without it. Only the model itself, of fixed size, passes through the driver. Scoring
streams over all documents in Arrow batches.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, slices, small, written

WIDTHS = (1, 2, 3)
STRIP = " \t\r\n.,;:!?\"'()[]{}<>*#$%&|~-_/\\"
#: Buckets of hashed words; every word has one.
BUCKETS = 1 << 16
#: Letters of a word that have a bucket of their own, so that forms of one stem share what is learned.
STEM = 5
#: The row of the embedding that no word has: the gap between texts. It is zeros.
GAP = 0
#: Words whose responses are worked out together, rows of the embedding that are added up together, parts added up together.
PIECE, BLOCK, FEW = 1 << 17, 1024, 64
#: Logits within a thousandth are counted together when a threshold is told.
CELLS = 1000


class WordRows(dict):
    """word (UTF-8) -> the rows of its two buckets as one number, or -1 for punctuation only: by hashes of its lower case
    without punctuation at its ends, whole and the first ``STEM`` letters. Emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        plain = word.decode("utf-8", "replace").lower().strip(STRIP)
        row = -1
        if plain:
            stem = xxhash.xxh32_intdigest(plain[:STEM] + "-") % BUCKETS + 1 if len(plain) > STEM else GAP
            row = (xxhash.xxh32_intdigest(plain) % BUCKETS + 1) << 32 | stem
        self[word] = row
        return row

    def of(self, raw: bytes | None) -> np.ndarray:
        """The rows of the words of a text, punctuation left out: an array of two columns."""
        words = (raw or b"").split()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        out = out[out >= 0]
        return np.stack([out >> 32, out & 0xFFFFFFFF], axis=1).astype(np.int32)


@dataclass(frozen=True)
class Training:
    """Settings of a fit: about so many rows to a part, so many bytes of their words held at once; no row is left out."""

    part: int = 10_000
    most_bytes: int = 64 << 20
    dim: int = 12
    filters: int = 8
    epochs: int = 2
    least_steps: int = 200
    batch: int = 48
    rate: float = 0.003
    lift: float = 0.5
    prior: float = 30.0
    start: float = 0.5
    spread: float = 0.01
    folds: int = 2
    rare: float = 100.0
    least_positives: int = 25
    frequent: int = 80
    seed: int = 7


@dataclass
class Model:
    """Weights, thresholds by language (and for none, under ""), and the frequent words of each language."""

    embed: np.ndarray
    convs: list[np.ndarray]  # for each width: width x dim x filters
    bias: np.ndarray
    out: np.ndarray
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 1.0})
    languages: list[str] = field(default_factory=list)
    signs: np.ndarray | None = None  # of each row the language in which alone its word is frequent, or -1
    scales: np.ndarray = field(default_factory=lambda: np.full(3 + len(WIDTHS), 1e-8))  # running mean squares of gradients

    def tables(self) -> list[list[np.ndarray]]:
        """Each row's part in each filter, by width and place in the window."""
        return [[np.ascontiguousarray(self.embed @ place) for place in conv] for conv in self.convs]

    def pooled(self, texts: list[np.ndarray], tables: list[list[np.ndarray]]) -> np.ndarray:
        """Largest response of each filter in each text."""
        ids = np.concatenate([*texts, np.zeros((max(WIDTHS), 2), np.int32)])
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
        n, best = len(ids) - max(WIDTHS), []
        for table in tables:
            out = np.zeros((n, table[0].shape[1]), np.float32)
            for o, place in enumerate(table):
                for column in (0, 1):
                    out += place[ids[o : n + o, column]]
            best.append(np.maximum.reduceat(out, starts, axis=0))
        return np.concatenate(best, axis=1)

    def logits(self, texts: list[np.ndarray], tables: list[list[np.ndarray]]) -> np.ndarray:
        return np.maximum(self.pooled(texts, tables) + self.bias, 0) @ self.out + self.offset

    def tell(self, text: np.ndarray) -> str:
        """The language whose frequent words the text has most of; "" if none."""
        if self.signs is None or not self.languages:
            return ""
        own = self.signs[text[:, 0]]
        own = own[own >= 0]
        return self.languages[int(np.bincount(own).argmax())] if len(own) else ""

    def scores(self, texts: list[np.ndarray], tables: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities, 0.5 at the threshold of each text's language."""
        cut = np.array([self.thresholds.get(self.tell(t), self.thresholds[""]) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(texts, tables) - cut, -40, 40)))


def pad(rows: np.ndarray) -> np.ndarray:
    """A text's rows and the gap after them."""
    return np.concatenate([rows, np.full((max(WIDTHS) - 1, 2), GAP, np.int32)])


def _begun(seen: np.ndarray, positive: np.ndarray, share: float, how: Training) -> Model:
    """A model before its first step. ``seen``, ``positive``: texts and texts labelled 1 that hold each row's word.

    The first dimension starts as each word's smoothed log odds, and every filter starts by reading it."""
    rng = np.random.default_rng(how.seed)
    wide = how.filters * len(WIDTHS)
    model = Model(
        embed=np.zeros((BUCKETS + 1, how.dim), np.float32),
        convs=[rng.normal(0, 0.5 / np.sqrt(w * how.dim), (w, how.dim, how.filters)).astype(np.float32) for w in WIDTHS],
        bias=np.zeros(wide, np.float32),
        out=np.abs(rng.normal(0, 0.1, wide)).astype(np.float32),
    )
    known = np.flatnonzero(seen)
    known = known[known != GAP]
    odds = (positive[known] + how.prior * share) / (seen[known] + how.prior)
    model.embed[known] = rng.normal(0, how.spread, (len(known), how.dim))
    model.embed[known, 0] = (np.log(odds / (1 - odds)) - np.log(share / (1 - share))) * how.start
    for conv in model.convs:
        conv[0, 0] = np.abs(conv[0, 0]) + how.start
    return model


@dataclass
class Fit:
    """A model in the making: it is fitted without the rows of ``without`` (a fold, or -1). The fewer texts hold a word, the
    less its row moves (``trust``): one of ``rare`` texts half as far as one of all. So a rare word must be seen again and
    again to count, and is not learned by heart. Classes are weighed towards each other by the power ``lift``."""

    model: Model
    without: int
    share: float
    trust: np.ndarray
    steps: int  # in all, of one part

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, passes: int, done: int, how: Training, rng: np.random.Generator) -> None:
        """So many passes over texts, in random order, after ``done`` steps. The rate falls from twice ``rate`` to nothing, as
        thresholds told from one fit are used for another and both should have come to rest."""
        weight = np.where(labels == 1, (0.5 / self.share) ** how.lift, (0.5 / (1 - self.share)) ** how.lift).astype(np.float32)
        for _ in range(passes):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), how.batch):
                batch = order[at : at + how.batch]
                _step(self.model, [texts[i] for i in batch], labels[batch], weight[batch], 2 * how.rate * max(0.0, 1 - done / self.steps), self.trust)
                done += 1


def _flat(model: Model) -> list[np.ndarray]:
    """All that is learned, as vectors: first what is small, then the embedding in blocks of rows."""
    least = np.concatenate([*[c.ravel() for c in model.convs], model.bias, model.out, [model.offset], model.scales])
    return [least, *[model.embed[at : at + BLOCK].ravel() for at in range(0, len(model.embed), BLOCK)]]


def _moved(model: Model, by: dict[int, np.ndarray]) -> None:
    """Adds to a model what ``by`` has for the vectors of ``_flat``."""
    for k, change in by.items():
        if k:
            part = model.embed[(k - 1) * BLOCK : k * BLOCK]
            part += change.reshape(part.shape)
            continue
        at = 0
        for x in (*model.convs, model.bias, model.out):
            x += change[at : at + x.size].reshape(x.shape)
            at += x.size
        model.offset += float(change[at])
        model.scales += change[at + 1 :]


def _descend(x: np.ndarray, scale: np.ndarray, grad: np.ndarray, rate: float | np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
    """A step against ``grad`` (of x[rows]), over the running root mean square of the whole tensor's gradients: a
    word that wins once moves little, one that wins again and again moves far."""
    scale *= 0.98
    scale += 0.02 * float((grad * grad).mean())
    x[rows] -= rate * grad / (np.sqrt(scale) + 1e-8)


def _winners(model: Model, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each width, where in ``ids`` each filter's response to each text is largest (the first such place).

    Whole texts are looked at, but at most ``PIECE`` words at a time."""
    owner = np.concatenate([np.full(-(-int(e - s) // PIECE), k) for k, (s, e) in enumerate(zip(starts, ends, strict=True))])
    froms = np.concatenate([np.arange(s, e, PIECE) for s, e in zip(starts, ends, strict=True)])
    tos = np.append(froms[1:], ends[-1])
    filters = model.convs[0].shape[2]
    where = [np.zeros((len(starts), filters), np.int64) for _ in model.convs]
    best = [np.full((len(starts), filters), -np.inf, np.float32) for _ in model.convs]
    first = 0
    while first < len(froms):
        last = max(first + 1, int(np.searchsorted(tos, froms[first] + PIECE, side="right")))
        lo, hi = int(froms[first]), int(tos[last - 1])
        x = model.embed[ids[lo : hi + max(WIDTHS)]].sum(axis=1)
        for conv, at, top in zip(model.convs, where, best, strict=True):
            out = sum(x[o : hi - lo + o] @ place for o, place in enumerate(conv))
            for k in range(first, last):
                piece, text = out[froms[k] - lo : tos[k] - lo], owner[k]
                place = piece.argmax(axis=0)
                high = piece[place, np.arange(filters)]
                more = high > top[text]
                at[text, more], top[text, more] = froms[k] + place[more], high[more]
        first = last
    return where


def _step(model: Model, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rate: float, trust: np.ndarray) -> None:
    """One step on a batch; a word's row moves by its ``trust``. Gaps between texts are zeros, so no window mixes two texts' words."""
    n, filters, gap, sums = len(texts), model.convs[0].shape[2], max(WIDTHS), model.scales
    ids = np.concatenate([*texts, np.zeros((gap, 2), np.int32)])
    ends = np.cumsum([len(t) for t in texts])
    where = _winners(model, ids, ends - [len(t) for t in texts], ends)
    seen = [[model.embed[ids[at + o]].sum(axis=2) for o in range(len(conv))] for conv, at in zip(model.convs, where, strict=True)]  # texts x filters x dim
    best = [sum(np.einsum("nfd,df->nf", x, place) for x, place in zip(xs, conv, strict=True)) for xs, conv in zip(seen, model.convs, strict=True)]
    hidden = np.maximum(np.concatenate(best, axis=1) + model.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.offset, -40, 40)))
    error = (weight * (p - labels) / n).astype(np.float32)
    back = (np.outer(error, model.out) * (hidden > 0)).astype(np.float32)
    model.offset -= rate * float(error.sum())
    moved, dense = np.unique(np.concatenate([ids[at + o].ravel() for conv, at in zip(model.convs, where, strict=True) for o in range(len(conv))]), return_inverse=True)
    d_embed, done = np.zeros((len(moved), model.embed.shape[1]), np.float32), 0
    for k, (conv, xs) in enumerate(zip(model.convs, seen, strict=True)):
        part, grad = back[:, k * filters : (k + 1) * filters], np.zeros_like(conv)
        for o, x in enumerate(xs):
            grad[o] = np.einsum("nfd,nf->df", x, part)
            back_to = (part[:, :, None] * conv[o].T[None]).reshape(-1, conv.shape[1])
            rows = dense[done : done + 2 * n * filters].reshape(-1, 2)
            done += 2 * n * filters
            for column in (0, 1):
                np.add.at(d_embed, rows[:, column], back_to)
        _descend(conv, sums[3 + k : 4 + k], grad, rate)
    _descend(model.bias, sums[1:2], back.sum(axis=0), rate)
    _descend(model.out, sums[2:3], hidden.T @ error, rate)
    won = np.flatnonzero(moved != GAP)
    if len(won):
        _descend(model.embed, sums[0:1], d_embed[won], rate * trust[moved[won], None], moved[won])


def _best_cut(z: np.ndarray, y: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> float:
    """``_cut`` of logits z with labels y; ``stands_for``: how many rows one counts for, by label."""
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    return _cut(z, z, weight * y, weight)


def _cut(low: np.ndarray, high: np.ndarray, positive: np.ndarray, count: np.ndarray, precise: float = 0.75) -> float:
    """The middle of the gap between cells of logits (from ``low`` to ``high``) at which F0.5 is highest: a clean text lost
    costs more than a toxic one kept.

    Ties are not cut apart; of the texts called toxic, ``precise`` must have the label; if no gap is left, none is."""
    order = np.argsort(-high, kind="stable")
    low, high = low[order], high[order]
    hit, called = np.cumsum(positive[order]), np.cumsum(count[order])
    score = 1.25 * hit / (called + 0.25 * positive.sum())
    usable = np.append(low[:-1] - high[1:] > 1e-6, False) & (hit >= precise * called)
    if not usable.any() or not hit[-1]:
        return float(high[0]) + 1.0
    k = int(np.where(usable, score, -1.0).argmax())
    return float((low[k] + high[k + 1]) / 2)


def _counted(rows: DataFrame) -> DataFrame:
    """How many labelled rows' texts hold each word (``hash``: row of the embedding), by fold and label, and, with fold and
    label -1, how often each language has it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (fold, label, lang), n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(at), pa.int32()), pa.array([label] * len(at), pa.int32()), pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["fold", "label", "lang", "hash", "n"])
            sums.clear()

        for batch, raws in slices(batches, "ids"):
            for fold, label, lang, raw in zip(*[batch.column(c).to_pylist() for c in ("fold", "label", "lang")], raws, strict=True):
                ids = np.frombuffer(raw, np.int32).reshape(-1, 2)
                own = np.unique(ids)
                sums.setdefault((fold, label, ""), np.zeros(BUCKETS + 1, np.int64))[own[own != GAP]] += 1
                if lang:
                    np.add.at(sums.setdefault((-1, -1, lang), np.zeros(BUCKETS + 1, np.int64)), ids[:, 0], 1)
                if len(sums) > 64:
                    yield from out()
        yield from out()

    return rows.select("fold", "label", "lang", "ids").mapInArrow(count, "fold int, label int, lang string, hash int, n long").groupBy("fold", "label", "lang", "hash").agg(F.sum("n").alias("n"))


def _languages(counts: DataFrame, frequent: int) -> tuple[list[str], np.ndarray]:
    """The languages that have words frequent in them alone, and of each row the one whose word it is, or -1."""
    first = W.partitionBy("lang").orderBy(F.desc("n"), "hash")
    top = counts.filter("fold = -1").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= frequent)
    own = top.groupBy("hash").agg(F.count(F.lit(1)).alias("of"), F.min("lang").alias("lang")).filter("of = 1").select("hash", "lang").collect()
    names, signs = sorted({r["lang"] for r in own}), np.full(BUCKETS + 1, -1, np.int32)
    place = {x: k for k, x in enumerate(names)}
    for r in own:
        signs[r["hash"]] = place[r["lang"]]
    return names, signs


def _averaged(rows: DataFrame, fits: list[Fit], parts: int, passes: int, turn: int, rounds: int, how: Training) -> None:
    """A round of several: each part learns on from the same models; these move by the mean of the changes, a row of a part counting as one."""
    held = rows.sparkSession.sparkContext.broadcast(fits)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, used, texts, labels, folds, size = None, [], [], [], [], [], 0

        def pass_on() -> None:
            at, marks = np.array(folds), np.array(labels, np.int8)
            for k, one in enumerate(own):
                some = np.flatnonzero(at != one.without)
                if len(some):
                    done = one.steps * turn // rounds + passes * (used[k] // how.batch)
                    one.learn([texts[i] for i in some], marks[some], passes, done, how, np.random.default_rng([how.seed, turn, part, used[k]]))
                used[k] += len(some)
            for kept in (texts, labels, folds):
                kept.clear()

        def out() -> pa.RecordBatch:
            pass_on()
            got = [(k, b, part, used[k], ((after - before) * used[k]).astype(np.float32).tobytes()) for k, one in enumerate(own) for b, (after, before) in enumerate(zip(_flat(one.model), _flat(held.value[k].model), strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["fit", "block", "part", "n", "change"])

        for batch, raws in slices(batches, "ids"):
            for of, fold, label, raw in zip(*[batch.column(c).to_pylist() for c in ("part", "fold", "label")], raws, strict=True):
                if of != part:
                    if part is not None:
                        yield out()
                    part, own, used, size = of, copy.deepcopy(held.value), [0] * len(held.value), 0
                if texts and size + len(raw) > how.most_bytes:
                    pass_on()
                    size = 0
                texts.append(pad(np.frombuffer(raw, np.int32).reshape(-1, 2)))
                labels.append(label)
                folds.append(fold)
                size += len(raw)
        if part is not None:
            yield out()

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table["change"].to_pylist())
        return pa.table([table["fit"][:1], table["block"][:1], pa.chunked_array([pa.array([table["part"][0].as_py() // FEW], pa.int32())]), pa.chunked_array([pa.array([sum(table["n"].to_pylist())], pa.int64())]), pa.chunked_array([pa.array([total.astype(np.float32).tobytes()], pa.binary())])], names=table.column_names)

    ddl = "fit int, block int, part int, n long, change binary"
    changes, left = rows.select("part", "fold", "label", "ids").mapInArrow(learn, ddl), parts
    while True:  # at most ``FEW`` parts are added up at a time
        changes = changes.groupBy("fit", "block", F.floor(F.col("part") / FEW).alias("few")).applyInArrow(add, ddl)
        left = -(-left // FEW)
        if left <= 1:
            break
    for r in changes.collect():
        _moved(fits[r["fit"]].model, {r["block"]: np.frombuffer(r["change"], np.float32).astype(np.float64) / max(r["n"], 1)})
    held.destroy()


def _thresholds(rows: DataFrame, model: Model, fits: list[Fit], least: int) -> dict[str, float]:
    """Thresholds from the logits of all rows, each by the model that was fitted without its fold: one for all (under ""), one
    for each language with examples enough. Rows are counted by cells of logits, so a task's share is bounded."""
    held = rows.sparkSession.sparkContext.broadcast((model, {one.without: one.model for one in fits}))

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teller, by_fold = held.value
        tables = {k: one.tables() for k, one in by_fold.items()}
        for batch, raws in slices(batches, "ids", 1 << 20):
            texts, folds = [pad(np.frombuffer(raw, np.int32).reshape(-1, 2)) for raw in raws], batch.column(1).to_numpy()
            z = np.zeros(len(texts))
            for k in set(folds.tolist()):
                some = np.flatnonzero(folds == k)
                z[some] = by_fold[k].logits([texts[i] for i in some], tables[k])
            yield pa.RecordBatch.from_arrays([pa.array([teller.tell(t) for t in texts], pa.string()), batch.column(0), pa.array(z, pa.float64())], names=["lang", "label", "z"])

    def cut(table: pa.Table) -> pa.Table:
        low, high, positive, count = [table[c].to_numpy() for c in ("low", "high", "positive", "count")]
        enough = not table["lang"][0].as_py() or min(positive.sum(), (count - positive).sum()) >= least
        return pa.table([pa.array([table["lang"][0].as_py()] if enough else [], pa.string()), pa.array([_cut(low, high, positive, count)] if enough else [], pa.float64())], names=["lang", "cut"])

    told = rows.select("label", "fold", "ids").mapInArrow(rate, "lang string, label int, z double").withColumn("lang", F.explode(F.array_distinct(F.array(F.lit(""), "lang"))))
    cell = F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("z"))) * CELLS)
    cells = told.groupBy("lang", cell.alias("cell")).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.sum(F.col("label").cast("double")).alias("positive"), F.count(F.lit(1)).cast("double").alias("count"))
    got = {r["lang"]: r["cut"] for r in cells.drop("cell").groupBy("lang").applyInArrow(cut, "lang string, cut double").collect()}
    held.destroy()
    return got


def train(docs: DataFrame, labels: DataFrame, training: Column, how: Training | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """A model from all labelled documents with ``training`` (a condition on the id) true; without examples of both labels
    one that calls nothing toxic.

    Null labels are left out, a repeated id counts once for a label. ``lang_col`` serves only to learn which words are
    frequent in a language."""
    how = how or Training()
    known = written(labels.filter(training & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("label")).distinct(), "labels")
    there = F.col("id") == F.col("of")
    both = {r["label"]: r["count"] for r in docs.select(F.col(id_col).alias("id")).join(small(known), there).groupBy("label").count().collect()}
    if len(both) < 2:
        forget(known)
        return _begun(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 0.5, how)
    parts = -(-sum(both.values()) // how.part)

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordRows()
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([hashed.of(raw).tobytes() for raw in texts], pa.binary())], names=[*batch.schema.names[1:], "ids"])

    dealt = {"rank": F.xxhash64("of"), "fold": F.pmod(F.xxhash64("of", F.lit(how.seed)), F.lit(how.folds)).cast("int"), "part": F.pmod(F.xxhash64("of"), F.lit(parts)).cast("int")}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).join(small(known), there)
    rows = rows.select("text", "label", "lang", *[c.alias(k) for k, c in dealt.items()]).mapInArrow(tokens, "label int, lang string, rank long, fold int, part int, ids binary")
    first = F.row_number().over(W.partitionBy("part", "rank", "label").orderBy(F.xxhash64("ids"), "lang"))
    rows = written(rows.repartitionById(parts, F.col("part")).withColumn("place", first).filter("place = 1").drop("place", "rank"), "labelled")
    forget(known)

    counts = written(_counted(rows), "counts")
    of = np.zeros((how.folds, 2, BUCKETS + 1))
    got = counts.filter("fold >= 0").select("fold", "label", "hash", "n").toArrow()
    of[got["fold"].to_numpy(), got["label"].to_numpy(), got["hash"].to_numpy()] = got["n"].to_numpy()
    sizes = np.zeros((how.folds, 2))
    for r in rows.groupBy("fold", "label").count().collect():
        sizes[r["fold"], r["label"]] = r["count"]
    per_pass = max(1, int(sizes.sum()) // (parts * how.batch))
    rounds = 1 if parts == 1 else how.epochs
    passes = -(-max(how.epochs, -(-how.least_steps // per_pass)) // rounds)
    fits = []
    for without in range(-1, how.folds):
        some = [k for k in range(how.folds) if k != without] or [0]
        seen, positive, n = of[some].sum(axis=(0, 1)), of[some, 1].sum(axis=0), sizes[some].sum(axis=0)
        share = float(min(max(n[1] / max(n.sum(), 1), 1e-3), 1 - 1e-3))
        steps = rounds * passes * max(1, -(-int(n.sum()) // (parts * how.batch)))
        fits.append(Fit(_begun(seen, positive, share, how), without, share, (seen / (seen + how.rare)).astype(np.float32), steps))
    for turn in range(rounds):
        _averaged(rows, fits, parts, passes, turn, rounds, how)
    model = fits[0].model
    model.languages, model.signs = _languages(counts, how.frequent)
    model.thresholds = _thresholds(rows, model, fits[1:], how.least_positives)
    forget(rows, counts)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row's id (and the columns ``keep``), ``score`` (0 to 1, 0.5 at the language's threshold) and ``predicted``.

    Whole texts are read. Null and empty texts have no word and get the score of none; repeated rows get the
    same score each; an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables, words = held.value, None, None
        for batch, texts in slices(batches, "__text", 1 << 20):
            tables, words = tables or model.tables(), words if words is not None else WordRows()
            p = model.scores([pad(words.of(raw)) for raw in texts], tables)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array(p >= 0.5, pa.bool_()).cast(pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])

    rows = docs.select(id_col, *(keep or []), F.col(text_col).alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(rate, f"{ddl}, score double, predicted int")


def remove(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; all columns stay, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables, words = held.value, None, WordRows()
        for batch, texts in slices(batches, text_col, 1 << 20):
            tables = tables or model.tables()
            yield batch.filter(pa.array(model.scores([pad(words.of(raw)) for raw in texts], tables) < 0.5))

    return docs.mapInArrow(clean, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
