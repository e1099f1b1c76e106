"""Language-model scoring by a hidden Markov model over words.

Word counts of the whole training part give the base model. The hidden Markov model emits symbols: the most
frequent words, an end mark, and one symbol for each class of other words (by a hash of their endings); a class
spreads its mass over its words by their counts, so every word has a probability and the tables that the tasks
need stay bounded while the counts grow with the corpus. Baum-Welch passes read all training documents whole: tasks sum
expected counts, Spark adds them up, the driver normalises, until the likelihood hardly grows. Scores are exact sequence likelihoods by the
scaled forward recursion over whole texts.

Counts of words outside the bounded table are fetched by a join on the word's hash and summed by document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_ranked, slices, written


@dataclass(frozen=True)
class Settings:
    """known: words whose counts go to the tasks; words: those that are symbols; classes: of all other words.
    warm_docs, of at most warm_bytes, and warm_passes: a start on few documents, before the passes over all, which
    end once the log likelihood grows by less than ``least_gain`` of itself, at the latest after ``passes``."""

    known: int = 65_536
    words: int = 8192
    classes: int = 256
    states: int = 8
    warm_docs: int = 500
    warm_bytes: int = 16 << 20
    warm_passes: int = 20
    passes: int = 3
    least_gain: float = 1e-3
    stay: float = 0.9
    prior: float = 2000.0
    seed: int = 11


def word_hash(word: bytes) -> int:
    """Signed 64-bit hash of a word in UTF-8."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


def word_class(word: bytes, classes: int) -> int:
    """Class of a word: a hash of its last three bytes."""
    return xxhash.xxh32_intdigest(word[-3:]) % classes


def count_words(texts: DataFrame, classes: int, flush: int = 300_000) -> DataFrame:
    """(word, class, n) summed over ``texts`` (text); words by hash. A task sends sums, not tokens."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = [pa.array([word_hash(w) for w in sums], pa.int64()), pa.array([word_class(w, classes) for w in sums], pa.int32()), pa.array(sums.values(), pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "class", "n"])

        for _, raws in slices(batches, "text"):
            for raw in raws:
                sums.update((raw or b"").lower().split())
            if len(sums) > flush:
                yield rows()
        yield rows()

    return texts.mapInArrow(count, "word long, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The bounded part of the counts: ``index`` of the known words (by hash), log10(count + 1) and symbol of each,
    the classes' denominators, and the totals."""

    index: dict[int, int]
    logs: np.ndarray
    symbols: np.ndarray
    class_logs: np.ndarray
    unigram: np.ndarray
    tokens: int
    types: int
    documents: int
    settings: Settings

    @property
    def end(self) -> int:
        return self.settings.words + self.settings.classes


def vocabulary(counts: DataFrame, documents: int, how: Settings) -> Vocabulary:
    """The known words are the ``how.known`` most frequent; of the words of the last count, a part by their hashes."""
    by_count = [(r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(how.known).collect()]
    total, wanted = 0, F.lit(False)
    for n, k in by_count:
        room, total = how.known - total, total + k
        if total > how.known:
            wanted = wanted | ((F.col("n") == n) & (F.col("word") < int(-(2**63) + min(room / k, 1.0) * (2**64 - 1))))
            break
        wanted = F.col("n") >= n
    best = counts.filter(wanted).collect()
    best.sort(key=lambda r: (-r["n"], r["word"]))
    best = best[: how.known]  # hashes are even, not exact
    sums = {r["class"]: (r["n"], r["k"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    mass, types = np.zeros(how.classes), np.zeros(how.classes)
    for c, (n, k) in sums.items():
        mass[c], types[c] = n, k
    tokens, kinds = int(mass.sum()) + documents, int(types.sum()) + (documents > 0)
    for r in best[: how.words]:
        mass[r["class"]] -= r["n"]
        types[r["class"]] -= 1
    n = np.array([r["n"] for r in best], np.float64)
    symbols = np.array([i if i < how.words else how.words + r["class"] for i, r in enumerate(best)], np.int32)
    uni = np.zeros(how.words + how.classes + 1)
    uni[: min(len(best), how.words)] = n[: how.words]
    uni[how.words : -1] = mass
    uni[-1] = documents
    uni += 0.5
    return Vocabulary({r["word"]: i for i, r in enumerate(best)}, np.log10(n + 1), symbols, np.log10(mass + types + 1), uni / uni.sum(), tokens, kinds, documents, how)


class _Codes(dict):
    """word -> its known index, or ``known`` plus its class. Emptied when it holds ``limit`` words."""

    def __init__(self, vocab: Vocabulary, limit: int = 300_000):
        super().__init__()
        self.vocab, self.limit = vocab, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        how = self.vocab.settings
        code = self.vocab.index.get(word_hash(word))
        code = how.known + word_class(word, how.classes) if code is None else code
        self[word] = code
        return code


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """A row a document: id, held_out, n_tokens, the sums over its known words, its symbols and the hashes of its
    other words (one for each token)."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, codes = held.value, None
        known, words = v.settings.known, v.settings.words
        logs = np.concatenate([v.logs, np.zeros(known - len(v.logs) + v.settings.classes)])
        symbols = np.concatenate([v.symbols, np.zeros(known - len(v.symbols), np.int32), words + np.arange(v.settings.classes, dtype=np.int32)])
        end_log = np.log10(v.documents + 1)
        for batch, texts in slices(batches, "text"):
            codes = codes if codes is not None else _Codes(v)
            out: list[list] = [[] for _ in range(7)]
            for raw in texts:
                tokens = (raw or b"").lower().split()
                c = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
                s, log, other = symbols[c], logs[c], np.flatnonzero(c >= known)
                in_class = s >= words
                row = (
                    len(tokens) + 1,
                    len(tokens) - len(other) + (v.documents > 0),
                    float(log.sum() + end_log),
                    float(log[in_class].sum()),
                    float(v.class_logs[s[in_class] - words].sum()),
                    np.append(s, v.end).astype(np.uint16).tobytes(),
                    [word_hash(tokens[i]) for i in other.tolist()],
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["id", "held_out", "n_tokens", "n_known", "logs", "class_known", "class_logs", "symbols", "others"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(code, f"id {kind}, held_out boolean, n_tokens long, n_known long, logs double, class_known double, class_logs double, symbols binary, others array<long>")
    return written(out.withColumn("row", F.monotonically_increasing_id()), "encoded")


@dataclass
class Hmm:
    """Start and transition probabilities, and emissions (symbols x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(vocab: Vocabulary) -> Hmm:
        how, k = vocab.settings, vocab.settings.states
        rng = np.random.default_rng(how.seed)
        emit = vocab.unigram[:, None] * rng.gamma(2.0, 0.5, (len(vocab.unigram), k))
        move = np.full((k, k), (1 - how.stay) / max(k - 1, 1))
        np.fill_diagonal(move, how.stay if k > 1 else 1.0)
        return Hmm(np.full(k, 1 / k), move, emit / emit.sum(axis=0))

    def expected(self, texts: list[np.ndarray], stretch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions over whole ``texts`` (none empty), and their log likelihood,
        by the scaled forward and backward recursions, the texts side by side, longest first.

        Forward states are kept at the start of every stretch of tokens only, and computed again from there when the way
        back needs them, so the memory for a text of n tokens and k states is about n * (1 + k / stretch)."""
        k = len(self.start)
        texts = sorted(texts, key=len, reverse=True)
        size = np.array([len(t) for t in texts])
        flat, begin = np.concatenate(texts), np.cumsum(size) - size
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right").tolist()
        scales, borders = [None] * len(live), {}

        def step(t: int, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            n = live[t]
            a = (self.start if a is None else a[:n] @ self.move) * self.emit[flat[begin[:n] + t]]
            scale = a.sum(axis=1)
            return a / scale[:, None], scale

        a, total = None, 0.0
        for t in range(len(live)):
            if t % stretch == 0:
                borders[t] = a
            a, scales[t] = step(t, a)
            total += float(np.log(scales[t]).sum())
        moves, emits = np.zeros((k, k)), np.zeros_like(self.emit)
        beta = np.ones((len(texts), k))
        for first in range((len(live) - 1) // stretch * stretch, -1, -stretch):
            last = min(first + stretch, len(live))
            a, alphas = borders.pop(first), []
            for t in range(first, last):
                a, _ = step(t, a)
                alphas.append(a)
            symbols, states = [], []
            for t in range(last - 1, first - 1, -1):
                n, alpha = live[t], alphas[t - first]
                if t + 1 < len(live):
                    m = live[t + 1]
                    ahead = self.emit[flat[begin[:m] + t + 1]] * beta[:m] / scales[t + 1][:, None]
                    moves += alpha[:m].T @ ahead
                    beta[:m] = ahead @ self.move.T
                symbols.append(flat[begin[:n] + t])
                states.append(alpha * beta[:n])
            symbols, states_ = np.concatenate(symbols), np.concatenate(states)
            for s in range(k):
                emits[:, s] += np.bincount(symbols, states_[:, s], len(self.emit))
        return states[-1].sum(axis=0), moves * self.move, emits, total

    def improved(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, vocab: Vocabulary) -> Hmm:
        """The model of expected counts, smoothed towards the unigram distribution."""
        emits = emits + vocab.settings.prior * vocab.unigram[:, None] * min(1.0, max(emits.sum(), 1.0) / 1e6)
        moves, starts = moves + 1e-2, starts + 1e-2
        return Hmm(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))

    def log10_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each sequence by the scaled forward recursion, longest first, side by side."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        size = np.array([len(texts[i]) for i in order])
        flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        total = np.zeros(len(order))
        a = np.tile(self.start, (len(order), 1))
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        for t, n in enumerate(live.tolist()):
            a = a[:n] @ self.move if t else a
            a = a * self.emit[flat[begin[:n] + t]]
            s = a.sum(axis=1)
            total[:n] += np.log10(s)
            a /= s[:, None]
        out = np.empty(len(order))
        out[order] = total
        return out


def _symbols(raws: list) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in raws]


def baum_welch(encoded: DataFrame, vocab: Vocabulary) -> Hmm:
    """The trained model: warm passes over few documents, then passes over all training rows of ``encoded``, each text a
    sequence, until the likelihood hardly grows."""
    how, context = vocab.settings, encoded.sparkSession.sparkContext
    hmm = Hmm.first(vocab)
    training = encoded.filter(~F.col("held_out"))
    few = least_ranked(training.select("id", "row", "symbols"), F.xxhash64("id", "row"), how.warm_docs, F.octet_length("symbols"), how.warm_bytes).select("symbols").collect()
    warm = _symbols([r["symbols"] for r in few])
    if not warm:
        return hmm
    for _ in range(how.warm_passes):
        starts, moves, emits, _ = hmm.expected(warm)
        hmm = hmm.improved(starts, moves, emits, vocab)
    k, n, before = how.states, len(vocab.unigram), None
    for _ in range(how.passes):
        held = context.broadcast(hmm)

        def expect(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(1 + k + k * k + n * k)
            for _, raws in slices(batches, "symbols", 6 << 20):
                starts, moves, emits, gain = held.value.expected(_symbols(raws))
                sums += np.concatenate([[gain], starts, moves.ravel(), emits.ravel()])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["at", "value"])

        sums = np.zeros(1 + k + k * k + n * k)
        added = training.select("symbols").mapInArrow(expect, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        sums[added["at"].to_numpy()] = added["value"].to_numpy()
        likelihood, sums = sums[0], sums[1:]
        hmm = hmm.improved(sums[:k], sums[k : k + k * k].reshape(k, k), sums[k + k * k :].reshape(n, k), vocab)
        held.unpersist()
        if before is not None and likelihood - before < how.least_gain * abs(before):
            break
        before = likelihood
    return hmm


def score(docs: DataFrame, held_out: Column, how: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``held_out`` (a condition) names the rows that are not learned from. A null text is the empty one: one end
    token. With no training row every probability comes from the smoothing alone. Repeated rows count and score
    each; a null id is a value like any other; an empty table gives an empty result."""
    how = how or Settings()
    rows = docs.select(id_col, F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("__held"))
    training = rows.filter(~F.col("__held"))
    counts = written(count_words(training.select("text"), how.classes), "counts")
    vocab = vocabulary(counts, training.count(), how)
    encoded = encode(rows, vocab, id_col, "text", F.col("__held"))
    held = docs.sparkSession.sparkContext.broadcast(baum_welch(encoded, vocab))

    def forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in slices(batches, "symbols"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held.value.log10_likelihood(_symbols(raws)))], names=[*batch.schema.names[:-1], "log_p"])

    part = encoded.select("row", "id", "held_out", "n_tokens", "n_known", "logs", "class_known", "class_logs", "symbols")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1])
    scored = part.mapInArrow(forward, f"{ddl}, log_p double")
    tokens = encoded.select(F.col("row").alias("of"), F.explode("others").alias("token"))
    found = tokens.join(counts.select("word", F.log10(F.col("n") + 1).alias("log")), F.col("token") == F.col("word"))
    found = found.groupBy("of").agg(F.sum("log").alias("other_logs"), F.count(F.lit(1)).alias("others_known"))
    out = scored.join(found, F.col("row") == F.col("of"), "left")
    more, known = F.coalesce("other_logs", F.lit(0.0)), F.coalesce("others_known", F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + known).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * float(np.log10(vocab.tokens + vocab.types + 1))).alias("base_score"),
        (F.col("log_p") + F.col("class_known") + more - F.col("class_logs")).alias("score"),
    )
