"""Quality by weak labels: heuristic labellers, a label model, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a text. Expectation-maximisation over the counts of the vote patterns
of all documents (few numbers, whatever the corpus) estimates how often each labeller says what about good and
bad texts, and gives every pattern a posterior. A linear scorer over hashed words and word shapes is trained
on the posteriors of a bounded sample, and scores all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_ranked, slices
from .quality_rules import counters

BAD, NONE, GOOD = 0, 1, 2
UPPER, LETTERS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
#: Labellers that know one kind of bad text: bad above the limit, else no vote.
ABOVE = {"symbols": 0.04, "capitals": 0.35, "bars": 0.2, "shouting": 0.15, "repeats": 0.3, "same lines": 0.3, "digits": 0.12}
#: Labellers with two views -> (bad below, good above).
BELOW = {"words": (40, 90), "short words": (0.08, 0.2), "sentences": (0.01, 0.03)}
LABELLERS = [*ABOVE, *BELOW]


def measures(raw: bytes) -> dict[str, float]:
    """What the labellers look at, of a text in UTF-8. Shares are of words or characters."""
    n, chars, symbols, dup_lines, repeats = counters(raw)
    words = raw.split()
    count = lambda keep: len(raw) - len(raw.translate(None, keep))
    upper, lower = count(UPPER), count(LETTERS)
    lines = sum(1 for x in raw.split(b"\n") if x.strip())
    return {
        "symbols": symbols / max(chars, 1),
        "capitals": upper / max(upper + lower, 1),
        "bars": raw.count(b"|") / max(n, 1),
        "shouting": raw.count(b"!") / max(n, 1),
        "repeats": repeats / max(n, 1),
        "same lines": dup_lines / max(lines, 1),
        "digits": count(DIGITS) / max(chars, 1),
        "words": n,
        "short words": sum(len(w) <= 3 for w in words) / max(n, 1),
        "sentences": (raw.count(b".") + raw.count(b"?")) / max(n, 1),
    }


def votes(raw: bytes) -> list[int]:
    m = measures(raw)
    high = [BAD if m[k] > bad else NONE for k, bad in ABOVE.items()]
    return high + [BAD if m[k] < bad else GOOD if m[k] > good else NONE for k, (bad, good) in BELOW.items()]


def pattern(vote: list[int]) -> int:
    code = 0
    for v in vote:
        code = code * 3 + v
    return code


def unpacked(codes: np.ndarray) -> np.ndarray:
    """The votes of each pattern."""
    return np.stack([codes // 3**k % 3 for k in range(len(LABELLERS) - 1, -1, -1)], axis=1) if len(codes) else np.empty((0, len(LABELLERS)), np.int64)


@dataclass
class LabelModel:
    """prior: share of good texts. says[class][labeller][vote]: probability of the vote."""

    prior: float
    says: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern."""
        v = unpacked(np.asarray(codes, np.int64))
        logs = np.stack([np.log(self.says[c][np.arange(len(LABELLERS)), v]).sum(axis=1) for c in (0, 1)])
        gap = logs[1] - logs[0] + np.log(self.prior) - np.log(1 - self.prior)
        return 1 / (1 + np.exp(-np.clip(gap, -40, 40)))


def fit_label_model(codes: np.ndarray, counts: np.ndarray, passes: int = 200, prior: float = 0.85, strength: float = 50.0) -> LabelModel:
    """Expectation-maximisation, begun from labellers that seldom call a good text bad. That belief counts as
    ``strength`` texts of each class, whatever their number, so it names the classes and fades as texts come in."""
    v, n = unpacked(np.asarray(codes, np.int64)), np.asarray(counts, np.float64)
    start = np.empty((2, len(LABELLERS), 3))
    start[0, : len(ABOVE)], start[1, : len(ABOVE)] = [0.12, 0.879, 0.001], [0.001, 0.998, 0.001]
    start[0, len(ABOVE) :], start[1, len(ABOVE) :] = [0.15, 0.3, 0.55], [0.02, 0.28, 0.7]
    model = LabelModel(prior, start)
    for _ in range(passes if len(n) else 0):
        good = model.posterior(codes)
        new = np.empty_like(start)
        for c, p in ((0, 1 - good), (1, good)):
            for j in range(len(LABELLERS)):
                new[c, j] = np.bincount(v[:, j], p * n, 3) + start[c, j] * strength
        new /= new.sum(axis=2, keepdims=True)
        moved = np.abs(new - model.says).max()
        model = LabelModel(float(np.clip((good * n).sum() / n.sum(), 0.02, 0.98)), new)
        if moved < 1e-6:
            break
    return model


SHAPE = re.compile(r"(.)\1+")


class Features(dict):
    """word (UTF-8) -> (bucket of the word, bucket of its shape) as one number. Emptied when it holds ``limit`` words."""

    SIZE = 1 << 18

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        text = word.decode("utf-8", "replace")
        shape = SHAPE.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text))
        code = xxhash.xxh32_intdigest(text.lower()) % self.SIZE * self.SIZE + xxhash.xxh32_intdigest("shape " + shape) % self.SIZE
        self[word] = code
        return code

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = raw.split()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return codes // self.SIZE, codes % self.SIZE


@dataclass
class Scorer:
    """Weights of the hashed words and shapes; a text's logit is their mean over its words, and the bias."""

    word: np.ndarray
    shape: np.ndarray
    bias: float

    def score(self, features: tuple[np.ndarray, np.ndarray]) -> float:
        w, s = features
        z = self.bias + (float(self.word[w].mean() + self.shape[s].mean()) if len(w) else float(self.shape[0]))
        return 1 / (1 + np.exp(-min(max(z, -40.0), 40.0)))


def fit_scorer(texts: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> Scorer:
    """Logistic regression on soft labels by Adagrad. ``shape[0]`` also stands for the text without a word."""
    scorer = Scorer(np.zeros(Features.SIZE, np.float32), np.zeros(Features.SIZE, np.float32), 0.0)
    sums = [np.full(Features.SIZE, 1e-6, np.float32) for _ in range(2)]
    bias_sum, rng = 1e-6, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            w, s = texts[i]
            gap = scorer.score((w, s)) - targets[i]
            bias_sum += gap * gap
            scorer.bias -= rate * 0.1 * gap / np.sqrt(bias_sum)
            for weights, sq, at in ((scorer.word, sums[0], w), (scorer.shape, sums[1], s if len(s) else np.zeros(1, np.int64))):
                if len(at):
                    where, n = np.unique(at, return_counts=True)
                    grad = (gap * n / len(at)).astype(np.float32)
                    sq[where] += grad * grad
                    weights[where] -= rate * grad / np.sqrt(sq[where])
    return scorer


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000, sample_bytes: int = 64 << 20, limit: float = 0.5) -> DataFrame:
    """Each row's id, ``n_votes`` (labellers that voted), ``posterior`` (of the label model), ``score`` (of the scorer,
    probability of good) and ``kept`` (score >= limit).

    Null and empty texts are texts without a word and are scored like others. The scorer is fitted on at most
    ``sample`` documents of together at most ``sample_bytes``, those of the smallest hashes; the label model on all. Repeated rows count and
    score each; an empty table gives an empty result."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for _, texts in slices(batches, "text"):
            found.update(pattern(votes(x or b"")) for x in texts)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], names=["pattern", "n"])

    counts = rows.select("text").mapInArrow(count, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()  # at most 3 ** 10 rows
    model = fit_label_model(counts["pattern"].to_numpy(), counts["n"].to_numpy())
    chosen = least_ranked(rows, F.xxhash64("id", "text"), sample, F.octet_length("text"), sample_bytes).select("text").toPandas()
    features = Features()
    raws = [(t or "").encode() for t in chosen["text"]]
    targets = model.posterior(np.array([pattern(votes(r)) for r in raws], np.int64))
    held = context.broadcast((model, fit_scorer([features.of(r) for r in raws], targets)))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (label_model, scorer), words = held.value, Features()
        for batch, texts in slices(batches, "text"):
            codes = [votes(x or b"") for x in texts]
            posterior = label_model.posterior(np.array([pattern(v) for v in codes], np.int64))
            scores = [scorer.score(words.of(x or b"")) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sum(k != NONE for k in v) for v in codes], pa.int32()), pa.array(posterior, pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= limit for s in scores], pa.bool_())],
                names=["id", "n_votes", "posterior", "score", "kept"],
            )

    return rows.mapInArrow(judge, f"id {kind}, n_votes int, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)
