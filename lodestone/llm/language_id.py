"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams in order; a document's own list is
compared with each profile by the out-of-place distance: for each n-gram of the document the difference
of its two ranks, or the full length for one the profile lacks. The nearest profile names the language.
Counts of the profiles cover every training document; each task sends only its summed counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

UNKNOWN = "und"
#: Bound of the profiles sent to the tasks: languages times n-grams.
MOST_LANGUAGES = 2000


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is not a letter."""
    table = np.zeros(0x110000, np.int32)
    for cp in range(0x30000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_TABLE: list[np.ndarray] = []


def letters(raw: bytes) -> np.ndarray:
    """Code points of the lower-cased letters; each run of anything else is one 0; one 0 at either end."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    low = np.concatenate([[0], _TABLE[0][points], [0]]).astype(np.int64)
    keep = (low[1:] != 0) | (low[:-1] != 0)
    return np.concatenate([low[:1], low[1:][keep]])


def gram_counts(points: np.ndarray, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of one text, n from 1 to 3 in 21 bits a letter. A word's edge is a 0, as in " the ";
    n-grams that are all edge, or hold one inside, are left out."""
    parts = [points[points != 0]]
    if longest >= 2:
        a, b = points[:-1], points[1:]
        pair = (a << 21) | b
        parts.append(pair[(a != 0) | (b != 0)] | 1 << 42 if len(pair) else pair)
    if longest >= 3 and len(points) > 2:
        a, b, c = points[:-2], points[1:-1], points[2:]
        # the top letter is at least 1 where a letter begins the n-gram; an edge gets a mark of its own
        triple = (((a + 2) << 42) | (b << 21) | c)[b != 0]
        parts.append(triple)
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams in order; ties by n-gram."""
    if len(counts) > top:  # all that tie with the last one stay until the sort
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:top]


@dataclass(frozen=True)
class Profiles:
    """Languages and their n-grams in order of rank."""

    languages: list[str]
    grams: list[np.ndarray]
    top: int

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted n-grams of any profile, and a row of ranks for each (``top`` where a profile lacks it)."""
        known = np.unique(np.concatenate(self.grams)) if self.grams else np.empty(0, np.int64)
        ranks = np.full((len(known), len(self.languages)), self.top, np.int32)
        for k, grams in enumerate(self.grams):
            ranks[np.searchsorted(known, grams), k] = np.arange(len(grams))
        return known, ranks

    def distances(self, own: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Out-of-place distance of a ranked list to each profile."""
        known, ranks = table
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        found = known[at] == own
        place = np.arange(len(own))[:, None]
        return np.where(found[:, None], np.where(ranks[at] == self.top, self.top, np.abs(ranks[at] - place)), self.top).sum(axis=0)


def learn(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", top: int = 400, flush: int = 200_000) -> Profiles:
    """Profiles of all languages of the rows with ``training`` true and a language.

    All their texts count. A task keeps sums by language and n-gram and sends them when it has ``flush`` of
    them and at its end; only the ``top`` of each language reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            found = [(lang, g, n) for lang, c in sums.items() for g, n in c.items()]
            langs, grams, counts = zip(*found, strict=True) if found else ((), (), ())
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

        for batch, texts in slices(batches, "text"):
            by: dict[str, list[np.ndarray]] = {}
            for lang, raw in zip(batch.column(1).to_pylist(), texts, strict=True):
                by.setdefault(lang, []).append(letters(raw or b""))
            for lang, points in by.items():
                grams, counts = gram_counts(np.concatenate(points))
                into = sums.setdefault(lang, Counter())
                for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                    into[g] += n
            if sum(map(len, sums.values())) > flush:
                yield rows()
        yield rows()

    rows = docs.filter(training & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in best.limit(MOST_LANGUAGES * top + 1).collect():
        found.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(found)
    return Profiles(names, [np.array([g for _, g in sorted(found[x])], np.int64) for x in names], top)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row's id (and the columns ``keep``), ``lang_pred`` and ``score``: how much nearer the best profile is than
    the next, over the latter's distance (0: a tie; 1: no distance at all).

    A text that is null or has no letter is ``und`` with score 0, as is every text if no profile was learned;
    ties go to the first language in order. Repeated rows get the same answer each."""
    keep = keep or []

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = profiles.table()
        for batch, texts in slices(batches, "__text"):
            langs, scores = [], []
            for raw in texts:
                points = letters(raw or b"")
                if not points.any() or not profiles.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                far = profiles.distances(ranked(*gram_counts(points), profiles.top), table)
                order = np.argsort(far, kind="stable")
                langs.append(profiles.languages[order[0]])
                second = float(far[order[1]]) if len(order) > 1 else float(far[order[0]]) + 1.0
                scores.append((second - float(far[order[0]])) / second if second else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(id_col, *keep, F.col(text_col).alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(name, f"{ddl}, lang_pred string, score double")
