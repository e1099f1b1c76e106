"""Fill-in-the-middle by run-length class encoding.

A text's units are whole runs of ASCII letters and single other characters, so its maximal runs of one
class (letters or not) say all: a run of letters is one unit however long, any other run has a unit for
each character. Runs are stored by their first character and the units before them, both cumulative; a
cut after k units is found by binary search of the run that holds it and, in a run of others, by adding
what is left of k. The units themselves are never made.

How a text is cut and laid out follows from a hash of its id alone, so it is the same wherever and in
whatever order rows are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Rates:
    """Of 100 texts, how many stay as they are, and of 100 others, how many have the suffix first."""

    plain: int = 10
    suffix_first: int = 20


class Runs:
    """The maximal character-class runs of a text, ``start`` and ``units`` being the characters and units before each,
    with the whole at the end."""

    def __init__(self, points: np.ndarray):
        lower = points | 0x20
        letter = (lower >= ord("a")) & (lower <= ord("z"))
        self.start = np.concatenate([[0], np.flatnonzero(letter[1:] != letter[:-1]) + 1, [len(points)]]) if len(points) else np.zeros(1, np.int64)
        length = np.diff(self.start)
        self.letters = letter[self.start[:-1]]
        self.units = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, length))])

    def __len__(self) -> int:
        return int(self.units[-1])

    def cut(self, k: int) -> int:
        """The characters of the first ``k`` units."""
        run = int(np.searchsorted(self.units, k, side="right")) - 1
        # a run of letters is never cut: k units end at its start or at its end
        return int(self.start[run] + k - self.units[run])


def draws(doc_id: object) -> list[int]:
    """The four numbers that decide about a document; a null id counts as an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: str, h: list[int], rates: Rates) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and the text in that form."""
    runs = Runs(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    n = len(runs)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - rates.plain:
        return n, "plain", None, None, text
    a, b = (runs.cut(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    first, middle, last = text[:a], text[a:b], text[b:]
    if h[3] % 100 < rates.suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{last}{PREFIX}{first}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{first}{SUFFIX}{last}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates | None = None) -> DataFrame:
    """(id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``) of each row.

    Form ``plain`` (the text as it is, no cuts) takes empty texts, texts that hold a mark and ``rates.plain`` of 100
    others; ``spm`` has the suffix first, ``psm`` the prefix. Null text: empty, so plain. A null id counts as an empty
    one; repeated rows are treated alike, each on its own; texts of any length are cut whole; other columns are not read."""
    rates = rates or Rates()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            rows = [arranged((raw or b"").decode("utf-8", "replace"), draws(i), rates) for i, raw in zip(ids, texts, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output in a form stands for. The three parts hold no mark, so the marks part them."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    whole = output
    for name, places in order.items():
        whole = F.when(form == name, F.concat(*(F.get(parts, F.lit(i)) for i in places))).otherwise(whole)
    return whole
