"""Byte-level BPE by recursive queries of DuckDB, one small database for each worker.

Texts are cut by the vocabulary's pattern. The words that a worker has not seen lately become rows
(word, position, token), a token for each byte, and a recursive query joins neighbouring tokens with
the merge table: each round contracts every word's pair of the least rank (the leftmost of equal
ones), until none can be merged. Word and position are one number, so that a round sorts once. A word that is a token itself has that one id. The merge table
comes from the ranks: every cut of a token into two tokens. Decoding joins ids with the vocabulary
and puts the bytes together by ordered aggregation.

A round reads a word's rows once and takes away one of them, so a word of n bytes costs about n * n
row visits. Words of over ``LONG`` characters (lines of dashes, sequences of letters, encoded files) are
therefore merged by a heap of their pairs, in the same order of rank and place.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Characters from which a word's pairs are merged by a heap.
LONG = 1000
#: Characters of words in one recursive query, and tokens of a text in one group of the decoding query.
BLOCK, GROUP = 768 << 10, 4096
_BOOKS: dict[str, _Book] = {}

VOCABULARY = "CREATE TABLE vocabulary AS SELECT id, bytes FROM given ORDER BY id"
MERGES = """CREATE TABLE merges AS
WITH cuts AS (SELECT id, bytes, unnest(range(1, length(bytes))) AS k FROM vocabulary)
SELECT a.id AS first, b.id AS second, cuts.id AS merged
FROM cuts JOIN vocabulary a ON a.bytes = left(cuts.bytes, k) JOIN vocabulary b ON b.bytes = substr(cuts.bytes, k + 1)"""
ENCODE = """WITH RECURSIVE state(spot, token, final) AS (
    SELECT word::BIGINT << 32 | pos, v.id, false
    FROM (SELECT word, bytes, unnest(range(1, length(bytes) + 1)) AS pos FROM words) w JOIN vocabulary v ON v.bytes = w.bytes[pos]
  UNION ALL (
    WITH near AS (
      SELECT spot, token, lead(token) OVER line AS next_token, lead(spot) OVER line AS next_spot, lag(spot) OVER line AS last_spot
      FROM state WHERE NOT final WINDOW line AS (ORDER BY spot)),
    pairs AS (
      SELECT near.*, merged
      FROM near LEFT JOIN merges ON first = token AND second = next_token AND next_spot >> 32 = spot >> 32),
    least AS (
      SELECT spot >> 32 AS word, min(merged::BIGINT << 32 | (spot & 4294967295)) AS found
      FROM pairs WHERE merged IS NOT NULL GROUP BY spot >> 32),
    chosen AS (SELECT word << 32 | (found & 4294967295) AS place, word, (found >> 32)::INTEGER AS merged FROM least)
    SELECT spot, CASE WHEN spot = place THEN chosen.merged ELSE token END, place IS NULL
    FROM pairs LEFT JOIN chosen ON spot >> 32 = word
    WHERE place IS NULL OR last_spot IS DISTINCT FROM place))
SELECT spot >> 32 AS word, token FROM state WHERE final ORDER BY spot"""
DECODE = """SELECT part, array_to_string(list(bytes ORDER BY pos), '') AS bytes
FROM tokens JOIN vocabulary ON id = token GROUP BY part ORDER BY part"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a line for each token, its bytes in base64 and its rank."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Book:
    """A vocabulary with its database. DuckDB has strings, not bytes, to cut and to put together: a byte is the
    character of its number (U+0000 to U+00FF)."""

    def __init__(self, path: str, keep: int = 64 << 20):
        import duckdb

        self.ranks = read_ranks(path)
        # memory only: nothing may be left in an executor's own folders
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self._given("given", id=pa.array(self.ranks.values(), pa.int32()), bytes=pa.array([t.decode("latin-1") for t in self.ranks]))
        self.db.execute(VOCABULARY)
        self.db.unregister("given")
        self.merges = False
        self.keep, self.size, self.young, self.old = keep, 0, {}, {}

    def _given(self, name: str, **columns: pa.Array) -> None:
        self.db.register(name, pa.table(columns))

    def _contract(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        """The ids of words, by the recursive query."""
        if not self.merges:
            self.db.execute(MERGES)
            self.merges = True
        self._given("words", word=pa.array(range(len(words)), pa.int32()), bytes=pa.array([w.encode().decode("latin-1") for w in words]))
        got = self.db.sql(ENCODE).to_arrow_table()
        ids = got["token"].to_numpy().astype("<u4").tobytes()
        ends = np.searchsorted(got["word"].to_numpy(), np.arange(len(words)), side="right") * 4
        return zip(words, map(ids.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True)

    def _heaped(self, word: bytes) -> bytes:
        """The ids of one long word, by a heap of its pairs."""
        part, after = [word[i : i + 1] for i in range(len(word))], [*range(1, len(word)), None]
        before = [None, *range(len(word) - 1)]
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int | None) -> None:
            if i is not None and after[i] is not None and (rank := self.ranks.get(whole := part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, whole))

        for i in range(len(word)):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            gone = after[i]
            if part[i] is None or gone is None or part[i] + part[gone] != whole:
                continue  # one of the two has been merged since
            part[i], part[gone], after[i] = whole, None, after[gone]
            if after[i] is not None:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        ids = [self.ranks[p] for p in part if p is not None]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """word -> its ids as little-endian unsigned 32-bit integers, of these words at least. What is used again stays,
        in two generations of bounded size."""
        if self.size > self.keep:
            self.old, self.young, self.size = self.young, {}, 0
        new = words - self.young.keys()
        self._keep([(w, self.old[w]) for w in new & self.old.keys()])
        new -= self.old.keys()
        self._keep([(w, struct.pack("<I", rank)) for w in new if (rank := self.ranks.get(w.encode())) is not None])
        self._keep([(w, self._heaped(w.encode())) for w in new if len(w) > LONG])
        todo = list(new - self.young.keys())
        blocks = np.cumsum([len(w) for w in todo]) // BLOCK
        for at in np.split(np.arange(len(todo)), np.flatnonzero(np.diff(blocks)) + 1):
            if len(at):
                self._keep(self._contract(todo[at[0] : at[-1] + 1]))
        return self.young

    def _keep(self, found: Iterable[tuple[str, bytes]]) -> None:
        found = dict(found)
        self.young |= found
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + 160 * len(found)

    def decoded(self, streams: list[bytes]) -> list[bytes]:
        """The bytes of each stream of ids."""
        token = np.frombuffer(b"".join(streams), "<u4").astype(np.int64)
        n = np.array([len(s) // 4 for s in streams], np.int64)
        pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        groups = -(-n // GROUP)
        part = np.repeat(np.cumsum(groups) - groups, n) + pos // GROUP
        self._given("tokens", part=pa.array(part), pos=pa.array(pos), token=pa.array(token))
        texts = iter(self.db.sql(DECODE).to_arrow_table()["bytes"].to_pylist())
        return [b"".join(t.encode("latin-1") for t in islice(texts, k)) for k in groups.tolist()]


def _book(path: str) -> _Book:
    """The worker's vocabulary; a reused worker keeps it from task to task."""
    if path not in _BOOKS:
        _BOOKS[path] = _Book(path)
    return _BOOKS[path]


def _batches(matches: Iterator, most: int) -> Iterator[list[str]]:
    while words := [m.group() for m in islice(matches, most)]:
        yield words


def _pieces(texts: list[bytes | None], pattern, most: int = 1 << 18) -> Iterator[list[tuple[int, list[str]]]]:
    """The words of texts with the text's number, some ``most`` words at a time."""
    piece, size = [], 0
    for i, raw in enumerate(texts):
        text = (raw or b"").decode("utf-8", "replace")
        # a text of so many characters at most has no more words
        found = iter([pattern.findall(text)]) if len(text) <= most else _batches(pattern.finditer(text), most)
        for words in found:
            piece.append((i, words))
            size += len(words)
            if size >= most:
                yield piece
                piece, size = [], 0
    if piece:
        yield piece


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(id, ``ids``): each text's token ids, little-endian unsigned 32-bit integers in one binary value, as the ranks in
    the file ``ranks`` give them for each match of ``pattern`` apart. No special tokens; text that no match covers has no ids;
    the pattern has no groups.
    With ``back`` also ``bytes``, which ``decode`` would give for these ids, by the same worker and its one vocabulary.

    Null or empty text: no ids (an empty value). Null ids and repeated rows stay, each on its own; other columns are
    not read. Long texts are cut into words a piece at a time; a word of any length is encoded whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        book, words = _book(ranks), regex.compile(pattern)
        for batch, texts in slices(batches, "text", 4 << 20):
            ids = [[] for _ in texts]
            for piece in _pieces(texts, words):
                known = book.learn(set().union(*(found for _, found in piece)))
                for i, found in piece:
                    ids[i].append(b"".join(map(known.__getitem__, found)))
            streams = [b"".join(x) for x in ids]
            more = [pa.array(book.decoded(streams), pa.binary())] * back
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(streams, pa.binary()), *more], names=["id", "ids", "bytes"][: 2 + back])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary" + ", bytes binary" * back).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, ``bytes``): the bytes that each row's ids stand for, in their order.

    Null or empty ids: no bytes (an empty value). An id that the vocabulary does not have is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(ranks)
        known = np.fromiter(book.ranks.values(), np.int64)
        for batch, streams in slices(batches, "ids"):
            streams = [s or b"" for s in streams]
            if len(strange := np.setdiff1d(np.frombuffer(b"".join(streams), "<u4"), known)):
                raise ValueError(f"ids that the vocabulary does not have: {strange[:5].tolist()}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(book.decoded(streams), pa.binary())], names=["id", "ids", "bytes"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {tokens.schema[id_col].dataType.simpleString()}, ids binary, bytes binary").withColumnsRenamed({"id": id_col, "ids": ids_col})
