"""Packing by power-of-two decomposition.

A document of n tokens is cut along the binary form of n: whole pieces of ``max_len``, then one
piece for each set bit of the rest, largest first. Every piece is a sequence of its own, equal
lengths are numbered together (a batch of one bucket has one shape), no sequence crosses
documents and no token is padding.

Tokenising runs in Arrow batches beside the JVM. A word between ASCII blanks has the same ids
wherever it stands, so each worker keeps the ids of the words it has seen, in two generations of
bounded bytes. Most words are a run of letters and some punctuation; where the vocabulary's own
definition proves that the two are tokenised apart, letters are kept once for all their
capitalisations and endings, and only they are asked of the model.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, slices, written

_CACHES: dict[str, _WordIds] = {}

#: The parts of a vocabulary's definition under which a run of letters is a piece of its own.
LOWER_CASE = ["NFC", "Replace", "Lowercase"]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that are composed already, and punctuation that no contraction begins with.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{-~]*)")


def letters_stand_apart(definition: dict) -> bool:
    """Whether a tokenizer's JSON proves that a word of ``PLAIN`` has the ids of its lower-cased letters, byte by byte
    as characters, and then those of its punctuation.

    It does if texts are composed and lower-cased, cut by ``PIECES`` (a run of letters is one piece, a run of
    punctuation another), handed on byte by byte, and if no added token is made of ``PLAIN``'s characters only."""
    normal, pre = definition.get("normalizer") or {}, (definition.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in normal.get("normalizers", [])] != LOWER_CASE or [x["type"] for x in pre] != ["Split", "ByteLevel"]:
        return False
    split, level = pre
    if split["pattern"] != {"Regex": PIECES} or split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return False
    replace = normal["normalizers"][1]
    if replace["pattern"] != {"Regex": r"\s+"} or replace["content"] != " ":
        return False
    return all(re.search(r"[^!-&(-/:;=?@\[-`{-~A-Za-zÀ-ÖØ-öø-ÿ]", t["content"]) for t in definition.get("added_tokens", []))


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: its own if it is printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """A dict of two generations: a young one that holds ``limit`` bytes becomes the old one, and what is asked for
    again moves over. So frequent keys stay and memory is bounded."""

    #: Bytes that an entry takes beside its characters and ids.
    ENTRY = 160

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.size, self.old = make, limit, 0, {}

    def __missing__(self, key):
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        self.size += len(key) + len(ids) + self.ENTRY
        if self.size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = ids
        return ids


class _WordIds(_Kept):
    """word (UTF-8) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 24 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.table = byte_characters()
        self.plain_ok = letters_stand_apart(json.loads(self.tok.to_str()))
        self.letters = _Kept(self._letters, limit)
        super().__init__(self._ids, limit)

    def _letters(self, letters: str) -> bytes:
        """Ids of a run of lower-case letters, straight from the model."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.tok.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.plain_ok and (found := PLAIN.fullmatch(text)):
            letters, rest = found.groups()
            ids = self.letters[letters.lower()]
            return ids + self[rest.encode()] if rest else ids
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def _words(path: str) -> _WordIds:
    """The worker's word cache of a vocabulary; a reused worker keeps it from task to task."""
    if path not in _CACHES:
        _CACHES[path] = _WordIds(path)
    return _CACHES[path]


def binary_lengths(n: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of the pieces of documents of n tokens: whole ``max_len`` pieces, then the set bits of
    the rest, the largest first."""
    bits = np.arange(max_len.bit_length() - 2, -1, -1)
    doc, bit = np.nonzero((n % max_len)[:, None] >> bits & 1)
    whole = np.repeat(np.arange(len(n)), n // max_len)
    length = np.concatenate([np.full(len(whole), max_len), 1 << bits[bit]])
    doc = np.concatenate([whole, doc])
    order = np.argsort(doc, kind="stable")
    doc, length = doc[order], length[order]
    start = np.cumsum(length) - length - (np.cumsum(n) - n)[doc]
    return doc, start, length


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, max_len: int = 4096, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``
    (and ``ids``, the piece's token ids, with ``keep_ids``).

    Null or empty text: only the end token, one piece of length 1. A null id stays null; repeated
    rows are packed each on their own; other columns are not read."""
    if max_len < 2 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two above 1")
    end = struct.pack("<I", end_id)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch, texts in slices(batches, "text"):
            streams = [b"".join(map(words.__getitem__, (raw or b"").split())) + end for raw in texts]
            total = np.array([len(x) // 4 for x in streams], np.int64)
            doc, start, length = binary_lengths(total, max_len)
            stream = memoryview(b"".join(streams))
            at = 4 * (np.cumsum(length) - length)
            crc = [zlib.crc32(stream[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            arrays = [batch.column(0).take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, length, crc, total[doc]))]
            if keep_ids:
                offsets = np.append(0, np.cumsum(length)).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(stream, np.uint32).astype(np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)
    return out.withColumnRenamed("id", id_col)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", **options) -> DataFrame:
    """``pieces`` plus ``sequence_id`` (gapless over the corpus, one bucket of equal lengths after
    another, longest first), ``offset`` (0: a piece fills its sequence) and ``bucket`` (log2 of the length)."""
    cut = written(pieces(docs, tokenizer, id_col, **options), "pieces")
    out = numbered(cut, "sequence_id", [], [-F.col("length")], [id_col, "start", "ids_crc32"])
    return out.withColumns({"offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})
