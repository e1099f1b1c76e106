"""Blocks in braces, found in long streams of text that come in pieces.

A block begins at a brace and is decided on as it is read: it may turn out to be plain text, close, or run out of its
limit. What a reader has not decided on at the end of a segment is a short text, the carry, which is all that the next
segment needs to know. So all segments are read side by side as if nothing were carried in; then those whose carry
turns out to be another are read again, until none changes. A carry rarely outlives a segment, so that a round or two
do, and the result is that of one sequential reading however the stream is cut."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .ordering import ranked


@dataclass(frozen=True)
class Rules:
    """When a brace opens a block. From ``decide`` characters on it does if a sign of a command is there (``signs``, a
    first word that a keyword begins with or that begins with one, a colon or an equals sign); it is text if, from ``plain`` characters on, neither these nor
    a quote is there, or if punctuation follows it. A block undecided or open after ``limit`` characters ends there.
    ``confident``: what a block must exceed where it closes undecided or is cut off."""

    keywords: tuple[str, ...] = ()
    signs: str = r"(?i)\{\s*(tool\s*_?\s*call|skill\s*_?\s*call|judge|\w+\s*[:=]\"\w)"
    punctuation: str = "，。、？！；：“”‘’（）【】"
    decide: int = 5
    plain: int = 8
    limit: int = 300
    confident: float = 0.3

    def confidence(self, block: str) -> float:
        low = block.lower()
        if any(k in low or k.replace("_", "") in low for k in self.keywords):
            return 0.9
        return 0.4 if ":" in block else 0.1

    def opens(self, begun: str) -> bool:
        word = re.match(r"\{\s*([\w-]{4,})", begun)
        known = word is not None and any(k.startswith(word[1].lower()) or word[1].lower().startswith(k) for k in self.keywords)
        return ":" in begun or "=" in begun or known or re.search(self.signs, begun) is not None

    def is_text(self, begun: str) -> bool:
        after = begun[1:].lstrip()[:1]
        return (after != "" and after in self.punctuation) or (len(begun) >= self.plain and not any(c in begun for c in ':="'))

    def read(self, text: str, at: int) -> tuple[str, int]:
        """What the brace at ``at`` comes to, and where: "block", "text" or "open" (the text ends first)."""
        depth, command = 0, False
        for end in range(at + 1, len(text) + 1):
            c, n = text[end - 1], end - at
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return ("block" if command or self.confidence(text[at:end]) > self.confident else "text"), end
            if not command and n >= self.decide:
                if self.opens(text[at:end]):
                    command = True
                elif self.is_text(text[at:end]):
                    return "text", at + 1
            if n > self.limit:
                return ("block" if command and self.confidence(text[at:end]) > self.confident else "text"), end
        return "open", len(text)

    def scan(self, text: str, last: bool) -> tuple[list[tuple[int, str, float]], str]:
        """The blocks of a text (place, text, confidence) and what is left undecided; at the ``last`` text nothing is."""
        found, at = [], 0
        while (at := text.find("{", at)) >= 0:
            what, end = self.read(text, at)
            if what == "open":
                if not last:
                    return found, text[at:]
                rest = text[at:]
                if self.opens(rest) and self.confidence(rest) > self.confident:
                    found.append((at, rest, self.confidence(rest)))
                break
            if what == "block":
                found.append((at, text[at:end], self.confidence(text[at:end])))
            at = end
        return found, ""


def segments(pieces: DataFrame, key: str, together: int = 64) -> DataFrame:
    """(rank, key, text, first, last): ``together`` consecutive pieces (key, seq, text) of a stream as one segment, numbered
    in the order of streams. Null texts are empty, null keys are a stream."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "")
    rows = pieces.groupBy(key, F.floor(F.col("seq") / together).alias("part")).agg(joined.alias("text"))
    placed = ranked(rows, [F.col(key), F.col("part")], "rank")
    ends = placed.groupBy(F.col(key).alias("__key")).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    out = placed.join(ends, F.col(key).eqNullSafe(F.col("__key")))
    return written(out.select("rank", key, "text", "first", (F.col("rank") == F.col("last")).alias("last")), "segments")


def _offsets(parts: DataFrame, size: int = 4096) -> DataFrame:
    """(rank, offset): the characters of a stream before each segment, by blocks of ranks."""
    n = parts.select("rank", "first", F.length("text").cast("long").alias("n"), F.floor(F.col("rank") / size).alias("block"))
    blocks = n.groupBy("block").agg(F.sum("n").alias("of_block"))
    before = F.coalesce(F.sum("of_block").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = blocks.select(F.col("block").alias("of"), before.alias("begin"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("block").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = n.withColumn("inner", inner).join(begins, F.col("block") == F.col("of")).select("rank", "first", (F.col("begin") + F.col("inner")).alias("upto"))
    starts = upto.filter("rank = first").select(F.col("rank").alias("start"), F.col("upto").alias("zero"))
    return upto.join(starts, F.col("first") == F.col("start")).select(F.col("rank").alias("of"), (F.col("upto") - F.col("zero")).alias("offset"))


def frames(pieces: DataFrame, key: str, rules: Rules, together: int = 64) -> DataFrame:
    """(key, start, block, confidence) of each block in braces of each stream of ``pieces`` (key, seq, text): ``start`` is
    its place in the stream's characters; all else is text. A stream without braces has no rows."""
    parts = segments(pieces, key, together)

    def carried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lasts = batch.column("text").to_pylist(), batch.column("last").to_pylist()
            out = [rules.scan(c + t, z)[1] for c, t, z in zip(batch.column("came").to_pylist(), texts, lasts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("came"), pa.array(out, pa.string())], names=["rank", "came", "goes"])

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, starts, blocks, sure = [], [], [], []
            for rank, came, text, last in zip(*(batch.column(c).to_pylist() for c in ("rank", "came", "text", "last")), strict=True):
                for at, block, confidence in rules.scan(came + text, last)[0]:
                    ranks.append(rank)
                    starts.append(at - len(came))
                    blocks.append(block)
                    sure.append(confidence)
            yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(starts, pa.int64()), pa.array(blocks, pa.string()), pa.array(sure, pa.float64())], names=["rank", "at", "block", "confidence"])

    now = written(parts.withColumn("came", F.lit("")).select("rank", "text", "last", "came").mapInArrow(carried, "rank long, came string, goes string"), "carries")
    firsts = parts.select(F.col("rank").alias("of"), "first", "text", "last")
    while True:
        handed = now.select((F.col("rank") + 1).alias("to"), F.col("goes").alias("comes"))
        met = now.join(handed, F.col("rank") == F.col("to"), "left").join(firsts, F.col("rank") == F.col("of"))
        comes = F.when(F.col("rank") == F.col("first"), "").otherwise(F.coalesce("comes", F.lit("")))
        again = written(met.withColumn("comes", comes).filter(F.col("comes") != F.col("came")).select("rank", "text", "last", F.col("comes").alias("came")), "again")
        if again.isEmpty():
            break
        new = again.mapInArrow(carried, "rank long, came string, goes string")
        now = written(now.join(again.select("rank"), "rank", "left_anti").unionByName(new), "carries")
    blocks = parts.join(now.select("rank", "came"), "rank").select("rank", "came", "text", "last").mapInArrow(found, "rank long, at long, block string, confidence double")
    placed = blocks.join(parts.select("rank", key), "rank").join(_offsets(parts), F.col("rank") == F.col("of"))
    return placed.select(key, (F.col("offset") + F.col("at")).alias("start"), "block", "confidence")
