"""Quality rules: per-text counters and cross-document line frequency.

A line that many documents of a host share is boilerplate. Lines are normalised (A-Z lower-cased,
blanks collapsed) and hashed; the distinct documents of a host that hold a line are counted; a line
above its host's limit is removed; a document that is left with too few words, or too small a share
of them, is depleted and rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_counted, slices, small, written

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """min_words and max_repeat_share: the base rules. A line of a host goes if more than ``line_docs`` of its
    documents and more than ``line_share`` of them hold it: the share counts in any host of more than a few dozen
    documents, the number keeps smaller ones from losing lines by chance. A document is depleted if less than
    ``left_share`` of its words, or fewer than ``min_words``, are left. With ``equal_texts_once``, equal texts of a
    host count as one document."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    line_docs: int = 4
    line_share: float = 0.08
    left_share: float = 0.5
    equal_texts_once: bool = False


def line_key(line: bytes) -> int:
    """Signed 64-bit hash of a normalised line."""
    h = xxhash.xxh3_64_intdigest(b" ".join(line.lower().split()))
    return h - (1 << 64) if h >= 1 << 63 else h


def counters(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        hit = bytearray(len(words))
        for at, window in enumerate(windows):
            if often[window] > 1:
                hit[at : at + 3] = b"\x01\x01\x01"
        repeated = sum(hit)
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a row of ``docs``: id, host, text_key (hash of the text), the five counters and ``lines``,
    the distinct normalised lines with the words they hold. Null text: no word and no line."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            rows, lines = [], []
            for raw in texts:
                raw = raw or b""
                rows.append(counters(raw))
                found: dict[int, int] = {}
                for line in raw.split(b"\n"):
                    if n := len(line.split()):
                        key = line_key(line)
                        found[key] = found.get(key, 0) + n
                lines.append([{"line": k, "words": n} for k, n in found.items()])
            line_type = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
            arrays = [batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(lines, line_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, host_col)}
    schema = f"id {kinds[id_col]}, host {kinds[host_col]}, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>"
    return docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(measure, schema)


def frequent_lines(rows: DataFrame, limits: Limits) -> DataFrame:
    """(host, line, n_docs, host_docs) of the lines above the limits of their host, from ``measured``.

    Distinct documents are counted in two steps, first dealt by document too, so neither a hot host nor a hot line
    meets in one task unsummed. Rows with one id are one document, those without an id together one."""
    unit = F.col("text_key") if limits.equal_texts_once else F.struct("id")
    rows = rows.select("host", unit.alias("unit"), "lines.line")
    hosts = rows.groupBy("host").agg(F.count_distinct("unit").alias("host_docs"))
    lines = rows.select("host", "unit", F.explode("line").alias("line")).groupBy("host", "line").agg(F.count_distinct("unit").alias("n_docs")).filter(F.col("n_docs") > limits.line_docs)
    hosts = hosts.withColumnRenamed("host", "of_host")
    return lines.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).filter(F.col("n_docs") > limits.line_share * F.col("host_docs")).select("host", "line", "n_docs", "host_docs")


def judge(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The verdict on every row of ``docs``: id, the counters, ``base_failed``, ``n_frequent_words`` (words in
    removed lines) and ``kept``.

    Null or empty text: no words, so it fails the base rules. A null host is a host of its own. Rows with one id
    count as one document of a line, and get one verdict each. An empty table gives an empty result."""
    return _verdicts(docs, limits or Limits(), id_col, text_col, host_col).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_words", "kept"
    )


def _verdicts(docs: DataFrame, limits: Limits, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``measured`` without the lines, plus base_failed, n_frequent_words, ``frequent`` (hashes of the removed lines,
    null if none) and kept."""
    rows = written(measured(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "rules")
    often = frequent_lines(rows, limits).select(F.col("host").alias("of_host"), F.col("line").alias("of_line"), "n_docs")
    found = join_counted(rows.select("row", "host", F.inline("lines")), often, (F.col("line") == F.col("of_line")) & F.col("host").eqNullSafe(F.col("of_host")), "n_docs")
    lost = found.groupBy("row").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("frequent")).withColumnRenamed("row", "lost_row")
    base_failed = (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") > limits.max_repeat_share * F.col("n_words"))
    out = rows.drop("lines").join(lost, F.col("row") == F.col("lost_row"), "left").withColumns({"base_failed": base_failed, "n_frequent_words": F.coalesce("lost", F.lit(0))})
    left = F.col("n_words") - F.col("n_frequent_words")
    depleted = (left < limits.left_share * F.col("n_words")) | (left < limits.min_words)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row", "lost_row", "lost")


def clean(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` that pass, without the lines above the limits; all columns stay, ``length_col``
    (if there is one) is the new length. Other rows and lines are unchanged. Equal rows have equal verdicts; rows
    that differ in host do not share one."""
    verdict = _verdicts(docs, limits or Limits(), id_col, text_col, host_col).filter(~F.col("kept") | F.col("frequent").isNotNull())
    # only rows that go or lose lines are listed; texts move only if that list is too long to broadcast
    verdict = verdict.groupBy("id", "host", "text_key").agg(F.bool_and("kept").alias("kept"), F.first("frequent", ignorenulls=True).alias("frequent"))
    columns = docs.columns
    lost_col = fresh("frequent", columns)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text_col)
        for batch, texts in slices(batches, text_col):
            gone = batch.column(len(columns)).to_pylist()
            left = [raw if not lost else b"\n".join(x for x in raw.split(b"\n") if not x.strip() or line_key(x) not in lost) for raw, lost in zip(texts, map(set, (g or () for g in gone)), strict=True)]
            arrays = [pa.array(left, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    rows = docs.select(F.struct("*").alias("doc"))
    same = F.col(f"doc.{id_col}").eqNullSafe(F.col("id")) & F.col(f"doc.{host_col}").eqNullSafe(F.col("host")) & (F.xxhash64(f"doc.{text_col}") == F.col("text_key"))
    joined = rows.join(small(verdict), same, "left").filter(F.coalesce("kept", F.lit(True))).select("doc.*", F.col("frequent").alias(lost_col))
    out = joined.mapInArrow(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    if length_col and length_col in columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
