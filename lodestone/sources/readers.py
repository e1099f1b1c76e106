"""Readers: JSON arrays, JSON lines with line numbers, CSV in one of two encodings, record sets, graph exports, chunk and
event streams. Explicit schemas; what the caller may skip is skipped, what must hold raises."""

from __future__ import annotations

import csv as csv_module
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each element of top-level JSON arrays; other or unterminated documents are an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, broken ones raise or (not strict) are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def numbered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``source_line`` (1-based, blank lines counted) and ``source_file``.

    A file is read as a whole by one task, as only its beginning tells the numbers; files are dealt over tasks."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                lines = content.decode("utf-8-sig", "replace").split("\n")
                kept = [(n, x) for n, x in enumerate(lines, 1) if x.strip()]
                yield pd.DataFrame({"source_file": [name] * len(kept), "source_line": [n for n, _ in kept], "value": [x for _, x in kept]})

    lines = files.mapInPandas(split, "source_file string, source_line long, value string")
    return lines.select("source_file", "source_line", F.from_json("value", schema).alias("r")).select("source_file", "source_line", "r.*")


def charset(spark: SparkSession, path: str, sample: int = 1 << 20) -> str:
    """utf-8 if the first MiB of a file decodes as such (a character cut at its end aside), else gb18030."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, sample)).first()
    data = bytes(head[0]) if head else b""
    for cut in range(4):
        try:
            data[: len(data) - cut].decode("utf-8-sig")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "gb18030"


def csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header, its columns in lower case; rows that lack a field are skipped, missing columns raise.

    Spark reads UTF-8 itself; a file in the other encoding is decoded as a whole by one task."""
    if charset(spark, path) == "utf-8":
        raw = spark.read.option("header", True).option("multiLine", True).option("mode", "DROPMALFORMED").csv(path)
        df = raw.toDF(*[c.lstrip("\ufeff").strip().lower() for c in raw.columns])
        if missing := [c for c in required if c not in df.columns]:
            raise ValueError(f"{path} lacks the columns {missing}")
        return df.dropna(subset=required).select(*required)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for content in frame["content"]:
                rows = csv_module.reader(io.StringIO(content.decode("gb18030", "replace")))
                header = [c.strip().lower() for c in next(rows, [])]
                if missing := [c for c in required if c not in header]:
                    raise ValueError(f"{path} lacks the columns {missing}")
                at = [header.index(c) for c in required]
                yield pd.DataFrame([[r[i] for i in at] for r in rows if len(r) == len(header)], columns=required, dtype="string")

    df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, ", ".join(f"`{c}` string" for c in required))
    df.limit(1).collect()  # a missing column raises here, not later
    return df


def tree(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """JSON documents of that name under a folder, with ``source_file``."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True).json(folder).withColumn("source_file", F.col("_metadata.file_path"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON or, by suffix, JSON lines; malformed records are dropped."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    return reader.json(path) if path.endswith(".jsonl") else reader.option("multiLine", True).json(path)


def cases(spark: SparkSession, path: str, case: str) -> DataFrame:
    """The ``cases`` of JSON documents, one row each."""
    return spark.read.schema(f"cases array<{case}>").option("multiLine", True).json(path).select(F.inline("cases"))


NODE = "n struct<identity:long,labels:array<string>,properties:map<string,string>>, id long, identity long, labels array<string>, label string, name string, properties map<string,string>"


def graph_nodes(df: DataFrame, source: str) -> DataFrame:
    """Nodes of a graph export, wrapped as {n: {...}} or flat: id, name, label, properties, source. Without a name: left out."""
    properties = F.coalesce("n.properties", "properties")
    name = F.trim(F.coalesce(F.col("name"), F.element_at(properties, "name"), F.lit("")))
    labels = F.coalesce("n.labels", "labels", F.when(F.col("label").isNotNull(), F.array("label")))
    return df.select(F.coalesce("n.identity", "id", "identity").alias("id"), name.alias("name"), labels.alias("label"), properties.alias("properties"), F.lit(source).alias("source")).filter("name <> '' AND id IS NOT NULL")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``word phone... tone...`` (as many tones as phones): word, phones, tones. Other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    half = ((F.size("p") - 1) / 2).cast("int")
    rows = spark.read.text(path).select(parts.alias("p")).filter((F.size("p") >= 3) & (F.size("p") % 2 == 1))
    return rows.select(F.element_at("p", 1).alias("word"), F.slice("p", 2, half).alias("phones"), F.slice("p", 2 + half, half).cast("array<int>").alias("tones"))


def chunks(df: DataFrame, rate: Column, wanted_rate: int) -> DataFrame:
    """Valid chunks (stream_id, seq, data) of 16-bit samples in base64: wrong rates, broken or odd data and chunks that do
    not follow the last one kept of their stream are dropped."""
    decoded = df.withColumn("samples", F.try_to_binary("data", F.lit("base64"))).filter((rate == wanted_rate) & F.col("samples").isNotNull() & (F.length("samples") % 2 == 0))
    w = W.partitionBy("stream_id").orderBy("seq")
    first = F.min("seq").over(W.partitionBy("stream_id"))
    return decoded.dropDuplicates(["stream_id", "seq"]).withColumn("place", F.row_number().over(w)).withColumn("__first", first).filter(F.col("seq") == F.col("__first") + F.col("place") - 1).drop("place", "__first")


def event_stream(spark: SparkSession, folder: str, most_bytes: int = 256 * 1024) -> DataFrame:
    """Events that arrive as JSON lines in a folder: trace_id, type, ts, session_id, mode, payload; larger ones are dropped."""
    schema = T.StructType.fromDDL("trace_id string, type string, timestamp double, session_id string, mode string, payload string")
    lines = spark.readStream.text(folder).filter(F.octet_length("value") <= most_bytes)
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*").filter("trace_id IS NOT NULL").withColumn("ts", F.timestamp_seconds("timestamp")).drop("timestamp")
