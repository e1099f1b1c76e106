"""The registered queries of the subpackage: thin callers of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, fill_middle, html_extract, language_id, lm_scoring, near_dup, oracles, packing, quality_rules, sharding, spelling, toxicity, weak_quality
from .common import id_remainder, read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and line-frequency verdicts of all documents."""
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together."""
    return sharding.shard(read(spark, sf_dir, "documents"), n_shards=40)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by rank-order profiles of the rows outside the fold of remainder 2."""
    docs = read(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    found = language_id.identify(docs, language_id.learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the fold of remainder 0."""
    docs = read(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on four-word shingles at similarity 0.8."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, threshold=80)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two packing of all documents with the 49k word vocabulary."""
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, max_len=4096)


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents from weak labels."""
    return weak_quality.assess(read(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and hidden Markov model scores of all documents, learned outside the fold of remainder 2."""
    return lm_scoring.score(read(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) == 2)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark."""
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents, there and back, with the 50k vocabulary of many languages."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, back=True)
    n = (F.octet_length("ids") / 4).cast("long")
    return back.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle of all documents, and the texts restored from it."""
    out = fill_middle.transform(read(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_shards": op2_shards,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_pack": op6_pack,
    "op7_weak_quality": op7_weak_quality,
    "op8_main_text": op8_main_text,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_decontaminate": op10_decontaminate,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_fill_middle": op12_fill_middle,
    "op13_spelling": op13_spelling,
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": oracles.quality_rules(),
    "op12_fill_middle": oracles.fill_middle(),
    "op13_spelling": oracles.spelling(),
}
