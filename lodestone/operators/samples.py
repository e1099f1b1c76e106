"""Training samples from audited runs: projected, merged without repeats, indexed by case, and compiled for variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import merged_sources

#: The decision that needs a person's approval beside it.
REVIEW = "semantic_review_required"
#: What a sample is told by; its hash covers these.
IDENTITY = ["action", "case", "external_turn", "iteration", "output_sha256"]


def _hashed(samples: DataFrame) -> DataFrame:
    """``samples`` with ``output_sha256`` and ``sample_sha256``, the hash of their identity as JSON with keys in order."""
    told = samples.withColumn("output_sha256", F.sha2("output", 256))
    return told.withColumn("sample_sha256", F.sha2(F.to_json(F.struct(*IDENTITY), {"ignoreNullFields": "false"}), 256))


def projected(audit: DataFrame, cases: DataFrame, calls: DataFrame, decisions: list[str], approved: DataFrame) -> DataFrame:
    """Samples of the cases that may be learned from: one for each call that plans or acts, within the context's limit.

    ``audit`` (case, decision) allows a case by its decision; one that needs review must be ``approved`` (case). ``calls``:
    case, external_turn, iteration, output, overflow. Only outputs that begin with a tool's tag count, and only plans and
    acts. Each sample has its case's ``category`` (unknown without one) and whether the case has several turns. A case
    may be listed twice without its samples being so."""
    wanted = audit.filter(F.col("decision").isin(*decisions)).groupBy("case").agg(F.min("decision").alias("decision"), F.bool_or(F.col("decision") != REVIEW).alias("free"))
    allowed = wanted.join(approved.select("case").distinct().withColumn("ok", F.lit(True)), "case", "left").filter(F.col("free") | F.col("ok"))
    allowed = allowed.select("case", "decision").join(cases.groupBy("case").agg(F.min("category").alias("category")), "case", "left")
    turns = calls.groupBy("case").agg(F.greatest(F.max("external_turn"), F.lit(1)).alias("conversation_turns"))
    output = F.trim(F.coalesce("output", F.lit("")))
    action = F.when(output.contains('"tool_call":"plan"'), "plan").when(output.contains('"tool_call":"act"'), "act")
    rows = calls.withColumns({"output": output, "action": action}).filter(~F.coalesce("overflow", F.lit(False)) & output.startswith("<tool>") & F.col("action").isNotNull())
    rows = rows.join(allowed, "case").join(turns, "case")
    kind = F.when(F.col("conversation_turns") > 1, "multi_turn").otherwise("single_turn")
    return _hashed(rows.select("case", F.coalesce("category", F.lit("unknown")).alias("category"), "decision", kind.alias("conversation_type"), "external_turn", "iteration", "action", "output"))


def merged(sources: list[DataFrame]) -> DataFrame:
    """The samples of several sources with their hashes taken anew, each hash once: the earliest source wins."""
    plain = [df.drop("output_sha256", "sample_sha256") for df in sources]
    return merged_sources([_hashed(df) for df in plain], ["sample_sha256"], ["case", "external_turn", "iteration"])


def case_index(samples: DataFrame) -> DataFrame:
    """(case, category, samples, plans, acts, turns) of each case; the turns it has samples of, in order."""
    count = lambda action: F.count_if(F.col("action") == action)
    return samples.groupBy("case", "category").agg(F.count(F.lit(1)).alias("samples"), count("plan").alias("plans"), count("act").alias("acts"), F.sort_array(F.collect_set("external_turn")).alias("turns"))


def compiled(samples: DataFrame, variants: DataFrame, surface: Column) -> tuple[DataFrame, DataFrame]:
    """The samples of each of ``variants`` (variant, root, ...) from those of its root, and the variants without any.

    A sample of a variant has the variant's name as its case and ``surface`` (of the columns of both) as its output; one
    whose name is its root's stays as it is. Equal hashes are one sample. A root's samples meet its variants by key."""
    met = variants.join(samples.drop("output_sha256", "sample_sha256"), F.col("root") == F.col("case").cast("string"))
    text = F.when(F.col("variant") == F.col("root"), F.col("output")).otherwise(surface)
    named = met.withColumns({"output": text, "root_case": F.col("root"), "case": F.col("variant")}).select("case", "root_case", "category", "external_turn", "iteration", "action", "output")
    once = _hashed(named)
    best = F.min_by(F.struct(*once.columns), F.struct("root_case", "external_turn", "iteration")).alias("row")
    lost = variants.join(samples.select(F.col("case").cast("string").alias("root")).distinct(), "root", "left_anti")
    return once.groupBy(F.col("sample_sha256").alias("key")).agg(best).select("row.*"), lost
