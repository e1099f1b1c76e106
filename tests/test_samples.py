"""Samples from audited runs."""

import hashlib
import json

from pyspark.sql import functions as F

from lodestone.operators import samples as S

TOOL = '<tool>{{"tool_call":"{}"}}</tool>'


def projected(spark):
    audit = spark.createDataFrame([(1, "accept"), (1, "accept"), (2, S.REVIEW), (3, S.REVIEW), (4, "reject"), (5, "accept")], "case long, decision string")
    cases = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "case long, category string")
    rows = [(1, 1, 1, " " + TOOL.format("plan"), False), (1, 1, 2, TOOL.format("act"), None), (1, 2, 3, TOOL.format("act"), True), (1, 2, 4, "no tool", False), (1, 2, 5, None, False)]
    rows += [(i, 1, 1, TOOL.format("act"), False) for i in (2, 3, 4)] + [(5, 0, 1, TOOL.format("look"), False), (5, 0, 2, TOOL.format("plan"), False)]
    calls = spark.createDataFrame(rows, "case long, external_turn long, iteration long, output string, overflow boolean")
    return S.projected(audit, cases, calls, ["accept", S.REVIEW], spark.createDataFrame([(2,), (2,), (4,)], "case long"))


def test_samples_of_allowed_cases(spark):
    got = {(r.case, r.iteration): r for r in projected(spark).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (5, 2)}
    assert got[1, 1].conversation_type == "multi_turn" and got[2, 1].conversation_type == "single_turn" and got[5, 2].category == "unknown" and got[1, 2].category == "a"
    r = got[1, 1]
    told = {"action": "plan", "case": 1, "external_turn": 1, "iteration": 1, "output_sha256": hashlib.sha256(TOOL.format("plan").encode()).hexdigest()}
    assert r.sample_sha256 == hashlib.sha256(json.dumps(told, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def test_merged_samples_are_rehashed_and_indexed(spark):
    samples = projected(spark)
    stale = samples.withColumn("sample_sha256", F.lit("stale")).withColumn("category", F.lit("first"))
    merged = S.merged([stale.filter("case = 1"), samples])
    assert merged.count() == 4 and merged.filter("sample_sha256 = 'stale'").isEmpty() and merged.filter("category = 'first'").count() == 2
    index = {r.case: (r.category, r.samples, r.plans, r.acts, list(r.turns)) for r in S.case_index(merged).collect()}
    assert index == {1: ("first", 2, 1, 1, [1]), 2: ("b", 1, 0, 1, [1]), 5: ("unknown", 1, 1, 0, [0])}


def test_variants_take_their_roots_samples(spark):
    variants = spark.createDataFrame([("1", "1"), ("1-v", "1"), ("1-v", "1"), ("9-v", "9")], "variant string, root string")
    done, lost = S.compiled(projected(spark), variants, F.concat("output", F.lit("!")))
    got = sorted((r.case, r.root_case, r.iteration, r.output[-1]) for r in done.collect())
    assert got == [("1", "1", 1, ">"), ("1", "1", 2, ">"), ("1-v", "1", 1, "!"), ("1-v", "1", 2, "!")]
    assert [r.variant for r in lost.collect()] == ["9-v"]
