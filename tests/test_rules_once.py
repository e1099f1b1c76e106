"""Rules work out each list once, and a long clause costs in proportion."""

import time

from pyspark.sql import functions as F

from lodestone.functions import rules as R

NEGATION = r"(?:^| )(?:no|not) "


def test_polarity_cuts_clauses_once(spark):
    df = spark.createDataFrame([("not the rights, the license",)], "x string")
    p = df.select(R.polarity(F.col("x"), ["rights", "the", "license", "the rights"], NEGATION).alias("p"))
    plan = p.select("p.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract(") == 1
    assert tuple(p.first().p) == (["license", "the"], ["the rights"])


def test_long_clauses_cost_in_proportion(spark):
    df = spark.createDataFrame([("ab " * 100_000 + "stupid",), ("not ab " * 20_000 + ", stupid",), ("x not a stupid",), ("", ), (None,)], "x string")
    start = time.time()
    got = [r.c for r in df.select(R.coded_rules(F.col("x"), [("insult", "idiot|stupid")], NEGATION).alias("c")).collect()]
    assert got == [["insult"], ["insult"], [], [], []] and time.time() - start < 30


def test_asserted_takes_the_first_match(spark):
    rows = ["stupid", "not stupid, stupid", "a. not b; stupid", "not\nstupid", "ends, ", ",stupid not "]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    assert [r.a for r in df.select(R.asserted(F.col("x"), "stupid", NEGATION).alias("a")).collect()] == [True, False, True, True, False, True]
