"""Departments of questions against a loop, and what their plan shuffles."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import consult


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(1)
    belongs = [(f"p{i}", f"dep{r.randrange(12)}") for i in range(60)]
    first = [(f"s{r.randrange(9)}", f"p{r.randrange(60)}") for _ in range(200)]
    direct = sorted({(q, f"p{r.randrange(60)}") for q in range(80) for _ in range(r.randint(0, 3))})
    indirect = sorted({(q, f"s{r.randrange(10)}") for q in range(80) for _ in range(r.randint(0, 5))})
    made = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'q' else 'string'}" for n in names))
    term = lambda df: df.withColumn("term", F.concat(F.lit("t"), F.col("entity")))
    frames = term(made(direct, ["q", "entity"])), term(made(indirect, ["q", "entity"])), made(first, ["src", "dst"]), made(belongs, ["entity", "department"])
    own, paths = dict(belongs), defaultdict(Counter)
    for s, p in set(first):
        paths[s][own[p]] += 1
    want = {}
    for q in range(80):
        per = defaultdict(lambda: [False, 0, set()])
        for e, counts, is_direct in [(e, {own[e]: 1}, True) for x, e in direct if x == q] + [(e, paths[e], False) for x, e in indirect if x == q]:
            for d, n in counts.items():
                per[d] = [per[d][0] or is_direct, per[d][1] + n, per[d][2] | {f"t{e}"}]
        for rank, (d, (is_direct, n, terms)) in enumerate(sorted(per.items(), key=lambda x: (not x[1][0], -x[1][1], x[0]))[:3], 1):
            want[q, d] = (rank, n, sorted(terms)[:3], 0.95 if is_direct else round(min(0.7, 0.52 + 0.03 * n), 3))
    return frames, want


@pytest.mark.parametrize("most", [10_000_000, 0])
def test_departments_equal_a_loop(graph, most):
    frames, want = graph
    got = {(x.q, x.department): (x["rank"], x.support, x.terms, x.confidence) for x in consult.departments(*frames, most=most).collect()}
    assert got == want and len(want) > 100


def test_departments_are_not_shuffled_one_by_one(graph):
    plan = consult.departments(*graph[0])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(q#\d+, \d+\), REPARTITION_BY_COL", plan)
    assert not re.search(r"hashpartitioning\(q#\d+L?, (d|department)#\d+, \d+\)", plan)
