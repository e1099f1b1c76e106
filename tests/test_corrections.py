"""Corrections inside nested JSON against a walk in Python."""

import json

from pyspark.sql import functions as F

from lodestone.operators import corrections


def walked(x, old, new, keys, phrases, path="$", key=None, log=None):
    if isinstance(x, dict):
        return {k: walked(v, old, new, keys, phrases, f"{path}[{json.dumps(k, ensure_ascii=False)}]", k, log) for k, v in x.items()}
    if isinstance(x, list):
        return [walked(v, old, new, keys, phrases, f"{path}[{i}]", None, log) for i, v in enumerate(x)]
    if isinstance(x, str):
        after = new if key in keys and x == old else x
        for p in phrases if after == x else []:
            after = after.replace(p + old, p + new)
        if after != x:
            log.append((path, x, after))
        return after
    return x


BODIES = [
    {"target": "lab", "turns": [{"commands": [{"name": "navigate", "params": {"target": "lab", "n": 1}}]}, {"text": "going to lab, not lab", "target": "other"}], "note": "lab"},
    {"a": {"b": {"c": {"target": "lab", "q\"uote": ["go to lab", None, True, 2.5, [], {}]}}}},
    ["lab", {"target": ["lab"]}], "to lab", 5, {"target": "é\n\"lab\""}, {},
]


def test_corrections_equal_a_walk(spark):
    rows = [(i, json.dumps(b, ensure_ascii=False), "lab", "ward \"7\"") for i, b in enumerate(BODIES)]
    rows += [(90, "not json", "lab", "x"), (91, None, "lab", "x"), (92, '{"target":"lab"}', None, "x"), (93, '{"target":"lab"}', "", "x")]
    df = spark.createDataFrame(rows, "id long, body string, was string, should string")
    out, log = corrections.corrected(df, "id", "body", F.col("was"), F.col("should"), ["target", "navigation.target"], ["to "])
    got = {r.id: r.body for r in out.collect()}
    seen = sorted((r.id, r.path, r.before, r.after) for r in log.collect())
    want, wanted = {}, []
    for i, body, old, new in rows:
        if i < 90:
            mine = []
            want[i] = walked(json.loads(body), old, new, ["target", "navigation.target"], ["to "], log=mine)
            wanted += [(i, *x) for x in mine]
    assert {i: json.loads(got[i]) for i in want} == want and seen == sorted(wanted) and len(wanted) > 4
    assert got[90] == "not json" and got[91] is None and got[92] == got[93] == '{"target":"lab"}'
