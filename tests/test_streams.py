"""Streams with state, fed by many small files, against folds over all their rows; blocks in braces against one reading."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import framing
from lodestone.streaming import stateful

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def fed(spark, folder, rows, schema, files):
    """``rows`` as a stream of as many files, in their order, a micro-batch each."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not name.startswith("f"):
                os.rename(folder / name, folder / f"f{i:03d}.parquet")
                os.utime(folder / f"f{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(folder))


def heard(pieces, words):
    out, text = [], {}
    fired = {}
    for key, seq, tokens in pieces:
        have = text.setdefault(key, [])
        new = list(tokens or [])
        if new and have and new[0] == have[-1]:
            new = new[1:]
        before = " ".join(have)
        have += new
        after = " ".join(have)
        known = fired.setdefault(key, set())
        hits = [w for w in sorted(words) if w in after and w not in known] if new else []
        known.update(hits)
        out.append((key, seq, after[len(before) :], len(have), hits))
    return out


def test_growing_text_equals_a_fold(spark, tmp_path):
    r = random.Random(1)
    pieces = [(r.choice("ab"), i, r.choice([None, [], [r.choice("xyz") for _ in range(r.randint(1, 4))]])) for i in range(60)]
    words = ["x y", "zz", "z z y", "y"]
    stream = fed(spark, tmp_path / "in", pieces, "key string, seq long, tokens array<string>", 7)
    got = stateful.growing_text(stream, "key", words).collect()
    assert sorted((g.key, g.seq, g.added, g.n_tokens, list(g.hits)) for g in got) == sorted(heard(pieces, words))


def test_late_pieces_are_dropped(spark, tmp_path):
    stream = fed(spark, tmp_path / "in", [("a", 5, ["x"]), ("a", 3, ["y"]), ("a", 6, ["z"])], "key string, seq long, tokens array<string>", 3)
    assert [(g.seq, g.added) for g in stateful.growing_text(stream, "key", []).orderBy("seq").collect()] == [(5, "x"), (6, " z")]


def test_idle_sessions_equal_a_fold_and_leave_no_state(spark, tmp_path):
    r = random.Random(2)
    at, rows = 0, []
    for i in range(200):
        at += r.choice([1, 5, 20, 700])
        rows.append((r.choice("abc"), START + datetime.timedelta(seconds=at), i, r.choice([None, "pay", "load"])))
    rows.append(("z", START + datetime.timedelta(seconds=at + 10_000), 999, "end"))
    stream = fed(spark, tmp_path / "in", rows, "key string, at timestamp, seq long, payload string", 8)
    log = str(tmp_path / "log")
    got = [(g.key, g.started, g.ended, g.n_events, g.preroll) for g in stateful.idle_sessions(stream, "key", 600, 9, "10 seconds", log).collect()]
    want, open_ = [], {}
    for key, t, _, payload in rows:
        s = open_.get(key)
        if s and (t - s[1]).total_seconds() > 600:
            want.append((key, *s[:3], s[3][-9:]))
            s = None
        open_[key] = (t, t, 1, payload or "") if not s else (s[0], t, s[2] + 1, f"{s[3]} {payload or ''}")
    want += [(k, *s[:3], s[3][-9:]) for k, s in open_.items() if k != "z"]
    naive = lambda rows: sorted((k, s.replace(tzinfo=None), e.replace(tzinfo=None), n, p) for k, s, e, n, p in rows)
    assert naive(got) == naive(want) and len(want) > 20
    left = spark.read.format("statestore").option("path", log).option("stateVarName", "session").load()
    assert left.count() == 1  # the last row's key alone is still open


def resumed(turns, wait):
    out, state = [], {}
    for key, turn, user, text, asks in turns:
        s = state.setdefault(key, {"said": "", "p": None})
        p, text = s["p"], (text or "").strip()
        if user:
            if p and turn - p["at"] > wait:
                p = None
            if p and not p["on"] and text:
                p["answers"].append(text)
                p["on"] = True
            out.append((key, turn, p is not None, p and p["root"], p and p["q"], p["depth"] if p else 0, list(p["answers"]) if p else []))
            s["said"] = text
        elif asks:
            prior = p if p and p["on"] else None
            p = {"at": turn, "root": prior["root"] if prior else s["said"], "q": text, "answers": list(prior["answers"]) if prior else [], "depth": prior["depth"] + 1 if prior else 1, "on": False}
        else:
            p = None
        s["p"] = p
    return out


def test_continuations_equal_a_fold(spark, tmp_path):
    r = random.Random(3)
    turns, at = [], {}
    for _ in range(150):
        key = r.choice("abc")
        at[key] = at.get(key, 0) + r.choice([1] * 8 + [4])
        user = (at[key] % 2 == 0) != (r.random() < 0.1)
        turns.append((key, at[key], user, r.choice([None, " ", "yes", "no", "why not"]), not user and r.random() < 0.8))
    stream = fed(spark, tmp_path / "in", turns, "key string, turn long, user boolean, text string, asks boolean", 6)
    got = [(g.key, g.turn, g.resumed, g.root, g.question, g.depth, list(g.answers)) for g in stateful.continuations(stream, "key", 2).collect()]
    want = resumed(turns, 2)
    assert sorted(got, key=repr) == sorted(want, key=repr) and max(w[5] for w in want) > 1 and any(len(w[6]) > 1 for w in want)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = [("ab"[i % 2], i, f"token={i} ok") for i in range(12)]
    stream = fed(spark, tmp_path / "in", rows, "key string, seq long, text string", 3)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    clean = lambda df: df.withColumn("text", F.regexp_replace("text", r"token=\d+", "token=[omitted]"))
    roll_up = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("newest"))
    run = lambda: stateful.mirrored(stream, out, clean, roll_up, "key", ["n"], log)
    read = lambda: (sorted(map(tuple, stateful.totals(spark, out, "key").select("key", "n", "newest").collect())), sorted(r.seq for r in spark.read.parquet(f"{out}/rows").collect()))
    run()
    once = read()
    assert once == ([("a", 6, 10), ("b", 6, 11)], list(range(12)))
    assert {r.text for r in spark.read.parquet(f"{out}/rows").collect()} == {"token=[omitted] ok"}
    for name in ("2", ".2.crc"):  # as if the driver had died before it noted the last batch
        os.remove(f"{log}/commits/{name}")
    run()
    assert read() == once


RULES = framing.Rules(keywords=("tool_call", "judge"))
PIECES = ['{"a": 1}', "{tool_call: {x}}", "{judge", "}", "{", " text ", "{plain words}", "{，x}", "{a=b", '{"', "x" * 40, "{a:{b:{c}}}", "{" * 6, "{k: " + "y" * 320, "日本", "{}", "{no}"]


@pytest.mark.parametrize("together", [1, 3])
def test_frames_equal_one_reading_for_every_cut(spark, together):
    r = random.Random(4)
    streams = {f"s{i}": "".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for i in range(25)}
    streams["long"] = "{a: " + "z" * 290 + "{q" * 300 + "}" * 40 + '{"b": 2}'
    rows = []
    for key, text in streams.items():
        at = seq = 0
        while at < len(text):
            n = r.choice([1, 2, 5, 30, 200] if key != "s0" else [1])
            rows.append((key, seq, text[at : at + n]))
            at, seq = at + n, seq + r.choice([1, 2])
    df = spark.createDataFrame(rows, "key string, seq long, text string")
    got = sorted((x.key, x.start, x.block, x.confidence) for x in framing.frames(df, "key", RULES, together).collect())
    want = sorted((key, at, block, sure) for key, text in streams.items() for at, block, sure in RULES.scan(text, True)[0])
    assert got == want and len(want) > 30


def test_what_a_brace_comes_to():
    read = lambda t: RULES.scan(t, True)[0]
    assert read("a {tool_call: {x}} b") == [(2, "{tool_call: {x}}", 0.9)] and read('{"a": 1}') == [(0, '{"a": 1}', 0.4)]
    assert read("{plain words} {}") == [] and read("{，abc: d}") == [] and read("{ab}") == []
    assert read("{judge now") == [(0, "{judge now", 0.9)] and read("{a=b") == []
    assert [b[0] for b in read("{plain wo{a: b}")] == [9]
    assert read("{k: " + "y" * 400 + "}")[0][1] == "{k: " + "y" * 297
