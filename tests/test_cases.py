"""Pruned search against scoring everything; grounded cases; rounds of checks against a loop for each case."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import block_index, cases, retrieval


def topical(n, seed):
    """Texts of four topics with words of their own and some in common, as collections have them."""
    r = random.Random(seed)
    topics = [[f"{t}{i:03d}" for i in range(120)] for t in "abcd"]
    return [(i, i % 4, " ".join(r.choice(topics[i % 4]) if r.random() < 0.8 else f"x{r.randint(0, 30):02d}" for _ in range(r.randint(5, 60)))) for i in range(n)]


def test_pruned_search_is_exact_and_reads_fewer_postings(spark, tmp_path):
    rows = topical(1500, 1)
    docs = spark.createDataFrame(rows, "doc_id long, topic int, text string")
    queries = spark.createDataFrame([(i, " ".join(text.split()[:6])) for i, _, text in rows[::150]] + [(99_999, "nothing here"), (100_000, None)], "qid long, text string")
    path = str(tmp_path / "index")
    block_index.build(docs, T.words("text"), path, alike=[F.col("topic")], size=8)
    got = {tuple(r) for r in block_index.search(spark, path, queries, T.words("text"), 5, first=4).collect()}
    want = {tuple(r) for r in retrieval.bm25(docs, T.words("text"), queries, T.words("text"), 5).collect()}
    assert got == want and len(want) == 50
    asked = queries.select("qid", F.explode(F.array_distinct(T.words("text"))).alias("term"))
    blocks, everything = block_index.chosen_blocks(spark, path, asked, 5, 4)
    index = spark.read.parquet(path)
    read = lambda of: index.join(of.join(asked, "qid"), ["term", "block"]).agg(F.sum(F.size("docs"))).first()[0]
    assert read(everything) == index.join(asked, "term").agg(F.sum(F.size("docs"))).first()[0]
    assert read(blocks) < 0.8 * read(everything)
    with pytest.raises(Exception, match="exist"):
        block_index.build(docs, T.words("text"), path)


def test_an_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    block_index.build(docs, T.words("text"), str(tmp_path / "index"))
    assert block_index.search(spark, str(tmp_path / "index"), docs.withColumnRenamed("doc_id", "qid"), T.words("text"), 3).count() == 0


def test_grounded_cases_take_texts_from_their_sources(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    a = spark.createDataFrame([(1, "first answer", "d/train"), (2, None, "d/train"), (3, "third", "d/test")], "row_id long, answer string, dataset string")
    b = spark.createDataFrame([(1, "other table", "e/train")], "row_id int, answer string, dataset string")
    rows = [(0, "a", 1, sha("first answer")), (1, "a", 1, sha("changed")), (2, "a", 1, ""), (3, "a", 1, None), (4, "b", 1, sha("other table")), (5, "b", 2, None), (6, "c", 1, None), (7, None, 1, None), (8, "a", 3, None), (9, "a", 2, sha("")), (10, "a", None, None)]
    df = spark.createDataFrame([(*r, "a text that the case brought") for r in rows], "id long, source_table string, source_row long, source_sha256 string, reference string")
    got = {r.id: (r.problem, r.reference, r.answer_sha256) for r in cases.grounded(df, {"a": a, "b": b}, F.col("dataset").endswith("/train"), 8).collect()}
    first = ("first an", sha("first answer"))
    assert got[0] == (None, *first) and got[1] == ("hash_mismatch", *first) and got[2] == got[3] == (None, *first)
    assert got[4] == (None, "other ta", sha("other table")) and got[5][0] == got[10][0] == "missing_row" and got[6][0] == got[7][0] == "unknown_table"
    assert got[8][0] == "not_allowed" and got[9] == (None, "", sha("")) and len(got) == len(rows)


STATUSES = {"u": ("need_more_info", 2, True), "a": ("ambiguous", 0, True), "o": ("ok", 0, True), "r": ("urgent", 0, True), "n": ("not_found", 0, True), "f": (None, 0, False)}


def looped(turns, replies, most=3):
    """One case after another."""
    queries = [t or "" for t in turns or [""]] or [""]
    replies = [x.strip() for x in replies or [] if x and x.strip()]
    checks = [STATUSES[q[:1]] if q[:1] in STATUSES else STATUSES["n"] for q in queries]
    if len(queries) == 1:
        while checks[-1][0] in cases.UNCLEAR and replies and len(queries) < most:
            queries.append(replies.pop(0))
            checks.append(STATUSES.get(queries[-1][:1], STATUSES["n"]))
    reasons = [] if all(c[2] for c in checks) else ["TOOL_FAILED"]
    if len(checks) == 1:
        reasons += [f"SINGLE_TURN_NOT_ANSWERABLE:{checks[0][0]}"] if checks[0][0] not in cases.FINAL else []
    else:
        reasons += [f"FIRST_TURN_DOES_NOT_REQUEST_FOLLOWUP:{checks[0][0]}"] if checks[0][0] not in cases.UNCLEAR else []
        reasons += ["FIRST_TURN_HAS_NO_QUESTION"] if not checks[0][1] else []
        reasons += [f"FINAL_TURN_NOT_ANSWERABLE:{checks[-1][0]}"] if checks[-1][0] not in cases.FINAL else []
    return ("reject" if reasons else "eligible", reasons, [c[0] for c in checks], queries)


def test_preflight_equals_a_loop_for_each_case(spark):
    r = random.Random(2)
    word = lambda: r.choice(["u1", "a1", "o1", "r1", "n1", "f1", "u2"])
    rows = [(i, [word() for _ in range(r.choice([1, 1, 1, 2, 3]))], [r.choice([word(), " ", None]) for _ in range(r.randint(0, 4))]) for i in range(150)]
    rows += [(900, None, None), (901, [], ["o"]), (902, [None], None)]
    df = spark.createDataFrame(rows, "case long, turns array<string>, replies array<string>")
    kind = F.substring("query", 1, 1)
    pick = lambda n: F.coalesce(*[F.when(kind == k, F.struct(F.lit(v[0]).cast("string").alias("s"), F.lit(v[1]).alias("q"), F.lit(v[2]).alias("o"))) for k, v in STATUSES.items()], F.struct(F.lit("not_found").alias("s"), F.lit(0).alias("q"), F.lit(True).alias("o")))[n]
    consult = lambda asked: asked.withColumns({"status": pick("s"), "n_questions": pick("q"), "success": pick("o")})
    got = {x.case: (x.decision, list(x.reasons), list(x.statuses), list(x.turns)) for x in cases.preflight(df, consult).collect()}
    want = {i: looped(t, p) for i, t, p in rows}
    assert got == want and {len(w[3]) for w in want.values()} == {1, 2, 3} and {w[0] for w in want.values()} == {"reject", "eligible"}


def test_claims_cite_what_was_seen_by_then(spark):
    kind = "case long, turn long, claims array<struct<text:string,evidence:array<string>>>"
    answers = spark.createDataFrame([(1, 2, [("x", ["e1"]), ("y", ["e1", "e2"])]), (1, 3, [("x", ["e4"])]), (1, 5, [("x", ["e4", " "]), ("y", None)]), (2, 1, []), (2, 2, None), (2, 3, [("z", ["e1"])]), (None, 1, [("x", ["n"])])], kind)
    evidence = spark.createDataFrame([(1, 1, "e1"), (1, 2, "e2"), (1, 4, "e4"), (1, 9, "e4"), (None, 1, "n")], "case long, turn long, evidence_id string")
    got = {(r.case, r.turn): (r.n_claims, r.uncited, r.unseen, r.accepted) for r in cases.claims_checked(answers, evidence).collect()}
    assert got == {(1, 2): (2, 0, 0, True), (1, 3): (1, 0, 1, False), (1, 5): (2, 1, 0, False), (2, 1): (0, 0, 0, False), (2, 2): (0, 0, 0, False), (2, 3): (1, 0, 1, False), (None, 1): (1, 0, 0, True)}


def test_gaps_are_filled_in_order(spark):
    candidates = spark.createDataFrame([(c, i) for c in ("a", "b", None) for i in range(5)], "kind string, i long")
    have = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("b", 4)], "kind string, i long")
    got = sorted(((r.kind or "", r.i) for r in cases.gap_filled(candidates, have, "kind", 4, ["i"]).collect()))
    assert got == [("", 0), ("", 1), ("", 2), ("", 3), ("a", 0), ("a", 1)]


def test_blocks_are_cut_once(spark, tmp_path):
    """The blocks themselves, not only their ranges, come from one reading of the ordered documents."""
    read = spark.sparkContext.accumulator(0)

    def split(text):
        read.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i}") for i in range(200)], "doc_id long, text string")
    block_index.build(docs, F.udf(split, "array<string>")("text"), str(tmp_path / "index"), parts=4)
    assert read.value <= 2 * 200  # the lengths, and the blocks
