"""Functions, operators and sources on small fixtures."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.functions import values as V
from lodestone.operators import curation, linking, relational, retrieval
from lodestone.sources import readers, sinks


def one(spark, expr, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("r")).first()[0]


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, T.short_text(x, 5), "ab  cdefg") == "ab c…" and one(spark, T.short_text(x, 5), None) == ""
    assert one(spark, T.normal_retrieval(x), "ＡＢ c, 中㐀") == "abc中㐀" and one(spark, T.normal_dataset(x), "A b, 中㐀") == "ab中"
    assert one(spark, T.normal_audit(x), "A_b 中!") == "ab中" and one(spark, T.normal_space(x), " A b ") == "ab"
    assert one(spark, T.char_grams(x, 2), "abab") == ["ab", "ba"] and one(spark, T.char_grams(x, 2), "a") == [] and one(spark, T.char_grams(x, 2), None) == []
    assert one(spark, T.fts_tokens(x), "ab,c") == ["a", "b", "ab", "c"]
    assert one(spark, T.query_terms(x, F.array(F.lit("cd")), F.lit("")), "a,b") == ["ab", "cd"]
    assert one(spark, T.clean_answer(x, ["no"]), "a；a ;no;b") == "a；b"
    assert one(spark, T.token_estimate(x), "中中abcd") == 5
    assert one(spark, T.unwrap(x, "tool"), "x <tool>```json\n{}\n```</tool>") == "{}"
    assert one(spark, T.merged(F.split(x, "\\|")), "ab|abc|b|d") == "abcd"
    assert all(len(c) <= 10 for c in one(spark, T.chunk_text(x, 10), "One. Two, three four five six."))
    assert one(spark, T.matches_not_negated(x, "发烧"), "我没有发烧，就是头晕") is False and one(spark, T.matches_not_negated(x, "头晕"), "我没有发烧，就是头晕") is True
    assert one(spark, T.window_similarity(x, F.lit("abc")), "xabcx") == 0.92 and one(spark, T.window_similarity(x, F.lit("abc")), "abc") == 1.0
    assert one(spark, T.sequence_ratio(x, F.lit("abcd")), "abcd") == 1.0
    parsed = one(spark, T.template_question(x, r"^(.+)的(.+?)$", {"症状": "symptom"}), "感冒的症状")
    assert (parsed.subject, parsed.aspect, parsed.quality) == ("感冒", "symptom", 1.0)


def test_chunks_by_hand(spark):
    x = F.col("x")
    assert one(spark, T.chunk_text(x, 10), "abc def ghij, klm. Next\nline of more words") == ["abc def", "ghij, klm.", "Next", "line of", "more words"]
    assert one(spark, T.chunk_text(x, 10), "abcdefghijklmnop") == ["abcdefghij", "klmnop"] and one(spark, T.chunk_text(x, 10), None) == [] and one(spark, T.chunk_text(x), " \n ") == []
    packed = one(spark, T.pack_segments(x, 4), "One two. Three. Four five six seven. 8")
    assert " ".join(packed) == "One two. Three. Four five six seven. 8" and packed[0] == "One two. Three." and all(len(p) // 4 <= 4 for p in packed)
    assert one(spark, T.window_similarity(x, F.lit("abcdef")), "abc") > 0.4 and one(spark, T.token_estimate(x), "\u3400\u3400\u3400\u3400") == 1


def test_rules(spark):
    x, no = F.col("x"), r"(?:^| )(?:no|not) "
    rules, both = [("pain", "pain"), ("fever", "fever")], [("pair", "cough", ["rash"])]
    codes = lambda t: one(spark, R.coded_rules(x, rules, no, both), t)
    assert codes("no pain, but fever") == ["fever"] and codes("cough and rash") == ["pair"] and codes("cough, not a rash") == [] and codes(None) == []
    got = one(spark, R.polarity(x, ["arm", "left arm", "rash"], no), "left arm hurts, no rash. no arm hurts")
    assert got.positive == ["left arm"] and got.negative == ["rash", "arm"]
    asked = R.follow_up(x, [("pain", ["Where is the pain?", "Any fever?"])], ["Since when?"], F.array(F.lit("fever")), "Else?")
    assert one(spark, asked, "pain") == ["Where is the pain?"] and one(spark, asked, "fever") == ["Since when?"]
    gate = R.confirmed(x, "doctor said", F.lit(True), "Answer:")
    assert one(spark, gate, "a doctor said so") and not one(spark, gate, "has a doctor said so? Answer: no")
    cut = R.within_budget({"a": (F.split(x, ","), 1), "b": (F.split(x, ","), 2)}, 40)
    assert tuple(map(len, one(spark, cut, "1,2,3"))) == (3, 3) and tuple(map(len, one(spark, cut, "1111,2222,3333,4444"))) == (1, 2)


def test_value_functions(spark):
    x = F.col("x")
    assert one(spark, V.cascade(x, [("a", "A"), ("b", "B")], "none"), "ba") == "A" and one(spark, V.cascade(x, [("a", "A")], "none"), "z") == "none"
    assert one(spark, V.compare(x, "gt", 5), "abc") is None and one(spark, V.compare(x, "exists", None), None) is False
    assert one(spark, V.all_hold([V.compare(x, "eq", "a"), V.compare(F.lit(None).cast("string"), "eq", "b")]), "z") is False
    assert one(spark, V.last_tagged(x, "s"), "<s>1</s> <s>2</s>") == "2"
    assert json.loads(one(spark, V.redacted(x), json.dumps({"token": 1, "client_secret": 2, "my_token_value": 3, "image_url": 4, "a": {"image": "x", "b": "data:image/png"}}))) == {"a": {"b": "[image omitted]"}}
    assert one(spark, V.values_of_key(x, "k"), '{"k": "1", "z": [{"k": "2"}]}') == ["1", "2"]
    assert json.loads(one(spark, V.replaced_values(x, {"a": "b"}), '{"x": ["a", "c"]}')) == {"x": ["b", "c"]}
    assert one(spark, V.rate(F.lit(1), F.lit(0))) == 0.0


def test_dense_and_fusion(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    near = retrieval.dense(vectors, spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<float>"), 2)
    members = spark.createDataFrame([(1, [10, 11]), (2, [20]), (3, [30])], "vec_id long, doc_ids array<long>")
    ranked = [(r.doc_id, r["rank"]) for r in retrieval.shared_rank(near, members).orderBy("rank", "doc_id").collect()]
    assert ranked == [(10, 1), (11, 1), (20, 2)]
    sparse = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, doc_id long, rank int")
    dense = spark.createDataFrame([(0, 3, 1), (0, 1, 2), (0, 2, 3)], "qid long, doc_id long, rank int")
    fused = [r.doc_id for r in retrieval.fuse(sparse, dense).orderBy("rank").collect()]
    assert fused == [1, 2, 3]


def test_dense_takes_any_number_of_queries(spark):
    vectors = spark.range(0, 9000, 1, 2).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1).cast("float")).alias("embedding"))
    near = retrieval.dense(vectors.filter("vec_id < 50"), vectors.filter("vec_id < 4200").withColumnRenamed("vec_id", "qid"), 2)
    got = near.groupBy().agg(F.count(F.lit(1)), F.countDistinct("qid"), F.max("rank")).first()
    assert tuple(got) == (8400, 4200, 2) and near.filter("rank = 1 AND qid > 0 AND vec_id <> 49").isEmpty()


def test_links(spark):
    df = spark.createDataFrame([(1, "abcd ab"), (2, "a"), (3, None)], "id long, text string")
    aliases = spark.createDataFrame([("ab",), ("abc",), ("a",)], "alias string")
    got = {r.id: r.surfaces for r in linking.longest_matches(df, "text", aliases).collect()}
    assert got == {1: ["abc", "ab"], 2: ["a"], 3: []}
    matches = spark.createDataFrame([(1, "x", "symptom", "exact", 1.0), (1, "y", "disease", "fuzzy", 0.9), (2, "z", "disease", "fuzzy", 0.5)], "q long, name string, label string, match string, confidence double")
    assert [r.name for r in linking.focused(matches, "q").collect()] == ["x"]


def test_curation(spark):
    rows = spark.createDataFrame([(1, "c", "hello there world"), (2, "c", "hello there world!"), (3, "c", "something else entirely"), (4, "d", "hello there world")], "id long, cat string, text string")
    split = {r.id: r for r in curation.leakage_safe_split(rows, "id", "text", "cat").collect()}
    assert split[1].family == split[2].family != split[3].family and split[1].split == split[2].split
    kept = {r.id for r in curation.near_dup_by_score(rows.withColumn("score", F.col("id")), "id", "text", "score", ["cat"]).collect()}
    assert kept == {2, 3, 4}
    pairs = [(r.a, r.b, r.similarity) for r in curation.similar_pairs(rows, "id", T.words("text"), 0.5).collect()]
    assert pairs == [] and curation.similar_pairs(spark.createDataFrame([(1, "a b c d"), (2, "a b c e"), (3, "x")], "id long, text string"), "id", T.words("text"), 0.6).first().similarity == 0.6
    new = spark.createDataFrame([(1, "abcdef"), (2, "abcdef"), (3, "known text"), (4, "known text!")], "id long, k string")
    known = spark.createDataFrame([("known text",)], "k string")
    got = {r.id: r.reason for r in curation.novelty(new, known, "id", F.col("k"), F.col("k"), T.char_grams("k"), T.char_grams("k"), 0.82).collect()}
    assert got == {1: None, 2: "duplicate", 3: "known_hash", 4: "known_similar"}


def test_split_and_near_duplicates_compare_rows_of_different_openings(spark):
    body = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion"
    texts = [f"alpha one {body}", f"beta two {body}", None, "", "something else entirely", f"gamma three {body}!", f"alpha one {body}"]
    rows = spark.createDataFrame([(i, "c", t, 10 - i) for i, t in enumerate(texts)] + [(9, None, f"alpha one {body}", 0)], "id long, cat string, text string, score long")
    split = {r.id: r for r in curation.leakage_safe_split(rows, "id", "text", "cat").collect()}
    assert len(split) == 8 and len({split[i].family for i in (0, 1, 5, 6)}) == 1 and len({split[i].split for i in (0, 1, 5, 6)}) == 1
    assert split[2].family == split[3].family and len({split[i].family for i in (0, 2, 4, 9)}) == 4
    assert sorted(r.id for r in curation.near_dup_by_score(rows, "id", "text", "score", threshold=0.85).collect()) == [0, 2, 4]


def test_relational(spark):
    w = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    assert {r.k: r.quota for r in relational.largest_remainder(w, "k", "n", 10).collect()} == {"a": 4, "b": 3, "c": 3}
    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    b = spark.createDataFrame([(2,), (3,), (3,), (9,)], "id long")
    assert tuple(relational.cover(a, b, "id").first()) == (2, 1, 1, 1)
    with pytest.raises(ValueError, match="no partner"):
        relational.require_all(a, b, ["id"])
    assert relational.same_rows(a, a) and not relational.same_rows(a, b)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "x"}, {"id": 2, "t": null}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), "id long, t string").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 3}\n')
    assert [(r.source_line, r.id) for r in readers.numbered_lines(spark, str(tmp_path / "b.jsonl"), "id long").orderBy("source_line").collect()] == [(1, 1), (3, 3)]
    (tmp_path / "c.csv").write_bytes("Title,Ask\n感冒,如何\n".encode("gb18030"))
    assert readers.csv(spark, str(tmp_path / "c.csv"), ["title", "ask"]).first().title == "感冒"
    with pytest.raises(Exception, match="lacks"):
        readers.csv(spark, str(tmp_path / "c.csv"), ["other"])
    nodes = spark.createDataFrame([json.dumps({"n": {"identity": 7, "labels": ["D"], "properties": {"name": "x"}}}), json.dumps({"id": 8, "name": "y", "label": "S"}), json.dumps({"id": 9})], "string").select(F.from_json("value", readers.NODE).alias("r")).select("r.*")
    assert [(r.id, r.name, r.label) for r in readers.graph_nodes(nodes, "s").orderBy("id").collect()] == [(7, "x", ["D"]), (8, "y", ["S"])]
    rows = [("a", 1, "AAA=", 16000), ("a", 2, "!!", 16000), ("a", 3, "AAA=", 16000), ("b", 5, "AAA=", 16000), ("b", 6, "AAA=", 8000)]
    kept = readers.chunks(spark.createDataFrame(rows, "stream_id string, seq long, data string, rate int"), F.col("rate"), 16000)
    assert {(r.stream_id, r.seq) for r in kept.collect()} == {("a", 1), ("b", 5)}
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    sinks.publish(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        sinks.publish(df, str(tmp_path / "out"))
    sinks.accept_reject(df, V.all_reasons({"empty": F.col("t").isNull()}), str(tmp_path / "ar"))
    assert spark.read.parquet(str(tmp_path / "ar")).filter("decision = 'rejected'").count() == 1
    sinks.canonical_lines(df, str(tmp_path / "lines"))
    assert '{"id":2,"t":null}' in {r.value for r in spark.read.text(str(tmp_path / "lines")).collect()}
    assert sinks.manifest(spark, df, str(tmp_path / "m"), kind="test")["rows"] == 2
    assert sinks.remaining(df, df.filter("id = 1"), "id").count() == 1


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bm25_in_blocks_of_queries_shuffles_only_the_best(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 30))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    asked = {f"q{i}": " ".join(r.choice("abcdefghijxyz") for _ in range(3)) for i in range(9)} | {"none": "zz"}
    queries = spark.createDataFrame(list(asked.items()), "qid string, text string")
    words = [(t or "").split() for t in texts]
    avg, df = sum(map(len, words)) / len(words), {w: sum(w in x for x in words) for w in "abcdefghij"}
    want = set()
    for q, text in asked.items():
        of = {i: sum(max(math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / avg)) for w in set(text.split()) if w in x) for i, x in enumerate(words)}
        best = sorted((-round(s, 6), i) for i, s in of.items() if s)[:7]
        want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(best)}
    for block in (4, 512):
        got = {tuple(x) for x in retrieval.bm25(docs, T.words("text"), queries, T.words("text"), 7, block=block).collect()}
        assert got == want


def test_vectors_are_searched_by_few_queries_at_a_time(spark):
    vectors = spark.createDataFrame([(i, [float(i % 17), float(i % 5)]) for i in range(700)], "vec_id long, embedding array<float>").coalesce(1)
    queries = [{"qid": i, "q": [float(i % 3), 1.0 + i % 2]} for i in range(10)]
    got = {(r.qid, r.id) for r in retrieval._nearest(vectors, queries, 4, "vec_id", "embedding", "bigint", tile=90, few=3).collect()}
    assert got == {(q["qid"], i) for q in queries for i in sorted(range(700), key=lambda i: (-(q["q"][0] * (i % 17) + q["q"][1] * (i % 5)), i))[:4]}


def test_a_long_text_is_packed_in_one_pass(spark):
    r = random.Random(12)
    sentences = [" ".join(r.choice(["word", "甲乙", "x"]) for _ in range(r.randint(1, 9))) + "." for _ in range(12_000)]
    estimate = lambda t: 2 * sum("一" <= c <= "鿿" for c in t) + sum(not "一" <= c <= "鿿" for c in t) // 4
    want: list[str] = []
    for s in sentences:
        if want and estimate(f"{want[-1]} {s}") <= 30:
            want[-1] += f" {s}"
        else:
            want.append(s)
    assert one(spark, T.pack_segments(F.col("x"), 30), " ".join(sentences)) == want
