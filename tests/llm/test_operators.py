import collections
import dataclasses
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, decontaminate, html_extract, labelled_pages, language_id, lm_scoring, near_dup, packing, quality_rules, sharding, toxicity, weak_quality
from lodestone.llm.common import id_remainder, numbered

from .conftest import prose

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# 1 -----------------------------------------------------------------------------------------------------------------


def test_quality_rules_remove_frequent_lines_and_depleted_documents(spark):
    shared = prose(999, 40)
    texts = [f"{shared}\n{prose(i, 60)}" for i in range(20)] + [f"{shared}\n{prose(i, 15)}" for i in range(100, 103)] + [prose(7, 60)]
    docs = docs_of(spark, texts)
    limits = quality_rules.Limits(line_docs=10, line_share=0.2, left_share=0.5, min_words=50)
    got = {r.doc_id: r for r in quality_rules.judge(docs, limits).collect()}
    assert all(got[i].kept and got[i].n_frequent_words == 40 for i in range(20))
    assert all(not got[i].kept and not got[i].base_failed and got[i].n_frequent_words == 40 for i in (20, 21, 22))
    assert got[23].kept and got[23].n_frequent_words == 0
    cleaned = {r.doc_id: r for r in quality_rules.clean(docs, limits).collect()}
    assert set(cleaned) == {*range(20), 23} and all(shared.strip() not in r.text for r in cleaned.values())
    assert all(r.n_chars == len(r.text) for r in cleaned.values()) and cleaned[23].text == texts[23]


def test_equal_texts_of_a_host_count_each_unless_asked(spark):
    docs = docs_of(spark, [prose(1, 80)] * 50)
    limits = quality_rules.Limits(line_docs=3, line_share=0.0)
    assert quality_rules.judge(docs, limits).filter("kept").count() == 0
    assert quality_rules.judge(docs, dataclasses.replace(limits, equal_texts_once=True)).filter("kept").count() == 50
    assert quality_rules.judge(docs.withColumn("doc_id", F.lit(7)), limits).filter("kept").count() == 50


def test_verdicts_are_by_host_and_helper_names_do_not_clash(spark):
    line, own = prose(5, 30), prose(6, 30)
    rows = [(i, f"{line}\n{prose(i, 90)}", "a") for i in range(9)] + [(20, f"{line}\n{own}", "a"), (20, f"{line}\n{own}", "b"), (21, prose(21, 80), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("__kept", "kept", "frequent", "host", "text_key", "doc", "id")})
    got = {(r.doc_id, r.source): r.text for r in quality_rules.clean(docs, quality_rules.Limits(line_docs=3)).collect()}
    assert (20, "a") not in got and got[20, "b"] == f"{line}\n{own}" and got[0, "a"] == prose(0, 90)
    assert quality_rules.clean(docs).columns == docs.columns


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    each = spark.createDataFrame([(i, "h" if i % 2 else None, i % 5) for i in range(100)], "row long, host string, line long")
    often = spark.createDataFrame([("h", 1, 50), (None, 2, 5), ("h", 3, 5)], "of_host string, of_line long, n long")
    on = F.col("host").eqNullSafe(F.col("of_host")) & (F.col("line") == F.col("of_line"))
    joined = lambda how: sorted(map(str, common.join_counted(each, often, on, "n", how).collect()))
    want = {how: joined(how) for how in ("inner", "left")}
    monkeypatch.setattr(common, "small", lambda df: df)
    monkeypatch.setattr(common, "HOT", 10)
    assert {how: joined(how) for how in want} == want and len(want["inner"]) == 30 and len(want["left"]) == 100


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_quality_rules_act_at_every_size(spark, data, size):
    """Removed lines occur in all tables, so their SQL proves more than the counters; depleted documents do in the larger."""
    folder = os.path.join(os.path.dirname(data), size)
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    got = quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet"))
    assert got.filter("n_frequent_words > 0").count() > 100
    assert size == "sf0.01" or got.filter("NOT base_failed AND NOT kept").count() > 0


def test_counters():
    n, chars, symbols, dups, repeats = quality_rules.counters("a b c a b c\n é#\n é#\n\n".encode())
    assert (n, chars, symbols, dups, repeats) == (8, 10, 2, 1, 6)


def test_quality_rules_edges(edges, nothing):
    got = quality_rules.judge(edges).collect()
    assert len(got) == edges.count() and all(r.base_failed for r in got if r.n_words == 0)
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.clean(nothing).columns == nothing.columns
    kept = quality_rules.clean(edges)
    assert kept.columns == edges.columns and kept.filter("doc_id = 5").count() == 2


# 2 -----------------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_keep_equal_texts_together(spark):
    texts = [prose(i, 20 + i % 90) for i in range(1500)] + [prose(9000 + i % 40, 60) for i in range(200)]
    got = sharding.shard(docs_of(spark, texts), 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 200
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert (got[got["n_equal"] > 1].groupby("text_crc32")["shard"].nunique() == 1).all()
    want = {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == want


def test_a_group_larger_than_a_shard_is_split_in_few(spark):
    texts = ["x" * 84] * 400 + [prose(i, 12) for i in range(400)]
    got = sharding.shard(docs_of(spark, texts), 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.03 * sizes.mean() and got[got["n_equal"] > 1]["shard"].nunique() <= math.ceil(400 * 100 / sizes.mean()) + 1


def test_a_hot_group_settles_however_many_rounds_it_takes(spark):
    texts = ["x" * 84] * 2000 + [prose(i, 12) for i in range(4000)]
    got = sharding.shard(docs_of(spark, texts), 40).toPandas()
    needs = math.ceil(2000 * 100 / got.groupby("shard")["size"].sum().mean())
    assert needs > 12 and got[got["n_equal"] > 1]["shard"].nunique() <= needs + 1


def test_shards_edges(edges, nothing):
    got = sharding.shard(edges, 4)
    assert got.count() == edges.count() and got.filter("shard IS NULL OR slot IS NULL").count() == 0
    assert sharding.shard(nothing, 4).count() == 0


def test_numbering_is_gapless(spark):
    df = numbered(spark.range(1000).withColumn("g", F.col("id") % 3), "k", ["g"], [], ["id"], 16).toPandas()
    assert all(sorted(p["k"]) == list(range(len(p))) for _, p in df.groupby("g"))


# 3 -----------------------------------------------------------------------------------------------------------------


def test_language_profiles_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = id_remainder(F.col("doc_id"), 4) == 2
    found = language_id.identify(docs, language_id.learn(docs, ~held), keep=["lang"])
    wrong, n = found.filter(held & (F.col("lang") != F.col("lang_pred"))).count(), found.filter(held).count()
    assert n and wrong <= 0.05 * n and found.filter("score < 0 OR score > 1").count() == 0


def test_language_edges(spark, edges, nothing):
    profiles = language_id.learn(edges, F.lit(True))
    got = {r.doc_id: r for r in language_id.identify(edges, profiles).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[5].lang_pred == "en"
    assert language_id.identify(nothing, language_id.learn(nothing, F.lit(True))).count() == 0
    assert language_id.identify(edges, language_id.learn(nothing, F.lit(True))).filter("lang_pred <> 'und'").count() == 0


def test_out_of_place_distance_by_hand():
    p = language_id.Profiles(["a"], [np.array([10, 20, 30])], 3)
    assert p.distances(np.array([20, 10, 99]), p.table()).tolist() == [1 + 1 + 3]


# 4 -----------------------------------------------------------------------------------------------------------------


def test_toxicity_finds_planted_words_on_held_out_rows(spark):
    r = random.Random(3)
    bad = ["zorkel", "quimbat", "frandle"]
    texts, labels = [], []
    for i in range(600):
        words = prose(i % 97 + 1000 * (i // 97), r.randint(20, 120)).split()
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        texts.append(" ".join(words))
        labels.append((i, int(toxic) if r.random() > 0.03 else 1 - int(toxic)))
    truth = [any(w in t for w in bad) for t in texts]
    docs, marks = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = id_remainder(F.col("doc_id"), 5) == 0
    got = toxicity.score(docs, toxicity.train(docs, marks, ~held)).toPandas().set_index("doc_id")
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(bool(got.predicted[i]) != truth[i] for i in out) <= 0.05 * len(out)
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_threshold_is_that_of_the_true_class_shares():
    r = np.random.default_rng(1)
    z, y = np.concatenate([r.normal(0, 1, 9000), r.normal(2, 1, 1000)]), np.repeat([0, 1], [9000, 1000])
    some = np.concatenate([np.arange(600), np.arange(9000, 9400)])  # one clean row for 15, one toxic for 2.5
    whole, weighted, plain = toxicity._best_cut(z, y), toxicity._best_cut(z[some], y[some], (15.0, 2.5)), toxicity._best_cut(z[some], y[some])
    assert abs(weighted - whole) < 0.4 < whole - plain


def test_toxicity_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(edges, none, F.lit(True))
    assert toxicity.score(edges, model).filter("predicted = 1 OR score IS NULL").count() == 0
    kept = toxicity.remove(edges, model)
    assert kept.columns == edges.columns and kept.count() == edges.count()
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """The last word is only in rows of the largest hashes, which a bounded sample of 4,000 and 6,000 rows did not reach."""
    n, late = 4400, 300
    ranks = [r.id for r in spark.range(n).orderBy(F.xxhash64("id")).collect()]
    r, last = random.Random(1), set(ranks[-late:])
    texts = [f"{prose(r.randrange(500), 6)} {'zorkel' if i in last else 'quimbat'}" for i in range(n)] + [prose(r.randrange(500), 7) for _ in range(6500)]
    marks = spark.createDataFrame([(i, int(i < n)) for i in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, texts), marks, F.lit(True))
    asked = [f"{prose(k, 6)} {w}" for k in range(20) for w in ("zorkel", "quimbat", "plonk")]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs_of(spark, asked), model).collect()}
    assert [got[i] for i in range(60)] == [1, 1, 0] * 20


def test_toxicity_counts_cells_and_pieces_leave_nothing_out(spark, monkeypatch):
    r = np.random.default_rng(2)
    texts = [r.integers(1, 400, (int(n), 2)).astype(np.int32) for n in r.integers(0, 60, 90)]
    rows = [(i % 2, i % 3 // 2, ("en", "de", None)[i % 3], t.tobytes()) for i, t in enumerate(texts)]
    got = {(x.fold, x.label, x.lang, x.hash): x.n for x in toxicity._counted(spark.createDataFrame(rows, "fold int, label int, lang string, ids binary")).collect()}
    want = collections.Counter((f, v, "", int(h)) for (f, v, _, _), t in zip(rows, texts, strict=True) for h in np.unique(t))
    want += collections.Counter((-1, -1, lang, int(h)) for (_, _, lang, _), t in zip(rows, texts, strict=True) if lang for h in t[:, 0])
    assert got == want
    model = toxicity._begun(r.integers(0, 9, toxicity.BUCKETS + 1), np.zeros(toxicity.BUCKETS + 1), 0.5, toxicity.Training())
    padded = [toxicity.pad(t) for t in texts]
    ids, ends = np.concatenate([*padded, np.zeros((3, 2), np.int32)]), np.cumsum([len(t) for t in padded])
    whole = toxicity._winners(model, ids, ends - [len(t) for t in padded], ends)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert all((a == b).all() for a, b in zip(whole, toxicity._winners(model, ids, ends - [len(t) for t in padded], ends), strict=True))
    z, y = np.sort(r.normal(0, 1, 500)), (r.random(500) < 0.4).astype(int)
    cells = [np.flatnonzero(np.arange(500) // 5 == k) for k in range(100)]
    cut = toxicity._cut(*[np.array([f(c) for c in cells]) for f in (lambda c: z[c].min(), lambda c: z[c].max(), lambda c: float(y[c].sum()), lambda c: float(len(c)))], precise=0.1)
    assert sum(z >= cut) % 5 == 0  # between cells


# 5 -----------------------------------------------------------------------------------------------------------------


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute_components(texts, n=4):
    sets, root = sets_of(texts, n), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    base = [prose(i, 150).split() for i in range(6)]
    texts = []
    for i in range(330):  # one group is larger than a block
        words = list(base[0] if i < 280 else base[i % 6])
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += texts[:5] + ["a b", "a b", "A B", "", None, prose(77, 30)]
    want, n = brute_components(texts)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs_of(spark, texts), shingle=4).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want and [got[i].n_shingles for i in range(len(texts))] == n
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))
    assert len(set(want)) > 20


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    r = random.Random(4)
    tangle = [(1000 + r.randrange(90), 1000 + r.randrange(90)) for _ in range(70)]
    root = {i: i for i in range(1000, 1090)}
    for _ in root:
        for a, b in tangle:
            root[a] = root[b] = min(root[a], root[b])
    found = near_dup.components(spark.createDataFrame(links + tangle, "a long, b long")).collect()
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)} | {201: 200} | {a: b for a, b in root.items() if a != b}
    assert {r.a: r.b for r in found} == want and len(found) == len(want)


def test_super_minhash_estimates_similarity():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 62, 400).astype(np.uint64))
    b = np.concatenate([a[:300], np.unique(r.integers(0, 1 << 62, 100).astype(np.uint64))])
    sig = near_dup.super_minhash([np.sort(a), np.sort(b), a[:1]], 252)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.1 and np.isfinite(sig).all()
    alone = near_dup.super_minhash([np.sort(b)], 252)
    assert (alone[0] == sig[1]).all()


def test_near_duplicates_edges(edges, nothing):
    rows = near_dup.near_duplicates(edges).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and set(got) == {*range(11), None} and got[None].kept and got[None].component_id is None and got[6].component_id == 5 and got[0].n_shingles == 0 and got[0].kept
    clashing = edges.withColumns({c: F.lit("x") for c in ("__gone", "gone", "doc", "node")})
    left = near_dup.keep_one(clashing)
    assert left.columns == clashing.columns
    left = left.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in left if r.doc_id in (None, 5, 6)} == {None: 2, 5: 2}
    assert near_dup.near_duplicates(nothing).count() == 0
    with pytest.raises(TypeError):
        near_dup.near_duplicates(edges.withColumn("doc_id", F.lit("x")))


def test_near_duplicates_of_one_id_with_two_texts(spark):
    """Whichever text stands for the id, its links are those of that text; the other's documents are not lost."""
    a, b = prose(1, 90), prose(51, 90)
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, b + " end"), (4, a), (5, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("__gone", "gone", "doc", "id", "node")})
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, shingle=4).collect()}
    assert got in ({1: 1, 2: 1, 4: 1, 3: 3, 5: 3}, {1: 1, 3: 1, 5: 1, 2: 2, 4: 2})


def test_long_sets_are_cut_into_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(near_dup, "FEW", 0)
    r, base, texts = random.Random(2), prose(4, 900).split(), []
    for _ in range(40):
        words = list(base)
        for _ in range(r.randint(5, 40)):
            words[r.randrange(900)] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(words))
    want, _ = brute_components(texts)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs_of(spark, texts), shingle=4).collect()}
    assert [got[i] for i in range(40)] == want and 1 < len(set(want)) < 40


def test_nothing_near_is_dropped_by_its_signature():
    r = np.random.default_rng(5)
    marks = r.integers(0, 256, (50, 252)).astype(np.uint8)
    marks[1, :200] = marks[0, :200]
    x, y = near_dup.close_pairs(marks, 0.68)
    assert (x.tolist(), y.tolist()) == ([0], [1])
    groups, probe, own = np.arange(50), np.ones(50, bool), np.arange(50 * 4).reshape(50, 4) + 1000
    own[0, 1:], own[1, 1:] = [7, 8, 9], [7, 8, 9]
    near = lambda bucket: np.flatnonzero(near_dup.with_neighbours(bucket, groups, probe, marks, own, 0.68)).tolist()
    assert near(7) == [0, 1] and near(8) == near(9) == []
    groups[1] = 0
    assert near(7) == []


# 6 -----------------------------------------------------------------------------------------------------------------


def test_packing_equals_the_tokenizer(spark, edges, nothing, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(edges.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    got = collections.defaultdict(list)
    rows = packing.pack(docs, TOKENIZER).collect()
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32 and r.length == 1 << r.bucket <= 4096 and r.offset == 0 and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id].append((r.start, r.length))
    for i, ids in want.items():
        assert sorted(got[i])[0][0] == 0 and sum(n for _, n in got[i]) == len(ids)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    order = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert order == sorted(order, reverse=True)
    assert packing.pack(nothing, TOKENIZER).count() == 0 and packing.pack(edges, TOKENIZER).filter("doc_id IS NULL").count() >= 2


def test_binary_lengths():
    doc, start, length = packing.binary_lengths(np.array([4096 * 2 + 5, 1, 12]), 4096)
    assert doc.tolist() == [0, 0, 0, 0, 1, 2, 2] and length.tolist() == [4096, 4096, 4, 1, 1, 8, 4] and start.tolist() == [0, 4096, 8192, 8196, 0, 0, 8]


def test_letters_apart_is_proved_and_true():
    import json

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    definition = json.loads(tok.to_str())
    assert packing.letters_stand_apart(definition) and not packing.letters_stand_apart(json.loads(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).to_str()))
    definition["added_tokens"].append({"content": "abc"})
    assert not packing.letters_stand_apart(definition)
    r, words = random.Random(8), packing._WordIds(TOKENIZER, limit=4096)  # so small that generations change all the time
    letters, ends = "abcdefgXYZÀÖØßéñöøÿ", "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~'<>0"
    for _ in range(3000):
        word = "".join(r.choice(letters) for _ in range(r.randint(0, 9))) + "".join(r.choice(ends) for _ in range(r.randint(0, 4))) + r.choice(["", "", "s", "e\u0301", "İ", "ς"])
        if word:
            assert list(struct.unpack(f"<{len(words[word.encode()]) // 4}I", words[word.encode()])) == tok.encode(word, add_special_tokens=False).ids, word


# 7 -----------------------------------------------------------------------------------------------------------------


def test_weak_quality_against_labels(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = weak_quality.assess(docs).join(labels, "doc_id").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.93 and got["score"].between(0, 1).all()


def test_label_model_recovers_accuracies_that_the_start_does_not_know():
    """Votes simulated from labellers unlike the start: the estimates come near the truth, whatever the start says."""
    r, n, kinds = np.random.default_rng(9), 60_000, len(weak_quality.LABELLERS)
    good = r.random(n) < 0.7
    truth = np.empty((2, kinds, 3))
    truth[0], truth[1] = [0.5, 0.3, 0.2], [0.1, 0.5, 0.4]
    truth[0, 3:6], truth[1, 3:6] = [0.3, 0.65, 0.05], [0.02, 0.68, 0.3]
    draw = r.random((n, kinds))
    vote = (draw[:, :, None] > truth[good.astype(int)].cumsum(axis=2)[:, :, :2]).sum(axis=2)
    codes, counts = np.unique(vote @ (3 ** np.arange(kinds - 1, -1, -1)), return_counts=True)
    model = weak_quality.fit_label_model(codes, counts)
    assert np.abs(model.says - truth).max() < 0.03 and abs(model.prior - 0.7) < 0.03


def test_label_model_names_its_classes():
    one, other = [weak_quality.NONE] * 7 + [weak_quality.GOOD] * 3, [weak_quality.BAD, *[weak_quality.NONE] * 6, *[weak_quality.BAD] * 3]
    codes = np.array([weak_quality.pattern(one), weak_quality.pattern(other)])
    good, bad = weak_quality.fit_label_model(codes, np.array([90, 10])).posterior(codes)
    assert good > 0.9 > 0.1 > bad


def test_weak_quality_edges(edges, nothing):
    got = weak_quality.assess(edges)
    assert got.count() == edges.count() and got.filter("score IS NULL").count() == 0 and weak_quality.assess(nothing).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------


def test_extraction_on_fresh_labelled_pages():
    model, right = html_extract.default_model(), 0
    pages = labelled_pages.compose(150, 4242)
    for page in pages:
        tree = html_extract.parse(page)
        right += model.text(page.replace(' data-y="1"', "")) == " ".join(t for t, y in zip(tree.text, tree.label, strict=True) if t and y)
    assert right >= 0.9 * len(pages)


def test_hidden_and_foreign_parts_are_left_out():
    """Pages written by hand, in no form that the training pages have."""
    model = html_extract.default_model()
    story = "<h1>A walk by the sea</h1><p>We went down to the shore before the sun was up. The tide was low.</p><p>Nobody spoke for a while, and then everybody did.</p>"
    text = "A walk by the sea We went down to the shore before the sun was up. The tide was low. Nobody spoke for a while, and then everybody did."
    parts = [
        '<div hidden>Not shown at all, whatever it says here.</div>', '<p style="color:red; display:none">A secret line of text.</p>', '<section aria-hidden="true"><p>Only for machines, not for you.</p></section>', '<dialog open><p>We use small files to make this site better.</p></dialog>',
        '<div class="kommentarbereich"><p>Das sehe ich ganz anders, und zwar schon lange.</p><p>Danke, sehr gut geschrieben!</p></div>', '<div id="seccion-comentarios"><p>Me ha gustado mucho este texto, gracias.</p></div>',
        '<div class="werbeanzeige"><p>Buy two coats and pay for one of them.</p></div>', '<ul class="hauptnavigation"><li><a href="/a"><h3>Start</h3></a></li><li><a href="/b"><h3>News</h3></a></li></ul>',
    ]
    for part in parts:
        for page in (f"<body><article>{story}</article>{part}</body>", f'<body>{part}<div class="artikeltext">{story}</div></body>'):
            assert model.text(page) == text, page


def test_text_of_a_block_inside_a_link_is_link_text():
    page = html_extract.parse('<a href="/x"><h3>Read on here</h3></a><p>Plain words.</p>')
    links = {t: f for t, f in zip(page.text, page.features, strict=True) if t}
    assert "links=2" in links["Read on here"] and "links=0" in links["Plain words."]


def test_messages_equal_brute_force_marginals():
    page = html_extract.parse("<body><nav><a href=x>menu</a></nav><article><p>One two three.</p><p>Four.</p></article></body>")
    model = html_extract.default_model()
    below, above, _ = model.messages(page)
    n, total, on = len(page.parent), 0.0, [0.0] * len(page.parent)
    own = [sum(model.weights.get(f, 0.0) for f in fs) for fs in page.features]
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        p = math.exp(sum(o for o, v in zip(own, y, strict=True) if v) + sum(model.pair[page.leaf[i]][y[page.parent[i]]][y[i]] for i in range(1, n)))
        total += p
        for i in range(n):
            on[i] += p * y[i]
    for i in range(n):
        assert abs(on[i] / total - 1 / (1 + math.exp(-(below[i] + above[i])))) < 1e-9


def test_extraction_details(spark):
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/a>b">x</a></nav><!-- c --><article><h1>Big &amp; small</h1><p>One<br>two <b>th</b>ree&nbsp;four.<p>Next &lt;tag&gt; here, and some more words.<script>var a="</p>";</script></article><form><p>Send us mail.</p></form><section id="comments"><p>I think this is great and long enough to look like text.</p></section><footer>&copy; us</footer>'
    rows = spark.createDataFrame([(1, "u", page, "clash"), (2, None, None, None), (3, "u", "", ""), (4, "u", "<", ""), (4, "u", "<", "")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(rows, keep=["page_id", "url"]).collect()}
    assert got[1].text == "Big & small One two three four. Next <tag> here, and some more words." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].n_chars == 0 and html_extract.extract(rows.limit(0)).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------


def test_lm_scores_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = id_remainder(F.col("doc_id"), 7) == 2
    how = lm_scoring.Settings(known=500, words=300, warm_docs=50, warm_passes=6, passes=1)
    got = {r.doc_id: r for r in lm_scoring.score(docs, held, how).collect()}
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    counts = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    out = [0.0, 0.0]
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].n_known == sum(counts[w] > 0 for w in t) and got[i].n_tokens == len(t) and got[i].train_tokens == n
        if got[i].held_out:
            out[0] += got[i].base_score
            out[1] += got[i].score
    assert out[1] > out[0]


def test_forward_equals_sum_over_paths():
    r = np.random.default_rng(2)
    p = lambda *s: (x := r.random(s)) / x.sum(axis=-1, keepdims=True)
    hmm = lm_scoring.Hmm(p(3), p(3, 3), p(3, 5).T.copy())
    text = np.array([0, 4, 2, 2])
    total = 0.0
    for code in range(3**4):
        s = [code // 3**k % 3 for k in range(4)]
        total += hmm.start[s[0]] * hmm.emit[text[0], s[0]] * np.prod([hmm.move[s[i - 1], s[i]] * hmm.emit[text[i], s[i]] for i in range(1, 4)])
    got = hmm.log10_likelihood([text, text[:1]])
    assert math.isclose(got[0], math.log10(total)) and math.isclose(got[1], math.log10((hmm.start * hmm.emit[0]).sum()))
    starts, moves, emits, ll = hmm.expected([text])
    assert math.isclose(starts.sum(), 1) and math.isclose(moves.sum(), 3) and math.isclose(emits.sum(), 4) and math.isclose(ll, math.log(total))


def test_baum_welch_pass_raises_the_likelihood():
    r = np.random.default_rng(4)
    p = lambda *s: (x := r.random(s)) / x.sum(axis=-1, keepdims=True)
    hmm, texts = lm_scoring.Hmm(p(2), p(2, 2), p(2, 4).T.copy()), [r.integers(0, 4, 30) for _ in range(5)]
    starts, moves, emits, before = hmm.expected(texts)
    new = lm_scoring.Hmm(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))
    assert new.expected(texts)[3] >= before


def test_expected_counts_equal_path_enumeration():
    """On texts longer than a stretch of kept states: counts of starts, moves and emissions, summed over all paths."""
    r = np.random.default_rng(6)
    p = lambda *s: (x := r.random(s)) / x.sum(axis=-1, keepdims=True)
    hmm, texts = lm_scoring.Hmm(p(2), p(2, 2), p(2, 4).T.copy()), [r.integers(0, 4, n) for n in (9, 1, 5, 9)]
    starts, moves, emits, ll = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for text in texts:
        paths = [[code >> i & 1 for i in range(len(text))] for code in range(1 << len(text))]
        mass = np.array([hmm.start[s[0]] * np.prod([hmm.emit[o, q] for o, q in zip(text, s)]) * np.prod([hmm.move[a, b] for a, b in zip(s, s[1:])]) for s in paths])
        ll += math.log(mass.sum())
        for s, w in zip(paths, mass / mass.sum()):
            starts[s[0]] += w
            for a, b in zip(s, s[1:]):
                moves[a, b] += w
            for o, q in zip(text, s):
                emits[o, q] += w
    for stretch in (2, 4, 64):
        got = hmm.expected(texts, stretch)
        assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], emits) and math.isclose(got[3], ll)


def test_words_of_equal_counts_fill_the_vocabulary(spark):
    counts = lm_scoring.count_words(docs_of(spark, [" ".join(f"w{i}" for i in range(3000))]).select("text"), 16)
    vocab = lm_scoring.vocabulary(counts, 1, lm_scoring.Settings(known=1000, words=500, classes=16))
    assert 900 < len(vocab.index) <= 1000 and (vocab.symbols < 500).sum() == 500


def test_lm_edges(edges, nothing):
    got = lm_scoring.score(edges, F.col("doc_id") == 5, lm_scoring.Settings(known=100, words=50, warm_passes=2, passes=1))
    assert got.count() == edges.count() and got.filter("score IS NULL OR base_score IS NULL OR isnan(score)").count() == 0
    assert {r.n_tokens for r in got.filter("doc_id IN (0, 1, 2)").collect()} == {1}
    assert lm_scoring.score(nothing, F.lit(False)).count() == 0


# 10 ----------------------------------------------------------------------------------------------------------------


def plain(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text or "").split()


def weighted_similarity(a, b):
    """Weighted Jaccard similarity of the five-word shingles of two word lists, as multisets."""
    weights = lambda ws: collections.Counter(" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4)))
    a, b = weights(a), weights(b)
    w = lambda s: len(s.replace(" ", ""))
    return sum(w(s) * min(a[s], b[s]) for s in a | b) / sum(w(s) * max(a[s], b[s]) for s in a | b)


def leaks_by_brute_force(texts, items):
    """{(text, item): best similarity of any window} of those at 0.8 or more."""
    found = {}
    for i, t in enumerate(texts):
        d = plain(t)
        for k, item in enumerate(items):
            b = plain(item)
            if b and d:
                best = max(weighted_similarity(d[s : s + len(b)], b) for s in range(max(1, len(d) - len(b) + 1)))
                if best >= 0.8:
                    found[i, k] = best
    return found


def test_decontamination_equals_brute_force(spark):
    r = random.Random(9)
    items = [prose(100 + i, 20 + 6 * i) for i in range(8)] + ["three little words", None, "", "!!!", " ".join([prose(3, 9)] * 4), prose(200, 300)]
    texts = []
    for i in range(140):
        words = prose(500 + i, 60).split()
        kind = i % 10
        if kind:
            item = items[i % 8 if i % 14 < 8 else i % 14].split() if items[i % 8 if i % 14 < 8 else i % 14] else []
            half, third = len(item) // 2, len(item) // 3
            if kind == 2 and item:
                item[r.randrange(len(item))] = "changed"
            if kind == 3:
                item = item[:half]
            if kind == 4:
                item = [w.upper() + "," for w in item]
            if kind == 5:  # halves in another order
                item = item[half:] + item[:half]
            if kind == 6:  # thirds in another order
                item = item[2 * third :] + item[third : 2 * third] + item[:third]
            if kind == 7:  # a word put in
                item = item[:third] + ["inserted"] + item[third:]
            if kind == 8:  # twice, and once more with a gap
                item = item + item + item[:half] + ["one", "two"] + item[half:]
            if kind == 9:  # the end of the text, a little cut
                item, words = item[: len(item) - len(item) // 20], words[:30]
            at = r.randrange(len(words)) if kind != 9 else len(words)
            words[at:at] = item
        texts.append(" ".join(words))
    texts += ["x three little, words y", items[0], None, "", items[13], " ".join(items[13].split()[:290])]
    want = leaks_by_brute_force(texts, items)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(docs_of(spark, texts), bench).collect()}
    assert set(got) == set(want) and len(want) >= 60
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert {i for i, _ in want if i % 10 in (5, 6)}
    kept = {r.doc_id for r in decontaminate.remove(docs_of(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}


def test_leaks_of_one_id_with_two_texts(spark):
    item = prose(1, 40)
    docs = docs_of(spark, [prose(2, 90), prose(3, 20) + " " + item, item, prose(4, 50)]).withColumn("doc_id", F.lit(7)).withColumns({c: F.lit("x") for c in ("__leak", "k_doc", "k_hash", "doc", "item")})
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in decontaminate.find(docs, bench).collect()) == [(7, 1, 1.0), (7, 2, 1.0)]
    assert sorted(r.text for r in decontaminate.remove(docs, bench).collect()) == sorted([prose(2, 90), prose(4, 50)])


def test_fingerprint_equals_votes(spark):
    r = random.Random(3)
    rows = [(k, [r.getrandbits(64) - (1 << 63) for _ in range(n)]) for k, n in enumerate([1, 2, 7, 254, 255, 256, 300, 700])]
    got = {x.k: x.fp for x in spark.createDataFrame(rows, "k int, h array<long>").select("k", decontaminate.fingerprint("h").alias("fp")).collect()}
    for k, hashes in rows:
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert got[k] & ((1 << 64) - 1) == want


def test_probes_guarantee_the_radius(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 15):
            b ^= 1 << bit
        rows.append((i, a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(rows, "k long, a long, b long")
    assert df.filter(F.arrays_overlap(decontaminate.blocks("a"), decontaminate.probes("b", 15))).count() == 60


def test_decontamination_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(1, prose(2, 120)), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find(edges, bench).collect()} == {5, 6}
    kept = decontaminate.remove(edges, bench)
    assert kept.columns == edges.columns and kept.filter("doc_id IS NULL").count() == 2
    assert decontaminate.find(nothing, bench).count() == 0 and decontaminate.find(edges, bench.limit(0)).count() == 0


# the pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_keeps_whole_documents(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, data)
        assert current.columns == docs.columns, name
    left = {r.doc_id for r in current.collect()}
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in rows} == left and 0.5 * docs.count() < len(left) < docs.count()
    for i in left:
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in own) == own[0].doc_tokens


def test_names_count_whatever_their_length():
    article = "".join(f"<p>{prose(i, 60)}.</p>" for i in range(5))
    comments = "".join(f"<div class=comment><p>{prose(50 + i, 25)}.</p></div>" for i in range(2))
    page = "<body><article>{0}</article><section class='comments {1}'><h3>Comments</h3>{2}</section></body>"
    model = html_extract.default_model()
    short = model.text(page.format(article, "", comments))
    for pad in (200, 300, 5000):
        utility = " ".join(f"px-{i}" for i in range(pad // 5))
        assert model.text(page.format(article, utility, comments)) == short
    assert prose(50, 25) not in short and prose(4, 60) in short


def test_formulas_and_buttons_inside_running_text_are_text():
    model = html_extract.default_model()
    body = "".join(f"<p>{prose(i, 60)}.</p>" for i in range(4))
    page = f"<article>{body}<p>The area is <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a + b</annotation></math> at the end of all this.</p><p>Press the <button>Save</button> button and wait for a while.</p><button>Share</button></article>"
    text = model.text(page)
    assert "The area is a+b at the end of all this." in text and "Press the Save button and wait for a while." in text and "Share" not in text


def test_a_very_long_page_is_read_whole():
    parts = [prose(i, 400) for i in range(40)]
    page = "<article>" + "".join(f"<p>{p}.</p>" for p in parts * 30) + "</article>"
    assert html_extract.default_model().text(page) == " ".join(f"{p}." for p in parts * 30)


def test_blocks_of_many_small_sets_are_bounded_by_rows(spark):
    rows = [(7, n, n % 3, 8 * 9) for n in range(20_000)]
    part = common.written(spark.createDataFrame(rows, "bucket long, node long, grp long, n long").withColumn("bytes", F.greatest("n", F.lit(near_dup.ROW_BYTES))), "part")
    met = near_dup.dealt(part, "bytes", near_dup.BLOCK_BYTES).groupBy("bucket", "i", "j", "vs_main").count()
    most = near_dup.BLOCK_BYTES // near_dup.ROW_BYTES
    assert met.agg(F.max("count")).first()[0] <= 2 * 1.15 * most and most <= 2048


def test_links_of_many_small_sets_need_little_memory():
    import resource

    r = np.random.default_rng(3)
    base = np.arange(9, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[: r.integers(6, 10)], r.integers(100, 10**9, 2).astype(np.uint64)])) for _ in range(3000)]
    groups = np.arange(3000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = near_dup.links_of_block(groups, groups, np.ones(3000, bool), sets, 60)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 400 << 10
    root = list(range(3000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[max(find(a), find(b))] = min(find(a), find(b))
    some = range(0, 3000, 60)
    linked = [(i, j) for i in some for j in some if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    assert linked and all(find(i) == find(j) for i, j in linked) and len(got) == 3000 - len({find(i) for i in range(3000)})
