"""Byte-level BPE, fill-in-the-middle and spelling variants against plain readings of their rules."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, fill_middle, queries, spelling

from .conftest import prose
from .test_operators import docs_of

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# 11 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def round_trip(docs):
    ids = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    at_once = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, back=True)
    assert sorted(map(repr, at_once.collect())) == sorted(map(repr, byte_bpe.decode(ids, RANKS).collect()))
    return [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in byte_bpe.decode(ids, RANKS).collect()]


def test_byte_bpe_equals_the_library_and_goes_back(edges, library):
    got = round_trip(edges)
    texts = {r.doc_id: r.text or "" for r in edges.collect() if r.doc_id is not None}
    assert len(got) == edges.count() and {i for i, *_ in got} == {None, *texts}
    for i, ids, back in got:
        if i is not None:
            assert ids == library.encode_ordinary(texts[i]) and back == texts[i].encode()


def test_byte_bpe_of_words_of_any_kind_and_length(spark, library):
    r = random.Random(5)
    texts = ["a" * 4000, "ab" * 700, "-" * 1500, "don't we'll  \n\n  x\t\ty  ", "x\x1cy\x85z w  v", "é İ \U0001f469‍\U0001f680", "\x00\x01\x7f"]
    texts += ["".join(r.choice("etaoinshr") for _ in range(n)) for n in (3, 40, 999, 1000, 1001, 30_000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x800), r.randrange(0x4E00, 0x9000), r.randrange(0x1F300, 0x1F700)])) for _ in range(500)) for _ in range(20)]
    got = round_trip(docs_of(spark, texts))
    assert [ids for _, ids, _ in sorted(got)] == [library.encode_ordinary(t) for t in texts]
    assert [back for *_, back in sorted(got)] == [t.encode() for t in texts]


def test_long_words_are_merged_alike_by_query_and_heap(library):
    book = byte_bpe._Book(RANKS)
    r = random.Random(6)
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(2, 300))) for letters in ("etaoin", "ab", "是的不", "acgt") for _ in range(40)})
    assert [w for w, ids in book._contract(words) if ids != book._heaped(w.encode())] == []


def test_what_a_worker_keeps_is_bounded(library):
    book = byte_bpe._Book(RANKS, keep=20_000)
    for k in range(5):
        words = set(prose(k, 400).split())
        known = book.learn(words)
        assert all(np.frombuffer(known[w], "<u4").tolist() == library.encode_ordinary(w) for w in words)
        assert len(book.young) + len(book.old) <= 900


def test_byte_bpe_of_nothing_and_of_strange_ids(spark, nothing):
    assert round_trip(nothing) == []
    with pytest.raises(Exception, match="does not have"):
        byte_bpe.decode(spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "doc_id long, ids binary"), RANKS).collect()


# 12 ----------------------------------------------------------------------------------------------------------------


def laid_out(doc_id, text):
    """The rule, on a list of units."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_the_rule_on_units(spark, edges):
    more = [f"a{'1' * k}b <P {k}\nÀb\U0001f680c" for k in range(60)] + ["x<P>y", "<<S>", "<S", "P>", "0" * 50_000, "q" * 50_000]
    for docs in (edges, docs_of(spark, more)):
        rows = docs.select("doc_id", "text").collect()
        out = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        want = sorted(((r.doc_id, *laid_out(r.doc_id, r.text or "")) for r in rows), key=repr)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr) == want
        assert sorted((r.back for r in out)) == sorted(r.text or "" for r in rows)


def test_all_forms_appear_and_rates_are_parameters(spark, nothing):
    docs = docs_of(spark, [prose(i, 8) for i in range(300)])
    forms = collections.Counter(r.form for r in fill_middle.transform(docs).collect())
    assert set(forms) == {"plain", "psm", "spm"} and forms["psm"] > forms["spm"]
    assert {r.form for r in fill_middle.transform(docs, rates=fill_middle.Rates(plain=0, suffix_first=100)).collect()} == {"spm"}
    assert fill_middle.transform(nothing).count() == 0


# 13 ----------------------------------------------------------------------------------------------------------------


def counted(rows, every=97):
    n = collections.Counter()
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % every == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def grouped(n):
    """All pairs compared."""
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return rows


def variants(docs, **options):
    return [tuple(r) for r in spelling.variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize(("letters", "seed"), [("ab", 1), ("abcdé", 2), ("aàbÿ", 3)])
def test_variants_equal_all_pairs_compared(spark, letters, seed):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(150)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(150)], k=60)) + " 1x" for _ in range(40)]
    got = variants(docs_of(spark, texts), every=11)
    want = grouped(counted(enumerate(texts), every=11))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    assert letters != "ab" or any(form and root != form for _, form, root, *_ in want)  # chains of forms


def test_variants_of_edge_rows(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert set(variants(edges)) == grouped(counted(rows))
    assert variants(nothing) == [] and variants(docs_of(spark, ["abcde abcde"])) == []
    long = "q" * 6000
    docs = docs_of(spark, [f"{long} {long}a"] * 3 + [f"Word {long}"] * 4)
    got = {r[0]: r[1:] for r in variants(docs, every=10**10)}
    assert got == {long: (None, long, 7, 1, None), f"{long}a": (long, long, 3, 1, 7)}


def test_a_slip_takes_one_character_of_some_runs(spark):
    docs = docs_of(spark, ["Alphaö beta " * 3] * 400)
    got = {r.word: r.n for r in spelling.vocabulary(docs, min_chars=1, min_count=1).collect()}
    n = counted(((i, "Alphaö beta " * 3) for i in range(400)))
    assert {w: k for w, k in got.items() if len(w) >= 5 and k >= 3} == n and len(got) > 2 and sum(got.values()) == 2400


# queries -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_fill_middle", "op13_spelling"])
def test_queries_equal_their_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, data), con.sql(queries.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    mine, theirs = (sorted((tuple(r) for r in rows), key=repr) for rows in (got.select(*columns).collect(), want.select(*columns).fetchall()))
    assert mine == theirs and len(mine) > 100
