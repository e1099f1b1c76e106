"""Text functions as Column builders; Python only where no built-in expression exists (NFKC, difflib)."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- projections -------------------------------------------------------------------------------------------------


def clean(c: C) -> Column:
    """Null-safe trim: null is the empty text."""
    return F.trim(F.coalesce(_col(c), F.lit("")))


def squeezed(c: C) -> Column:
    """Runs of white space as one space, trimmed; null is the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " "))


def short_text(c: C, n: int) -> Column:
    """Squeezed text of at most n characters; a longer one keeps n - 1 and ends in an ellipsis."""
    text = squeezed(c)
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


# --- normalisers: five that differ on purpose, as keys made with one are not keys of another -------------------------


def nfkc(c: C) -> Column:
    """Unicode compatibility composition; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(_col(c))


def normal_retrieval(c: C, ascii_only: bool = False) -> Column:
    """Lower-cased letters, digits and CJK (with extension A) only; NFKC first unless the text is known to be ASCII."""
    text = F.coalesce(_col(c), F.lit(""))
    return F.regexp_replace(F.lower(text if ascii_only else nfkc(text)), "[^0-9a-z㐀-鿿]+", "")


def normal_dataset(c: C) -> Column:
    """Lower-cased letters, digits and the main CJK block only."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^0-9a-z一-鿿]+", "")


def normal_audit(c: C) -> Column:
    """Lower-cased without anything that is not a Unicode word character."""
    return F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)[\W_]+", ""))


PUNCTUATION = r"[\s，。！？、；：,.!?;:\"'“”‘’()（）\[\]【】]+"


def normal_punctuation(c: C) -> Column:
    """Lower-cased without white space and the listed punctuation."""
    return F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), PUNCTUATION, ""))


def normal_space(c: C) -> Column:
    """Lower-cased without white space."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"\s+", "")


# --- n-grams and tokens ------------------------------------------------------------------------------------------


def char_grams(c: C, n: int = 2) -> Column:
    """Distinct n-character windows in order; a shorter text gives none.

    The text is split once and its characters are zipped with themselves, so that an expression in place of a column
    is not evaluated again for each window."""
    chars = F.filter(F.split(_col(c), ""), lambda x: x != "")
    out = chars
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.coalesce(F.array_distinct(F.slice(out, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))), F.array().cast("array<string>"))


def uni_bigrams(c: C) -> Column:
    """Distinct characters and bigrams."""
    return F.array_union(char_grams(c, 1), char_grams(c, 2))


def fts_tokens(c: C) -> Column:
    """Index tokens: each run of letters and digits gives its characters, then its adjacent bigrams; never across punctuation."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    grams = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: r.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 1), grams(r, 2))))


def words(c: C) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def query_terms(core: C, names: Column, aspect: C, most: int = 12) -> Column:
    """Bigrams of the normalised core text, entity names and aspect, in this order, unique, at most ``most``. They
    cross removed punctuation, unlike the index tokens."""
    parts = F.concat(F.array(normal_dataset(core)), F.transform(names, normal_dataset), F.array(normal_dataset(aspect)))
    return F.slice(F.array_distinct(F.flatten(F.transform(parts, lambda p: char_grams(p, 2)))), 1, most)


# --- similarity --------------------------------------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared over the summed elements of two sets; 0 for two empty sets."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def window_similarity(text: C, alias: C) -> Column:
    """1 for equal texts, 0.92 if the alias stands in the text, else the best Dice of bigrams over windows of the
    alias's length and one more or less (the whole text, where that is shorter), times 0.85 + 0.15 * length ratio."""
    text, alias = _col(text), _col(alias)
    n = F.length(alias)

    def best(size: Column) -> Column:
        size = F.least(F.greatest(size, F.lit(1)), F.length(text))
        starts = F.when(size >= 1, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
        ratio = F.least(size, n).cast("double") / F.greatest(size, n)
        return F.coalesce(F.array_max(F.transform(starts, lambda i: dice(uni_bigrams(text.substr(i, size)), uni_bigrams(alias)) * (0.85 + 0.15 * ratio))), F.lit(0.0))

    return F.when(text == alias, 1.0).when(F.instr(text, alias) > 0, 0.92).otherwise(F.greatest(best(n - 1), best(n), best(n + 1)))


def sequence_ratio(a: C, b: C) -> Column:
    """The ratio of matching blocks of two texts; 0 if one is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0.0 if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    return run(_col(a), _col(b))


def changed_units(a: C, b: C) -> Column:
    """Edit blocks that are not equal between two texts."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([sum(op[0] != "equal" for op in difflib.SequenceMatcher(None, p or "", q or "").get_opcodes()) for p, q in zip(x, y, strict=True)], dtype="int32")

    return run(_col(a), _col(b))


# --- extraction and cleaning --------------------------------------------------------------------------------------


def strip_fillers(c: C, fillers: list[str], most: int = 80) -> Column:
    """The text without the filler phrases, squeezed, at most ``most`` characters."""
    out = F.coalesce(_col(c), F.lit(""))
    for phrase in fillers:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return F.substring(squeezed(out), 1, most)


def template_question(c: C, pattern: str, aspects: dict[str, str]) -> Column:
    """(subject, aspect, quality) of a question that fits ``pattern`` (groups subject, aspect): 1.0 with a known aspect,
    else 0.4 with the whole text as subject."""
    text = clean(c)
    names = F.create_map(*[F.lit(x) for kv in aspects.items() for x in kv]) if aspects else F.create_map().cast("map<string,string>")
    subject, aspect = F.regexp_extract(text, pattern, 1), F.element_at(names, F.regexp_extract(text, pattern, 2))
    fits = (subject != "") & aspect.isNotNull()
    return F.struct(F.when(fits, subject).otherwise(text).alias("subject"), F.when(fits, aspect).alias("aspect"), F.when(fits, 1.0).otherwise(0.4).alias("quality"))


def clean_answer(c: C, noise: list[str], parts: int = 8, most: int = 220) -> Column:
    """Clauses between semicolons: trimmed, noise and repeats (normalised) dropped, at most ``parts``, joined, cut to ``most``."""
    clauses = F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), "[；;]"), F.trim), lambda x: (x != "") & ~x.isin(*noise) if noise else x != "")
    keyed = F.transform(clauses, lambda x: F.struct(normal_dataset(x).alias("k"), x.alias("x")))
    first = F.filter(keyed, lambda y, i: ~F.exists(F.slice(keyed, 1, i), lambda z: z["k"] == y["k"]))
    return F.substring(F.array_join(F.slice(F.transform(first, lambda y: y["x"]), 1, parts), "；"), 1, most)


def numbers(c: C) -> Column:
    """Numbers in a text, in order."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1)


def protected_markers(c: C, markers: list[str]) -> Column:
    """The markers that a text holds, then its numbers."""
    c = F.coalesce(_col(c), F.lit(""))
    held = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.instr(c, m) > 0) if markers else F.array().cast("array<string>")
    return F.array_distinct(F.concat(held, numbers(c)))


_CJK = re.compile("[一-鿿]")


def token_estimate(c: C, images: C | None = None) -> Column:
    """Two tokens a CJK character, one for every four others, 576 an image."""
    text = F.coalesce(_col(c), F.lit(""))
    cjk = F.length(F.regexp_replace(text, "[^一-鿿]", ""))
    rest = F.floor((F.length(text) - cjk) / 4)
    return (2 * cjk + rest + 576 * (F.coalesce(_col(images), F.lit(0)) if images is not None else F.lit(0))).cast("long")


def unwrap(c: C, tag: str) -> Column:
    """What stands between ``<tag>`` and ``</tag>``, or the whole text; without a code fence around it."""
    text = clean(c)
    inner = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    inner = F.when(inner != "", inner).otherwise(text)
    return F.trim(F.regexp_replace(inner, r"^```[a-z]*\s*|\s*```$", ""))


def after_last(c: C, marker: str) -> Column:
    """The text behind the last marker; the whole text without one."""
    return F.substring_index(F.coalesce(_col(c), F.lit("")), marker, -1)


def identifier(c: C) -> Column:
    """Characters outside A-Z a-z 0-9 _ . : - as underscores."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^A-Za-z0-9_.:-]+", "_")


def spell_digits(c: C, digits: str = "零一二三四五六七八九") -> Column:
    """Digits as the ten characters given."""
    return F.translate(_col(c), "0123456789", digits)


def noisy_variants(c: C, swaps: dict[str, str], filler: str) -> Column:
    """Speech-noise variants of a text: aliases swapped, punctuation dropped, a filler put before it; without the text itself."""
    text = F.coalesce(_col(c), F.lit(""))
    swapped = text
    for a, b in swaps.items():
        swapped = F.replace(swapped, F.lit(a), F.lit(b))
    variants = F.array(swapped, F.regexp_replace(text, r"[，。！？、,.!?]+", ""), F.concat(F.lit(filler), text))
    return F.array_except(F.array_distinct(variants), F.array(text))


def merged(parts: Column) -> Column:
    """Pieces of a text that comes in again and again: one that holds the text so far replaces it, one that is held is
    dropped, others are appended."""
    return F.aggregate(parts, F.lit(""), lambda acc, x: F.when(F.instr(x, acc) > 0, x).when(F.instr(acc, x) > 0, acc).otherwise(F.concat(acc, x)))


def strip_markup(c: C) -> Column:
    """Visible text of HTML by patterns: without comments, scripts, styles and tags, common references decoded, squeezed."""
    text = F.coalesce(_col(c), F.lit(""))
    text = F.regexp_replace(text, r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(ch))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


# --- chunkers ----------------------------------------------------------------------------------------------------


def chunk_text(c: C, most: int = 80) -> Column:
    """Sentences, and what a longer one is cut into: pieces of ``most`` characters, or up to its last comma or blank if
    that stands in the second half of the reach. One pattern says both for each sentence."""
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[ \t]+", " ")
    sentences = F.regexp_extract_all(text, F.lit(r"[^。！？.!?;；\n]*[。！？.!?;；]|[^。！？.!?;；\n]+"), 0)
    bare = F.transform(sentences, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    piece = rf"\s*(.{{1,{most}}}\z|.{{{most // 2},{most}}}[，,、 ]|.{{{most}}})"
    pieces = F.flatten(F.transform(bare, lambda s: F.transform(F.regexp_extract_all(s, F.lit(piece), 1), lambda x: F.trim(x))))
    return F.filter(pieces, lambda x: x != "")


def pack_segments(c: C, budget: int = 120) -> Column:
    """Sentences packed greedily into segments whose token estimate stays within the budget.

    A pass over the pieces of a text, with running counts of the open segment, so the work grows with the text alone."""

    def packed(pieces: pd.Series) -> pd.Series:
        out = []
        for parts in pieces:
            segments: list[list[str]] = []
            n = cjk = 0
            for part in parts if parts is not None else ():
                han = 0 if part.isascii() else len(_CJK.findall(part))
                more, both = n + 1 + len(part), cjk + han
                if segments and 2 * both + (more - both) // 4 <= budget:
                    segments[-1].append(part)
                    n, cjk = more, both
                else:
                    segments.append([part])
                    n, cjk = len(part), han
            out.append([" ".join(x) for x in segments])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(packed, "array<string>")(chunk_text(c, max(budget * 2, 1)))


# --- matching ----------------------------------------------------------------------------------------------------


def matches_not_negated(c: C, term: str, negations: tuple[str, ...] = ("没有", "无", "不", "未", "否认"), reach: int = 8) -> Column:
    """Whether ``term`` stands in the text without a negation in the ``reach`` characters before it in its clause."""
    clauses = F.split(F.coalesce(_col(c), F.lit("")), "[，。！？；,.!?;]")
    negated = "|".join(re.escape(n) for n in negations)
    stripped = F.transform(clauses, lambda x: F.regexp_replace(x, rf"(?:{negated}).{{0,{reach}}}?{re.escape(term)}", ""))
    return F.exists(stripped, lambda x: F.instr(x, term) > 0)
