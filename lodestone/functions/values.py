"""Hashes, splits, vectors, JSON and decision functions as Column builders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- hashes ------------------------------------------------------------------------------------------------------


def sha(c: Column) -> Column:
    """SHA-256 of a text, in hex; null is the empty text."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in order and nulls kept, so that equal records have equal texts."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_id(n: int = 12, **fields: Column) -> Column:
    """The first n hex digits of the hash of the canonical JSON."""
    return F.substring(F.sha2(canonical_json(**fields), 256), 1, n)


def hash_slice(c: Column, start: int, digits: int = 16) -> Column:
    """Hex digits of the SHA-256 as an unsigned number (a decimal: 64 bits do not fit a long)."""
    return F.conv(F.substring(sha(c), start, digits), 16, 10).cast("decimal(20,0)")


def split_90_10(c: Column) -> Column:
    """"eval" for one in ten by bytes 8 to 15 of the hash, else "train"."""
    return F.when(hash_slice(c, 17) % 10 == 0, "eval").otherwise("train")


def split_80_10_10(c: Column) -> Column:
    """"test", "dev" or "train" by the first eight hex digits of the hash modulo 10 (0, 1, others)."""
    bucket = hash_slice(c, 1, 8) % 10
    return F.when(bucket == 0, "test").when(bucket == 1, "dev").otherwise("train")


# --- vectors -----------------------------------------------------------------------------------------------------


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit_prefix(v: Column, n: int) -> Column:
    """The first n dimensions, scaled to length 1; null for a zero vector."""
    head = F.slice(v, 1, n)
    size = norm(head)
    return F.when(size > 0, F.transform(head, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_errors(a: Column, b: Column) -> Column:
    """(cosine, l2, max_abs, mean_abs) between two vectors."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(cosine(a, b).alias("cosine"), norm(gaps).alias("l2"), F.array_max(gaps).alias("max_abs"), (total / F.size(gaps)).alias("mean_abs"))


# --- JSON --------------------------------------------------------------------------------------------------------


def repaired_json(c: Column, schema: str) -> Column:
    """JSON parsed with ``schema``; a text cut short by its last brace is closed first. Null if neither parses."""
    good = lambda x: F.from_json(x, schema, {"mode": "PERMISSIVE"})
    closed = F.when(F.try_parse_json(c).isNotNull(), c).when(F.try_parse_json(F.concat(c, F.lit("}"))).isNotNull(), F.concat(c, F.lit("}")))
    return F.when(closed.isNotNull(), good(closed))


def last_tagged(c: Column, tag: str) -> Column:
    """What the last ``<tag>`` element of a text holds; null without one."""
    found = F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def redacted(c: Column, secrets: tuple[str, ...] = ("api_key", "authorization", "token", "password", "image", "image_url", "reasoning_content"), parts: tuple[str, ...] = ("secret", "token_value"), depth: int = 6, items: int = 100, chars: int = 12_000) -> Column:
    """JSON without secret keys (those named, and those that hold one of ``parts``), image data masked, bounded in depth,
    items and characters. Broken JSON becomes null."""

    def walk(x: object, level: int) -> object:
        if isinstance(x, dict):
            return {k: walk(v, level + 1) for k, v in list(x.items())[:items] if k.lower() not in secrets and not any(p in k.lower() for p in parts)} if level < depth else "…"
        if isinstance(x, list):
            return [walk(v, level + 1) for v in x[:items]] if level < depth else "…"
        if isinstance(x, str):
            return "[image omitted]" if x.startswith("data:image/") else x[:chars]
        return x

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(walk(json.loads(text), 0), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(c)


def values_of_key(c: Column, key: str) -> Column:
    """All texts under ``key`` at any depth of a JSON text, in order."""

    def find(x: object) -> list[str]:
        if isinstance(x, dict):
            return [v for k, y in x.items() for v in ([str(y)] if k == key and not isinstance(y, dict | list) else find(y))]
        return [v for y in x for v in find(y)] if isinstance(x, list) else []

    def one(text: str | None) -> list[str]:
        try:
            return find(json.loads(text or "null"))
        except ValueError:
            return []

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(c)


def replaced_values(c: Column, changes: dict[str, str]) -> Column:
    """JSON with every text value that is a key of ``changes`` replaced, at any depth; broken JSON stays as it is."""

    def walk(x: object) -> object:
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else changes.get(x, x) if isinstance(x, str) else x

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(c)


# --- decisions ---------------------------------------------------------------------------------------------------


def cascade(c: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first (pattern, label) rule that a text matches."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for pattern, label in rules:
        out = out.when(c.rlike(pattern), label)
    return out.otherwise(otherwise)


def all_reasons(reasons: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order; an unknown condition does not hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in reasons.items()]))


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first condition that holds; null if none does."""
    out = None
    for name, cond in reasons.items():
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out if out is not None else F.lit(None).cast("string")


def compare(value: Column, op: str, wanted: object) -> Column:
    """A tri-state comparison: null where it cannot be told. ``exists`` and ``not_exists`` are always told."""
    if op == "exists":
        return value.isNotNull()
    if op == "not_exists":
        return value.isNull()
    if op in ("in", "not_in"):
        held = value.isin(*wanted)
        return held if op == "in" else ~held
    if op in ("eq", "neq"):
        same = value == F.lit(wanted)
        return same if op == "eq" else ~same
    number, limit = value.try_cast("double"), F.lit(wanted).try_cast("double")
    return {"gt": number > limit, "gte": number >= limit, "lt": number < limit, "lte": number <= limit}[op]


def all_hold(conditions: list[Column]) -> Column:
    """Three-valued conjunction; true for none."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """A rounded share; 0 of nothing is 0."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)
