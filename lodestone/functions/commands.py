"""Commands in braces read from text: strictly, loosely or by guess, as one expression with a confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of command with the spellings that stand for them.
ALIASES = {
    "tool_call": ["toolcall", "tool_call", "tool-call", "toolcal", "tol_call", "toll_call", "call_tool", "tool"],
    "skill_call": ["skillcall", "skill_call", "skill-call", "skil_call", "skillcal", "skilcal", "invoke_skill"],
    "judge": ["judg", "judgement", "judg_call", "decision"],
}
#: The shapes of a command and of its parameters.
STRICT = r"""(?i)\{\s*"?\s*(tool_call|skill_call|judge)\s*"?\s*:\s*"([^"]+)"\s*(?:["']?\s*param\s*["']?\s*[:=]?\s*\{([^}]*)\})?\s*\}"""
LOOSE = r"""(?is)\{\s*(\w[\w\s_\-]*)\s*[:=]\s*["']*([\w][\w\-]*)["']*\s*(?:\s*param\s*[\{\(\[]\s*([^\}\)\]]*?)\s*[\}\)\]])?\s*[,;]?\s*\}"""
PARAM_STRICT = r"""(\w+)"?\s*[:=]\s*"([^"]*)\""""
PARAM_LOOSE = r"""(\w+)"?\s*[:=]\s*["']*([^"'}\s,]+)["']*"""
PARAM_ARRAY = r"""(\w+)"?\s*[:=]\s*(\[[^\]]*\])"""
PARAM_GUESS = r"""(\w+)\s*[:=]\s*["']*([^"'}\s,]+)["']*"""
QUOTED, AFTER = r"""["']([^"'}]+)["']""", r"""[:=]\s*(\w[\w\-]*)"""
#: Words of the form itself, which are no parameters and no names.
LOOSE_WORDS = ["tool_call", "skill_call", "judge", "param", "name", "tool", "skill"]
GUESS_WORDS = ["tool_call", "skill_call", "judge", "param", "name"]
NAME_WORDS = ["tool_call", "skill_call", "judge", "param", "text", "name"]
KIND = "struct<kind:string,name:string,params:map<string,string>,confidence:double>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used: it is the one element of a list."""
    return F.transform(F.array(value), use)[0]


def _nearest(word: Column, choices: list[tuple[str, str]], most: int = 2) -> Column:
    """(dist, i, is): the first of the choices (spelling, what it stands for) with the fewest edits from ``word``; null
    above ``most``."""
    each = [F.struct(F.levenshtein(word, F.lit(spelling)).alias("dist"), F.lit(i).alias("i"), F.lit(what).alias("is")) for i, (spelling, what) in enumerate(choices)]
    if not each:
        return F.lit(None).cast("struct<dist:int,i:int,is:string>")
    return bound(F.array_min(F.array(*each)), lambda best: F.when(best["dist"] <= most, best))


def _plain(alias: str) -> str:
    return alias.replace("_", "").replace("-", "")


def kind_of(word: Column) -> Column:
    """The kind that a word stands for: a spelling of it, with or without its marks, or the nearest within two edits."""
    whole = [(a, kind) for kind, names in ALIASES.items() for a in names]

    def of(clean: Column) -> Column:
        exact = F.coalesce(*[F.when(clean.isin(*{x for a in names for x in (a, _plain(a))}), F.lit(kind)) for kind, names in ALIASES.items()])
        return F.coalesce(exact, _nearest(clean, [(_plain(a), kind) for a, kind in whole])["is"])

    return bound(F.replace(F.replace(F.lower(word), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("")), of)


def _registered(name: Column, kind: Column, tools: list[str], skills: list[str]) -> Column:
    """The registered name that is meant: the name itself, or the nearest of its kind within two edits."""

    def of(names: list[str]) -> Column:
        near = _nearest(F.lower(name), [(n.lower(), n) for n in names])["is"]
        return F.when(name.isin(*names), name).otherwise(F.coalesce(near, name)) if names else name

    return F.when(kind == "tool_call", of(tools)).when(kind == "skill_call", of(skills)).otherwise(name)


def _pairs(text: Column, pattern: str, without: list[str]) -> Column:
    """All (key, value) of a pattern but for some keys."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("key"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("value"))
    return F.filter(found, lambda x: ~F.lower(x["key"]).isin(*without)) if without else found


def _as_map(pairs: Column) -> Column:
    """A map of (key, value); the last value of a key counts."""
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def parsed(text: Column, tools: list[str], skills: list[str]) -> Column:
    """The command of a text: kind, name, parameters (arrays as JSON text) and confidence.

    Strict: a kind by name and quoted values, 0.95. Loose: any spelling of a kind and bare values, 0.75, or 0.85 if the
    name is registered. By guess: the place of the text nearest to a spelling (two edits at most) tells the kind, 0.6 less
    a tenth for each edit and 0.2 more for a registered name. Nothing found, and null: ``unknown`` with 0."""
    command = lambda kind, name, pairs, sure: F.struct(kind.alias("kind"), name.alias("name"), _as_map(pairs).alias("params"), sure.cast("double").alias("confidence")).cast(KIND)
    inner = lambda c: F.regexp_replace(c, '^"+', "")
    body = inner(F.regexp_extract(text, STRICT, 3))
    # values that the strict shape misses come first, so that the strict and the arrays after them count
    values = F.concat(_pairs(body, PARAM_LOOSE, LOOSE_WORDS), _pairs(body, PARAM_STRICT, []), _pairs(body, PARAM_ARRAY, []))
    strict = F.when(text.rlike(STRICT), command(F.lower(F.regexp_extract(text, STRICT, 1)), F.regexp_extract(text, STRICT, 2), values, F.lit(0.95)))

    values = _pairs(inner(F.regexp_extract(text, LOOSE, 3)), PARAM_LOOSE, LOOSE_WORDS)

    def named(kind: Column, name: Column) -> Column:
        known = ((kind == "tool_call") & name.isin(*tools)) | ((kind == "skill_call") & name.isin(*skills))
        return command(kind, name, values, F.when(known, 0.85).otherwise(0.75))

    def spelled(kind: Column) -> Column:
        name = _registered(F.trim(F.regexp_extract(text, LOOSE, 2)), kind, tools, skills)
        return F.when(kind.isNotNull(), bound(name, lambda n: named(kind, n)))

    loose = F.when(text.rlike(LOOSE), bound(kind_of(F.regexp_extract(text, LOOSE, 1)), spelled))

    low = F.lower(text)

    def edits(alias: str) -> Column:
        """The fewest edits between a spelling and any place of the text."""
        places = F.sequence(F.lit(1), F.greatest(F.length(low) - len(alias) + 1, F.lit(1)))
        return F.array_min(F.transform(places, lambda at: F.levenshtein(F.substring(low, at, F.lit(len(alias))), F.lit(alias))))

    spellings = [(_plain(a), kind) for kind, names in ALIASES.items() for a in names]
    spots = [F.struct(edits(a).alias("dist"), F.lit(i).alias("i"), F.lit(what).alias("is")) for i, (a, what) in enumerate(spellings)]
    near = F.array_min(F.array(*spots))
    quoted = F.regexp_extract_all(text, F.lit(QUOTED), 1)
    first = F.coalesce(F.get(F.filter(quoted, lambda q: ~q.isin(*NAME_WORDS)), F.lit(0)), F.get(quoted, F.lit(0)), F.regexp_extract(text, AFTER, 1))

    def guessed(near: Column) -> Column:
        bonus = lambda name: F.when(name.isin(*tools, *skills), 0.2).otherwise(0.0)
        sure = lambda name: F.round(F.least(F.greatest(F.lit(0.3), 0.6 - near["dist"] * 0.1) + bonus(name), F.lit(0.9)), 6)
        values = _pairs(text, PARAM_GUESS, GUESS_WORDS)
        return F.when(near["dist"] <= 2, bound(_registered(first, near["is"], tools, skills), lambda name: command(near["is"], name, values, sure(name))))

    guess = bound(near, guessed)
    unknown = F.struct(F.lit("unknown"), F.lit(""), F.create_map().cast("map<string,string>"), F.lit(0.0)).cast(KIND)
    return F.coalesce(strict, loose, guess, unknown)


def navigation(text: Column, places: dict[str, str], stop: str, asks: str, back: str, home: str) -> Column:
    """What a text's last line asks of a guide: (action, target), or null if it asks for no way.

    ``stop`` (a pattern) halts. Where ``asks`` is found, the target is the place that the line mentions last (of phrases that
    begin there the longest, then the last by name), by its ``places`` (phrase to place); without one, ``home`` where
    ``back`` is found. The places are a list that the code brings along."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+\z", ""), r"\r\n|\r|\n")
    line = F.trim(F.element_at(lines, -1))

    def of(said: Column) -> Column:
        last = lambda p: F.length(said) - F.instr(F.reverse(said), p[::-1]) - len(p) + 1
        seen = [F.when(F.contains(said, F.lit(p)), F.struct(last(p).alias("at"), F.lit(len(p)).alias("size"), F.lit(place).alias("place"))) for p, place in places.items()]
        place = F.array_max(F.array_compact(F.array(*seen)))["place"]
        target = F.coalesce(place, F.when(said.rlike(back), F.lit(home)))
        way = lambda action, target: F.struct(F.lit(action).alias("action"), target.alias("target"))
        return F.when(said == "", None).when(said.rlike(stop), way("stop", F.lit(""))).when(said.rlike(asks) & target.isNotNull(), way("start", target))

    return bound(line, of)
