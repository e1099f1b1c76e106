"""Decision rules as Column builders: coded pattern rules, polarity of terms, gates, decision tables, follow-up questions,
compaction. All tables of patterns and texts are parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .commands import bound

#: Marks that end a clause; a negation reaches no further.
CLAUSE = "[，。！？；,.!?;]"


def _listed(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def asserted(text: Column, pattern: str, negation: str) -> Column:
    """Whether the first match of ``pattern`` stands in the text with no match of ``negation`` before it in its clause."""
    # a match of no width at the beginning is none to ``split``
    before = F.when(text.rlike(f"(?s)^(?:{pattern})"), "").otherwise(F.split(text, f"(?s)(?:{pattern})", 2)[0])
    return text.rlike(pattern) & ~F.element_at(F.split(before, CLAUSE), -1).rlike(negation)


def coded_rules(text: Column, rules: list[tuple[str, str]], negation: str, composites: list[tuple[str, str, list[str]]] | None = None, most: int = 5) -> Column:
    """Codes of the rules (code, pattern) that a text asserts, in order, then of the composites (code, head, companions)
    of which it asserts the head and one companion at least; each once, at most ``most``. Null text: none."""
    if not rules and not composites:
        return F.array().cast("array<string>")

    def codes(text: Column) -> Column:
        held = [F.when(asserted(text, p, negation), code) for code, p in rules]
        for code, head, companions in composites or []:
            some = F.lit(False)
            for p in companions:
                some = some | asserted(text, p, negation)
            held.append(F.when(asserted(text, head, negation) & some, code))
        return F.slice(F.array_distinct(F.array_compact(F.array(*held))), 1, most)

    return bound(F.coalesce(text, F.lit("")), codes)


def polarity(text: Column, terms: list[str], negation: str, most: int = 12) -> Column:
    """(positive, negative): the terms that a text holds without and behind a negation in their clause, longest first.
    A term inside a longer one that was found is left out, and a negated term is not positive."""
    ordered = _listed(sorted(terms, key=lambda t: (-len(t), t)))
    held = lambda parts: F.filter(ordered, lambda t: F.exists(parts, lambda p: F.instr(p, t) > 0))
    longest = lambda found: F.filter(found, lambda t: ~F.exists(found, lambda o: (o != t) & (F.instr(o, t) > 0)))
    behind = lambda clauses: F.transform(clauses, lambda c: F.regexp_extract(c, f"(?s)((?:{negation}).*)$", 1))
    ahead = lambda clauses: F.transform(clauses, lambda c: F.regexp_replace(c, f"(?s)(?:{negation}).*$", ""))
    # each list is bound before a lambda uses it, or it would be worked out again for every element
    found = lambda parts: bound(parts, lambda p: bound(held(p), longest))
    both = lambda clauses: F.struct(found(ahead(clauses)).alias("positive"), found(behind(clauses)).alias("negative"))
    parted = lambda x: F.struct(F.slice(F.array_except(x["positive"], x["negative"]), 1, most).alias("positive"), F.slice(x["negative"], 1, most).alias("negative"))
    return bound(bound(F.split(F.coalesce(text, F.lit("")), CLAUSE), both), parted)


def confirmed(text: Column, cue: str, exact: Column, answer_mark: str | None = None) -> Column:
    """A gate: the text shows the cue of a confirmation, and ``exact`` holds. Behind ``answer_mark``, where it stands,
    only the answer counts, not the question before it."""
    text = F.coalesce(text, F.lit(""))
    if answer_mark:
        answer = F.regexp_extract(text, rf"(?s){re.escape(answer_mark)}\s*(.+?)\s*$", 1)
        text = F.when(answer != "", answer).otherwise(text)
    return text.rlike(cue) & F.coalesce(exact, F.lit(False))


def decision(branches: list[tuple[Column, str]], otherwise: str) -> Column:
    """The outcome of the first branch that holds; a null condition does not."""
    out = None
    for holds, name in branches:
        holds = F.coalesce(holds, F.lit(False))
        out = F.when(holds, F.lit(name)) if out is None else out.when(holds, F.lit(name))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def consult_status(urgent: Column, ambiguous: Column, blocked: Column, intent: Column, matches: Column, evidence: Column, associations: Column, departments: Column) -> Column:
    """The status of a consultation, from counts of what was found."""
    return decision(
        [
            (urgent, "urgent"), (ambiguous, "ambiguous"), (blocked, "need_more_info"), ((intent == "department_recommendation") & (departments > 0), "ok"), (intent == "department_recommendation", "need_more_info"),
            (intent == "symptom_consultation", "need_more_info"), ((matches > 0) & (evidence == 0) & (associations == 0) & (departments == 0), "evidence_gap"), ((matches == 0) & (evidence == 0), "not_found"),
        ],
        "ok",
    )


def follow_up(text: Column, topics: list[tuple[str, list[str]]], general: list[str], denied: Column, default: str) -> Column:
    """The questions of the first topic (pattern, questions) that a text shows once the denied terms are taken out of it,
    else the general ones; without those that name a denied term; if none is left, the default."""

    def left(denied: Column, text: Column) -> Column:
        asked = _listed(general)
        for pattern, questions in reversed(topics):
            asked = F.when(text.rlike(pattern), _listed(questions)).otherwise(asked)
        return F.filter(asked, lambda q: ~F.exists(denied, lambda d: (d != "") & (F.instr(q, d) > 0)))

    without = lambda denied: F.aggregate(denied, F.coalesce(text, F.lit("")), lambda t, d: F.replace(t, d, F.lit("")))
    kept = bound(denied, lambda d: bound(without(d), lambda t: left(d, t)))
    return bound(kept, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(default))))


def within_budget(lists: dict[str, tuple[Column, int]], most: int) -> Column:
    """A struct of the lists, each without so many of its last elements, in the order of ``lists``, that its JSON takes at
    most ``most`` bytes; a list keeps the number given beside it, though the whole may then be too large."""
    spare = [F.greatest(F.size(c) - keep, F.lit(0)) for c, keep in lists.values()]

    def after(k: Column) -> Column:
        """The lists after k elements were dropped."""
        parts, before = [], F.lit(0)
        for (name, (c, _)), room in zip(lists.items(), spare, strict=True):
            drop = F.least(F.greatest(k - before, F.lit(0)), room)
            parts.append(F.slice(c, F.lit(1), F.size(c) - drop).alias(name))
            before = before + room
        return F.struct(*parts)

    total = sum(spare[1:], spare[0])
    fits = F.filter(F.sequence(F.lit(0), total), lambda k: F.octet_length(F.to_json(after(k))) <= most)
    return after(F.coalesce(F.try_element_at(fits, F.lit(1)), total))


def contained(claimed: Column, allowed: Column) -> Column:
    """Whether every claimed id is allowed; a null list is empty, and an empty claim is contained."""
    return F.size(F.array_except(F.coalesce(claimed, F.array().cast("array<string>")), F.coalesce(allowed, F.array().cast("array<string>")))) == 0


def flat_unique(nested: Column) -> Column:
    """The texts of a list of lists in order, trimmed, each once, without nulls and blanks."""
    flat = F.transform(F.flatten(F.filter(F.coalesce(nested, F.array().cast("array<array<string>>")), lambda x: x.isNotNull())), lambda x: F.trim(x))
    return F.array_distinct(F.filter(flat, lambda x: x.isNotNull() & (x != "")))


def kept_fields(fields: dict[str, Column]) -> Column:
    """A map of the fields allowed, as texts, without nulls and blanks."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), c.cast("string").alias("v")) for k, c in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull() & (F.trim(e["v"]) != "")))


def root_mean_square(samples: Column) -> Column:
    """Loudness of a block of 16-bit samples, 0 to 1; 0 for an empty or null block."""
    squares = F.aggregate(F.coalesce(samples, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce(F.try_divide(F.sqrt(F.try_divide(squares, F.size(samples))), F.lit(32768.0)), F.lit(0.0))


def run_sets(done: Column, overflowed: Column, failed: Column) -> Column:
    """The sets that a run belongs to; they may overlap."""
    sets = {"completed": done & ~failed, "overflow": overflowed, "error": failed}
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in sets.items()]))


def review_priority(risky: Column, disagreeing: Column, score: Column, least: float) -> Column:
    """P0 for what is risky, P1 for what reviewers disagree on or scores under ``least``, else P2."""
    return decision([(risky, "P0"), (disagreeing | (score < least), "P1")], "P2")
