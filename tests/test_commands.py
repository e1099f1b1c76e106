"""Commands against a reading of the rules in Python."""

import random
import re

from lodestone.functions import commands as C

TOOLS, SKILLS = ["navigate", "speak", "query"], ["dance", "greet-guest"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(a):
    return a.replace("_", "").replace("-", "")


def kind(word):
    word = word.lower().replace(" ", "_").replace("-", "")
    pairs = [(a, k) for k, names in C.ALIASES.items() for a in names]
    for a, k in pairs:
        if word in (a, plain(a)):
            return k
    best = min(((edits(word, plain(a)), i, k) for i, (a, k) in enumerate(pairs)))
    return best[2] if best[0] <= 2 else None


def meant(name, k):
    names = {"tool_call": TOOLS, "skill_call": SKILLS}.get(k, [])
    if not names or name in names:
        return name
    best = min((edits(name.lower(), n.lower()), i, n) for i, n in enumerate(names))
    return best[2] if best[0] <= 2 else name


def read(text):
    if text is None:
        return ("unknown", "", {}, 0.0)
    if m := re.search(C.STRICT, text):
        body = (m[3] or "").lstrip('"')
        params = {k: v for k, v in re.findall(C.PARAM_LOOSE, body) if k.lower() not in C.LOOSE_WORDS}
        params |= dict(re.findall(C.PARAM_STRICT, body)) | dict(re.findall(C.PARAM_ARRAY, body))
        return (m[1].lower(), m[2], params, 0.95)
    if (m := re.search(C.LOOSE, text)) and (k := kind(m[1])):
        name = meant(m[2].strip(), k)
        known = name in {"tool_call": TOOLS, "skill_call": SKILLS}.get(k, [])
        return (k, name, {a: b for a, b in re.findall(C.PARAM_LOOSE, (m[3] or "").lstrip('"')) if a.lower() not in C.LOOSE_WORDS}, 0.85 if known else 0.75)
    low, best = text.lower(), None
    for k, names in C.ALIASES.items():
        for a in map(plain, names):
            for i in range(max(1, len(low) - len(a) + 1)):
                d = edits(low[i : i + len(a)], a)
                if d <= 2 and (best is None or d < best[0]):
                    best = (d, k)
    if best is None:
        return ("unknown", "", {}, 0.0)
    quoted = re.findall(C.QUOTED, text)
    after = re.search(C.AFTER, text)
    name = next((q for q in quoted if q not in C.NAME_WORDS), quoted[0] if quoted else after[1] if after else "")
    name = meant(name, best[1])
    sure = max(0.3, 0.6 - best[0] * 0.1) + (0.2 if name in TOOLS + SKILLS else 0)
    return (best[1], name, {k: v for k, v in re.findall(C.PARAM_GUESS, text) if k.lower() not in C.GUESS_WORDS}, round(min(sure, 0.9), 6))


TEXTS = [
    '{"tool_call":"navigate","param":{"x":"1"}}', '{"tool_call":"navigate" "param"{"action":"start","go":[1, 2]}}', '{tool_call:"speak" param{text:"hi there" x=3}}', "{toolcall: navigat param(target=lab, speed=2)}", "{skil call = greet-gest}",
    "{judg: yes}", "please tol_call navigate now", 'the decision is "speak" x: 5', "nothing of the kind", "", None, "{xyz: abc}", '{"judge":"ok" param{a:"1" a:"2"}}', "{ToolCall : QUERY, }", "tool", 'call_tool "query" k="v"',
]


def test_commands_equal_a_reading_of_the_rules(spark):
    r = random.Random(1)
    texts = list(TEXTS)
    for _ in range(150):
        t = list(r.choice([x for x in TEXTS if x]))
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randint(0, 2)] = r.choice(["", "_", "a", '"', " ", "}", "{", ":"])
        texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {x.i: (x.c.kind, x.c.name, x.c.params, round(x.c.confidence, 6)) for x in df.select("i", C.parsed(df["text"], TOOLS, SKILLS).alias("c")).collect()}
    want = {i: read(t) for i, t in enumerate(texts)}
    assert [(texts[i], got[i], want[i]) for i in want if got[i] != want[i]] == []
    assert {w[3] for w in want.values()} >= {0.95, 0.85, 0.75, 0.0} and len({w[3] for w in want.values()}) > 5


def test_navigation_takes_the_place_mentioned_last(spark):
    places = {"main hall": "hall", "hall": "small hall", "lab": "lab", "room where blood is taken": "lab", "ward": "ward"}
    say = {
        "go to lab and then to main hall": ("start", "small hall"), "take me to the hall, not to the lab": ("start", "lab"), "lab": None, "go home": None, "go back": ("start", "gate"), "go to lab\nstop it": ("stop", ""),
        "stop\ngo to ward \n": ("start", "ward"), "": None, None: None, "  \n": None, "go to the room where blood is taken": ("start", "lab"), "go to ward ward lab ward": ("start", "ward"),
    }
    df = spark.createDataFrame([(t,) for t in say], "text string")
    got = {r.text: r.n and tuple(r.n) for r in df.select("text", C.navigation(df["text"], places, "stop", r"\bgo\b|take me", "back", "gate").alias("n")).collect()}
    assert got == say
