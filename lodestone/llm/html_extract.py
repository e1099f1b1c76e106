"""Main-text extraction by a tree-structured graphical model over the DOM.

A page becomes a tree: block elements, and a leaf for each run of text between block borders. Every node is
content or not. Features of a node give its own potential, and each parent-child pair has a potential by the
child's kind. Sum-product messages go up and down the tree once, which gives the exact marginal of every
leaf; leaves that are more likely content than not are the text, in page order. Weights are trained on
labelled pages by the gradient of the exact log likelihood (observed less expected counts).
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .labelled_pages import compose

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|xmp|iframe|noembed|noframes)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|(?P<text>[^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Buckets of hashed words of names.
NAMES = 1 << 14
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("head template noscript svg annotation annotation-xml object select datalist button canvas audio video map".split())
#: Blocks of running text. A button that stands in the middle of it is part of it; any other is a control.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dd td th blockquote figcaption".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary caption table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these ends the open elements named, up to the nearest of the borders.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Attributes whose words say what an element is for.
NAMING = ("class", "id", "role")
WORDS = re.compile(r"[^\W\d_]+")
CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """Nodes in page order: parent (-1 for the root), features, text ("" for an element), label."""

    parent: list[int] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    leaf: list[bool] = field(default_factory=list)


def _name_features(names: str) -> tuple[str, ...]:
    """Hashed words of an element's names, and hashed runs of four letters, which words of other languages share. Those
    of short names are kept, some thousands of them; long lists of names are seldom the same twice."""
    return _short_name_features(names) if len(names) <= 256 else _hashed_names(names)


def _hashed_names(names: str) -> tuple[str, ...]:
    out = set()
    for word in WORDS.findall(CASE.sub(" ", names).lower()):
        out.add(f"name {zlib.crc32(word.encode()) % NAMES}")
        marked = f"<{word}>"
        out.update(f"part {zlib.crc32(marked[i : i + 4].encode()) % NAMES}" for i in range(max(1, len(marked) - 3)))
    return tuple(sorted(out))


_short_name_features = lru_cache(maxsize=1 << 14)(_hashed_names)


def _element_features(tag: str, attrs: dict[str, str], within: set[str]) -> list[str]:
    names = " ".join(attrs.get(a, "") for a in NAMING)
    out = ["bias", f"tag={tag}", *_name_features(names)]
    if tag in ("header", "footer"):
        out.append(f"{tag} in article={'article' in within}")
    return out


def _unseen(attrs: dict[str, str]) -> bool:
    """Whether an element's attributes keep it from the page."""
    style = attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def _leaf_features(text: str, tag: str, link_share: float) -> list[str]:
    n = text.count(" ") + 1
    size = 0 if n < 4 else 1 if n < 12 else 2 if n < 40 else 3
    links = 0 if link_share < 0.1 else 1 if link_share < 0.5 else 2
    out = ["leaf", f"leaf tag={tag}", f"words={size}", f"links={links}"]
    if text[-1:] in ".!?:;…。":
        out.append("ends")
    if "©" in text[:40]:
        out.append("copyright")
    return out


def parse(source: str) -> Page:
    """The tree of a page; unclosed, misnested and unknown tags are borne."""
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, node, hidden, labelled content
    parts: list[str] = []
    linked = shown = 0
    in_link = False

    def add(parent: int, features: list[str], text: str, label: int, leaf: bool) -> int:
        page.parent.append(parent)
        page.features.append(features)
        page.text.append(text)
        page.label.append(label)
        page.leaf.append(leaf)
        return len(page.parent) - 1

    def flush() -> None:
        nonlocal linked, shown
        if parts:
            text = " ".join("".join(parts).split())
            if text and not (stack and stack[-1][2]):
                top = stack[-1] if stack else ("body", 0, False, False)
                add(top[1], _leaf_features(text, top[0], linked / max(shown, 1)), text, int(top[3]), True)
            parts.clear()
        linked = shown = 0

    add(-1, ["root"], "", 0, False)
    for m in TOKEN.finditer(source):
        if (text := m["text"]) is not None:
            text = html.unescape(text)
            parts.append(text)
            shown += len(text)
            linked += len(text) * in_link
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m["close"] or m["close2"])
        if tag in ("br", "hr", "wbr", "img", "input"):
            parts.append("" if tag == "wbr" else " ")
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag in VOID or not (tag in BLOCKS or tag in HIDDEN):
            continue
        if tag == "button" and (not any(s[0] == "button" for s in stack) if closing else bool(stack) and stack[-1][0] in RUNNING and any(x.strip() for x in parts)):
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCKS:
            if stack and stack[-1][0] == "head" and tag in ("body", *BLOCKS):
                stack.pop()
            ends, borders = ENDS.get(tag, ({"p"}, BLOCKS - {"p"}))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in borders:
                    break
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTR.findall(m["attrs"] or m["attrs2"] or "")}
        parent = stack[-1] if stack else ("", 0, False, False)
        content = attrs.get("data-y") == "1" or parent[3]
        node = add(parent[1], _element_features(tag, attrs, {s[0] for s in stack}), "", 0, False)
        stack.append((tag, node, parent[2] or tag in HIDDEN or _unseen(attrs), content))
        if (m["attrs"] or m["attrs2"] or "").rstrip().endswith("/") and tag in HIDDEN:
            stack.pop()
    flush()
    # an element is content if most of the text below it is
    inside, good = [0] * len(page.parent), [0] * len(page.parent)
    for i in range(len(page.parent) - 1, -1, -1):
        if page.leaf[i]:
            inside[i], good[i] = len(page.text[i]), len(page.text[i]) * page.label[i]
        else:
            page.label[i] = int(good[i] * 2 > inside[i])
        if i:
            inside[page.parent[i]] += inside[i]
            good[page.parent[i]] += good[i]
    return page


def _softplus_gap(a: float, b: float, c: float, d: float, x: float) -> float:
    """log(e^c + e^(d + x)) - log(e^a + e^(b + x))."""
    hi, lo = max(c, d + x), max(a, b + x)
    return hi + math.log(math.exp(c - hi) + math.exp(d + x - hi)) - lo - math.log(math.exp(a - lo) + math.exp(b + x - lo))


@dataclass
class Model:
    """A weight for each feature (log odds of content), and pair[leaf?][parent][child]."""

    weights: dict[str, float]
    pair: list[list[list[float]]]

    def messages(self, page: Page) -> tuple[list[float], list[float], list[float]]:
        """Sum-product over the tree, in log odds: what each node's subtree says, what comes from above, and what it
        sent up. The marginal log odds of a node are the first two's sum."""
        w, n = self.weights, len(page.parent)
        below = [sum(w.get(f, 0.0) for f in fs) for fs in page.features]
        up, above = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):  # children stand after their parents
            j = self.pair[page.leaf[i]]
            up[i] = _softplus_gap(j[0][0], j[0][1], j[1][0], j[1][1], below[i])
            below[page.parent[i]] += up[i]
        for i in range(1, n):
            p, j = page.parent[i], self.pair[page.leaf[i]]
            above[i] = _softplus_gap(j[0][0], j[1][0], j[0][1], j[1][1], below[p] + above[p] - up[i])
        return below, above, up

    def text(self, source: str) -> str:
        """The content of a page."""
        page = parse(source)
        below, above, _ = self.messages(page)
        return " ".join(t for t, b, a in zip(page.text, below, above, strict=True) if t and b + a > 0)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def train(pages: list[str], passes: int = 40, rate: float = 0.4, decay: float = 1e-3) -> Model:
    """Gradient ascent on the exact log likelihood of labelled pages (``data-y``)."""
    model = Model({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)])
    trees = [parse(p) for p in pages]
    seen: dict[object, float] = {}  # sums of squared gradients: each weight has its own step (Adagrad)

    def climb(key: object, old: float, gain: float) -> float:
        gain = gain / len(trees) - decay * old
        seen[key] = seen.get(key, 0.0) + gain * gain
        return old + rate * gain / (math.sqrt(seen[key]) + 1e-9)

    for _ in range(passes):
        grads: dict[str, float] = {}
        pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]
        for page in trees:
            below, above, up = model.messages(page)
            for i, fs in enumerate(page.features):
                gap = page.label[i] - _sigmoid(below[i] + above[i])
                for f in fs:
                    grads[f] = grads.get(f, 0.0) + gap
                if i:
                    p, leaf = page.parent[i], page.leaf[i]
                    j, rest = model.pair[leaf], below[page.parent[i]] + above[page.parent[i]] - up[i]
                    logs = [[j[a][b] + rest * a + below[i] * b for b in (0, 1)] for a in (0, 1)]
                    top = max(map(max, logs))
                    mass = [[math.exp(x - top) for x in row] for row in logs]
                    total = sum(map(sum, mass))
                    for a in (0, 1):
                        for b in (0, 1):
                            pair[leaf][a][b] += (page.label[p] == a and page.label[i] == b) - mass[a][b] / total
        for f, g in grads.items():
            model.weights[f] = climb(f, model.weights.get(f, 0.0), g)
        for leaf in (0, 1):
            for a in (0, 1):
                for b in (0, 1):
                    model.pair[leaf][a][b] = climb((leaf, a, b), model.pair[leaf][a][b], pair[leaf][a][b])
    return model


@cache
def default_model(pages: int = 400, seed: int = 5) -> Model:
    """The model trained on ``pages`` composed pages."""
    return train(compose(pages, seed))


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the page's source if None) of each row, ``text`` and ``n_chars`` (code points).

    A null or empty page, or one without content, gives the empty text. Text inside a block has its blanks made
    one space, blocks are joined by one space, character references are decoded; nothing is cut. Repeated rows
    give the same text each."""
    model = model or default_model()
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in slices(batches, "__html"):
            texts = [model.text((raw or b"").decode("utf-8", "replace")) for raw in sources]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*[c for c in keep if c not in ("text", "n_chars")], F.col(html_col).alias("__html"))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{ddl}text string, n_chars long")
