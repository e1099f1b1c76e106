"""Spelling variants by merging the subtrees of an errata trie.

The trie of all words is a table: a row for each word and position gives the node it passes (its prefix, as a
hash) and the character it goes on with. A node's heaviest child is the one with most words below; the edges to
all others are light, and a word has at most log2(words) of them on its way. Two words that are one edit apart
part at the node of their common prefix, and one of them leaves it by a light edge or ends there. So only the light
subtrees are merged, each terminal of them small to large, at the node u that their edge c leaves:

* c skipped, into u's own subtree: the terminal u + r of a word u + c + r (deletion);
* u's heavy character put before it: u + heavy + c + r, and u + heavy for a word that ends at u (insertion);
* c replaced by any character: all terminals u + * + r of the children of u meet, u + heavy + r among them.

Terminals that coincide are words one edit apart, and each such pair coincides once. Which child counts as heavy
matters for the cost alone, never for the result, so two prefixes of one hash do no harm. No two words are ever
compared: a node's merged terminals meet by key, as many as there are characters at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, kept, small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The character that stands for any other in a merged terminal; no word has it.
ANY = "*"


def slipped(run: Column, doc_id: Column, every: int) -> Column:
    """``run`` without one of its characters where ``every`` divides the crc32 of document and run, as it is elsewhere."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the letter runs of all texts, slips among them, that have enough characters and occurrences.

    Null or empty text: none. A null id counts as an empty one; repeated rows count each; words of any length are kept
    whole. Counts are summed up in the tasks first, so a frequent word is one row of each."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit("([a-zÀ-ÿ]+)"), 1)
    each = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    words = each.select(slipped(F.col("run"), F.col("id"), every).alias("word")).filter(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, u, c, r, heavy): the light edges on each word's way, u being the word before the edge's character c, r
    what follows, ``heavy`` the heavy character of that node. A word that ends at a node with children has a row with an
    empty c."""
    length = F.length("word")
    steps = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("i"))
    steps = steps.withColumns({"node": F.xxhash64(F.substring("word", F.lit(1), F.col("i"))), "c": F.substring("word", F.col("i") + 1, F.lit(1))})
    children = steps.groupBy("node", "c").agg(F.count(F.lit(1)).alias("size"))
    below = F.when(F.col("c") != "", F.struct((-F.col("size")).alias("less"), "c"))
    # a node's way on is worth a row if there are two: to children, or to one and an end
    nodes = children.groupBy("node").agg(F.min(below)["c"].alias("heavy"), F.sum("size").alias("passing"), F.count(F.lit(1)).alias("ways"))
    nodes = written(nodes.filter("ways > 1").select(F.col("node").alias("at"), "heavy", "passing"), "nodes")
    met = join_counted(steps, nodes, F.col("node") == F.col("at"), "passing").filter(F.col("c") != F.col("heavy"))
    return met.select("word", "n", F.substring("word", F.lit(1), F.col("i")).alias("u"), "c", F.substring("word", F.col("i") + 2, length).alias("r"), "heavy")


def _seen(n: str, word: str) -> Column:
    """A near word, the better the less: more occurrences first, then code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, best): for each merged terminal that a word shares, how many others share it and the best of them.

    ``words`` is written: distinct words with their counts n."""
    light = written(light_edges(words), "light")
    ends = F.col("c") == ""
    skipped = F.when(~ends & ~F.col("r").startswith(F.col("c")), F.concat("u", "r"))
    inserted = F.concat("u", "heavy", "c", "r")
    found = light.select("word", "n", F.explode(F.array(skipped, inserted)).alias("terminal")).filter("terminal IS NOT NULL")
    own = small(words.withColumnsRenamed({"word": "other", "n": "other_n"}))
    pairs = found.join(own, F.col("terminal") == F.col("other"))
    one = F.lit(1).cast("long")
    both = pairs.select(F.explode(F.array(F.struct("word", one.alias("near"), _seen("other_n", "other").alias("best")), F.struct(F.col("other").alias("word"), one.alias("near"), _seen("n", "word").alias("best")))).alias("x")).select("x.*")
    lights = light.filter(~ends)
    merged = lights.select(F.concat("u", F.lit(ANY), "r").alias("terminal"), "word", "n")
    # the heavy subtree's terminals come in where a light one meets them
    heavy = lights.select(F.concat("u", "heavy", "r").alias("other"), F.concat("u", F.lit(ANY), "r").alias("terminal")).distinct()
    heavy = heavy.join(own, "other").select("terminal", F.col("other").alias("word"), F.col("other_n").alias("n"))
    met = merged.unionByName(heavy).groupBy("terminal").agg(F.sort_array(F.collect_list(_seen("n", "word"))).alias("all")).filter(F.size("all") > 1)
    each = met.select((F.size("all") - 1).cast("long").alias("near"), F.slice("all", 1, 2).alias("top"), F.explode("all").alias("me"))
    best = F.when(F.col("me.word") == F.col("top")[0]["word"], F.col("top")[1]).otherwise(F.col("top")[0])
    return both.unionByName(each.select("me.word", "near", best.alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of each word that has one lead, by pointers that double their reach each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = small(now).select(F.col("word").alias("from"), F.col("root").alias("to"))
        step = now.join(ahead, F.col("root") == F.col("from"), "left")
        now = written(step.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "forms", moved=F.count_if("moved"))
        if not kept(now).sums["moved"]:
            return now.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 2, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the ``vocabulary`` of all texts.

    Near words differ by one inserted, deleted or replaced character. A word's form is its near word of most occurrences
    (ties: the least in code-point order) if it has ``ratio`` times the word's own at least, else null; its root is the
    last word that forms lead to. Nulls, empty and long texts: see ``vocabulary``. No words: no rows."""
    words = written(vocabulary(docs, id_col, text_col, **options), "words")
    none = F.lit(None).cast("struct<less:bigint,word:string>")
    rows = neighbours(words).withColumn("n", F.lit(None).cast("long")).unionByName(words.select("word", F.lit(0).cast("long").alias("near"), none.alias("best"), "n"))
    each = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    each = written(each.select("word", F.when(fits, F.col("best.word")).alias("form"), "n", "n_near", F.when(fits, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(each.filter("form IS NOT NULL")).withColumnRenamed("word", "of")
    joined = each.join(ends, F.col("word") == F.col("of"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
