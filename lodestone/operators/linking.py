"""Dictionary joins: longest match, n-gram candidates, fuzzy links, last mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Entries up to which a dictionary is sent to the tasks as a trie; beyond, link with ``gram_candidates``.
MOST_ALIASES = 500_000


def longest_matches(df: DataFrame, text_col: str, aliases: DataFrame, alias_col: str = "alias", most: int = 8) -> DataFrame:
    """Adds ``surfaces``: aliases found greedily from left to right, the longest at each place, at most ``most``.

    An alias of one character counts only if it is the whole text. The dictionary is counted before it is sent."""
    rows = aliases.select(alias_col).filter(F.length(alias_col) > 0).distinct().limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    trie: dict = {}
    for row in rows:
        node = trie
        for ch in row[0]:
            node = node.setdefault(ch, {})
        node[""] = True
    held = df.sparkSession.sparkContext.broadcast(trie)

    def find(text: str | None) -> list[str]:
        out, at, text = [], 0, text or ""
        while at < len(text) and len(out) < most:
            node, end = held.value, 0
            for i in range(at, len(text)):
                node = node.get(text[i])
                if node is None:
                    break
                if "" in node and (i > at or len(text) == 1):
                    end = i + 1
            if end:
                out.append(text[at:end])
            at = end or at + 1
        return out

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(find)

    return df.withColumn("surfaces", run(F.col(text_col)))


def gram_candidates(queries: DataFrame, aliases: DataFrame, k: int = 800, query_col: str = "qid", text_col: str = "text", alias_col: str = "alias") -> DataFrame:
    """(qid, alias, votes): the k aliases of each query with most shared bigrams, ties by alias."""
    q = queries.select(F.col(query_col).alias("qid"), F.explode(T.char_grams(text_col, 2)).alias("gram"))
    a = aliases.select(F.col(alias_col).alias("alias")).distinct().select("alias", F.explode(T.char_grams("alias", 2)).alias("gram"))
    votes = q.join(a, "gram").groupBy("qid", "alias").agg(F.count(F.lit(1)).alias("votes"))
    return votes.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("votes"), "alias"))).filter(F.col("place") <= k).drop("place").withColumnRenamed("qid", query_col)


def fuzzy_links(queries: DataFrame, aliases: DataFrame, least: float = 0.56, band: float = 0.08, most: int = 3, query_col: str = "qid", text_col: str = "text", alias_col: str = "alias") -> DataFrame:
    """(qid, alias, similarity, confidence): candidates by shared bigrams, those at least ``least`` similar by window and
    within ``band`` of the best, at most ``most``."""
    near = gram_candidates(queries, aliases, 800, query_col, text_col, alias_col).join(queries.select(query_col, F.col(text_col).alias("__text")), query_col)
    scored = near.withColumn("similarity", F.round(T.window_similarity("__text", "alias"), 6)).filter(F.col("similarity") >= least)
    w = W.partitionBy(query_col)
    kept = scored.withColumn("best", F.max("similarity").over(w)).filter(F.col("similarity") >= F.col("best") - band)
    ranked = kept.withColumn("place", F.row_number().over(w.orderBy(F.desc("similarity"), "alias"))).filter(F.col("place") <= most)
    return ranked.select(query_col, "alias", "similarity", F.round(F.least(F.lit(0.89), F.col("similarity")), 6).alias("confidence"))


def focused(matches: DataFrame, by: str, least: float = 0.78, most: int = 5) -> DataFrame:
    """Matches (by, name, label, match, confidence) worth keeping: exact ones if there are any, else fuzzy ones of at
    least ``least``; diseases first, then confidence; at most ``most``."""
    w = W.partitionBy(by)
    exact = F.max((F.col("match") == "exact").cast("int")).over(w) == 1
    kept = matches.withColumn("__exact", exact).filter(F.when(F.col("__exact"), F.col("match") == "exact").otherwise(F.col("confidence") >= least))
    order = w.orderBy((F.col("label") != "disease").cast("int"), F.desc("confidence"), "name")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("__exact", "place")


def last_mention(df: DataFrame, text: Column, names: DataFrame, key: str, by_length: bool = False) -> DataFrame:
    """For each row the name (name, target) mentioned last in its text, the longer one of two that end alike; the longest
    first if ``by_length``. ``names`` is a small dictionary. Rows without a mention are left out."""
    pairs = df.withColumn("__text", text).join(names, F.instr(F.col("__text"), F.col("name")) > 0)
    at = F.length("__text") - F.instr(F.reverse("__text"), F.reverse("name"))
    order = F.struct(F.length("name"), at.alias("at"), "name") if by_length else F.struct(at.alias("at"), F.length("name"), "name")
    return pairs.groupBy(key).agg(F.max_by("target", order).alias("target"), F.max_by("name", order).alias("name"))
