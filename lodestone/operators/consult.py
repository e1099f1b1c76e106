"""Consultations over a graph: what matched entities are linked to, which departments that speaks for, and the answer's
status, for all questions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..session import written
from .ordering import ranked
from .retrieval import top_k


def associations(matches: DataFrame, edges: DataFrame, relations: list[str], k: int = 3) -> DataFrame:
    """(q, matched, relation, related, rank): the k best edges (src, src_name, relation, dst_name) of each question's
    ``matches`` (q, entity), by the first of ``relations`` that the edge's relation contains, then relation and name.
    Equal triples count once; relations with none of the terms are left out."""
    score = F.greatest(*[F.when(F.contains("relation", F.lit(t)), 20 - i) for i, t in enumerate(relations)], F.lit(0))
    wanted = edges.withColumn("score", score).filter(F.col("score") > 0)
    met = matches.select("q", "entity").distinct().join(wanted, F.col("entity") == F.col("src"))
    once = met.groupBy("q", F.col("src_name").alias("matched"), "relation", F.col("dst_name").alias("related")).agg(F.max("score").alias("score"))
    return top_k(once, ["q"], [F.desc("score"), F.col("relation"), F.col("related"), F.col("matched")], k).drop("score")


def departments(direct: DataFrame, indirect: DataFrame, first: DataFrame, belongs: DataFrame, k: int = 3, most: int = 10_000_000) -> DataFrame:
    """(q, department, basis, support, terms, confidence, rank): the k departments that a question's matches speak for.

    ``direct`` (q, entity, term) belong to departments themselves; ``indirect`` ones lead there over ``first`` (src, dst).
    ``belongs``: (entity, department). How many paths lead from an entity to a department is summed up once, before
    questions come in, so that an entity with many neighbours adds a row for each department and not for each path.
    Departments with a direct match come first, then the more paths, then the name; terms: the first three by name.

    Matches are dealt by question once, with an entity's departments and paths as one list of numbers; lists of indirect
    entities come in behind that, from a table that each task holds if it has at most ``most`` numbers, else by key. So
    a question's departments are summed where its matches are, and are never shuffled one by one."""
    # a struct of a null equals another, so that matches without a question stay a group and joins need no other key
    direct, indirect = (df.withColumn("q", F.struct("q")) for df in (direct, indirect))
    paths = first.distinct().join(belongs, F.col("dst") == F.col("entity")).groupBy(F.col("src").alias("of"), "department").agg(F.count(F.lit(1)).alias("paths"))
    paths = written(paths, "paths")
    names = ranked(belongs.select("department").distinct(), [F.col("department")], "d").withColumnRenamed("department", "name")
    listed = lambda df: df.join(names, F.col("department").eqNullSafe(F.col("name"))).groupBy("of").agg(F.collect_list(F.struct(F.col("d").cast("int").alias("d"), "paths")).alias("to"))
    own = listed(belongs.select(F.col("entity").alias("of"), "department").distinct().withColumn("paths", F.lit(1).cast("long")))
    led = listed(paths)
    known = direct.join(own, F.col("entity") == F.col("of")).select("q", "entity", "term", F.lit(True).alias("direct"), "to")
    asked = indirect.select("q", "entity", "term", F.lit(False).alias("direct"), F.lit(None).cast(known.schema["to"].dataType).alias("to"))
    if paths.count() <= most:
        rows = known.unionByName(asked).repartition("q").join(F.broadcast(led.withColumnRenamed("to", "__led")), (F.col("entity") == F.col("of")) & ~F.col("direct"), "left")
        met = rows.select("q", "term", "direct", F.coalesce("to", "__led").alias("to")).filter(F.col("to").isNotNull())
    else:
        met = known.drop("entity").unionByName(asked.drop("to").join(led, F.col("entity") == F.col("of")).select("q", "term", "direct", "to")).repartition("q")
    per = met.select("q", "direct", F.inline("to")).groupBy("q", "d").agg(F.sum("paths").alias("support"), F.bool_or("direct").alias("direct"))
    best = top_k(per, ["q"], [F.desc("direct"), F.desc("support"), F.col("d")], k)
    # a department's terms are looked up for the chosen ones only
    chosen = best.groupBy(F.col("q").alias("of_q")).agg(F.collect_list(F.struct("d", "support", "direct", "rank")).alias("best"))
    held = met.select("q", "term", "to").join(chosen, F.col("q") == F.col("of_q"))
    held = held.select("q", "term", F.inline(F.filter("best", lambda x: F.exists("to", lambda y: y["d"] == x["d"]))))
    out = held.groupBy("q", "d", "support", "direct", "rank").agg(F.slice(F.sort_array(F.collect_set("term")), 1, 3).alias("terms"))
    confidence = F.when(F.col("direct"), 0.95).otherwise(F.round(F.least(F.lit(0.70), 0.52 + 0.03 * F.col("support")), 3))
    out = out.join(names.withColumnRenamed("d", "__d"), F.col("d") == F.col("__d"))
    return out.select("q.q", F.col("name").alias("department"), F.when(F.col("direct"), "direct").otherwise("two_hop").alias("basis"), "support", "terms", confidence.alias("confidence"), "rank")


def answered(questions: DataFrame, matches: DataFrame, found: dict[str, tuple[DataFrame, str]], urgent: Column, ambiguous: Column, blocked: Column, intent: Column) -> DataFrame:
    """``questions`` (q, ...) with ``n_matches``, a list for each of ``found`` (name to a table with q and rank, and its
    column), in order of rank, and ``status``. ``found`` has ``evidence``, ``associations`` and ``departments``, few rows of
    a question each; a question without any stays, with empty lists."""
    out = questions.join(matches.groupBy(F.col("q").alias("__q")).agg(F.count_distinct("entity").alias("n_matches")), F.col("q") == F.col("__q"), "left").drop("__q")
    for name, (rows, column) in found.items():
        lists = rows.groupBy(F.col("q").alias("__q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(column).alias("v")))), lambda x: x["v"]).alias(f"__{name}"))
        out = out.join(lists, F.col("q") == F.col("__q"), "left").drop("__q")
        out = out.withColumn(name, F.coalesce(f"__{name}", F.array().cast(lists.schema[f"__{name}"].dataType))).drop(f"__{name}")
    n = F.coalesce("n_matches", F.lit(0)).cast("long")
    status = R.consult_status(urgent, ambiguous, blocked, intent, n, F.size("evidence"), F.size("associations"), F.size("departments"))
    return out.withColumn("status", status).withColumn("n_matches", n)
