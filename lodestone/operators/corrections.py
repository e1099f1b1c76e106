"""Values corrected inside nested JSON, with a record of each change: the value is taken apart level by level as VARIANT,
edited where it says so, and put together again from the deepest level up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

_CHILDREN = "SELECT t.id, t.path AS parent, t.old, t.new, e.pos, e.key, e.value AS v FROM {t} t, LATERAL variant_explode(t.v) e"


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _nested(kind: Column) -> Column:
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def _levels(rows: DataFrame) -> list[DataFrame]:
    """The nodes of each level: id, path, parent, pos, key, v, kind, old, new."""
    now = rows.select("id", F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.try_parse_json("body").alias("v"), "old", "new")
    out = []
    while True:
        now = written(now.withColumn("kind", F.schema_of_variant("v")), "level")
        out.append(now)
        inner = now.filter(_nested(F.col("kind")))
        if inner.isEmpty():
            return out
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("["), _quoted(F.col("key")), F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        children = rows.sparkSession.sql(_CHILDREN, t=inner)
        now = children.withColumn("path", F.concat("parent", step)).select("id", "path", "parent", "pos", "key", "v", "old", "new")


def corrected(runs: DataFrame, id_col: str, body_col: str, old: Column, new: Column, keys: list[str], phrases: list[str]) -> tuple[DataFrame, DataFrame]:
    """``runs`` (id, ``body``) with each text corrected from ``old`` to ``new``, and the log: id, path, ``before``, ``after``.

    A text value is replaced as a whole under one of ``keys``, wherever it stands, and inside any text where it follows
    one of ``phrases``. Keys of an object come out in order and numbers as VARIANT has them. A body that is not JSON, null,
    or without an old value (null or empty) stays as it is. Each level costs a shuffle, whatever the size of the table."""
    rows = runs.select(F.col(id_col).alias("id"), F.col(body_col).alias("body"), old.alias("old"), new.alias("new"))
    todo = rows.filter((F.coalesce("old", F.lit("")) != "") & F.col("new").isNotNull() & F.try_parse_json("body").isNotNull())
    levels, below, logs = _levels(todo), None, []
    for level in reversed(levels):
        text = F.try_variant_get("v", "$", "string")
        changed = reduce(lambda t, p: F.replace(t, F.concat(F.lit(p), F.col("old")), F.concat(F.lit(p), F.col("new"))), phrases, text)
        after = F.when(F.col("kind") == "STRING", F.when(F.coalesce(F.col("key").isin(*keys), F.lit(False)) & (text == F.col("old")), F.col("new")).otherwise(changed))
        nodes = level.withColumns({"before": F.when(F.col("kind") == "STRING", text), "after": after})
        logs.append(nodes.filter("before <> after").select("id", "path", "before", "after"))
        plain = F.when(F.col("after").isNotNull(), _quoted(F.col("after"))).otherwise(F.to_json("v"))
        if below is not None:
            inside = F.array_sort(F.collect_list(F.struct("pos", "key", "json")))
            members = below.groupBy(F.col("id").alias("of"), F.col("parent").alias("at")).agg(inside.alias("inside"))
            nodes = nodes.join(members, F.col("id").eqNullSafe(F.col("of")) & (F.col("path") == F.col("at")), "left")
            listed = F.concat(F.lit("["), F.array_join(F.transform("inside", lambda x: x["json"]), ","), F.lit("]"))
            entry = lambda x: F.concat(_quoted(x["key"]), F.lit(":"), x["json"])
            whole = F.concat(F.lit("{"), F.array_join(F.transform("inside", entry), ","), F.lit("}"))
            plain = F.when(F.col("inside").isNull(), plain).when(F.col("kind").startswith("ARRAY"), listed).otherwise(whole)
        below = written(nodes.select("id", "parent", "pos", "key", plain.alias("json")), "rebuilt")
    done = below.select(F.col("id").alias("__id"), F.col("json").alias("__json"))
    out = runs.join(done, F.col(id_col).eqNullSafe(F.col("__id")), "left").withColumn(body_col, F.coalesce("__json", body_col)).drop("__id", "__json")
    return out, reduce(lambda a, b: a.unionByName(b), logs)
