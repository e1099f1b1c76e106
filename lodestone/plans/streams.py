"""Named queries: streams with state by key, and blocks in streams of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import framing
from ..session import scratch
from ..streaming import stateful, twins
from .registry import query, table

_WORDS = ["que", "the", "tion"]


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS k FROM conversations),
p AS (SELECT *, last_value(k[-1] IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t),
a AS (SELECT *, CASE WHEN k[1] = prev THEN k[2:] ELSE k END AS fresh FROM p),
n AS (SELECT *, CAST(sum(len(fresh)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS n_tokens FROM a),
d AS (SELECT *, CASE WHEN n_tokens > len(fresh) AND len(fresh) > 0 THEN ' ' ELSE '' END || array_to_string(fresh, ' ') AS added FROM n),
f AS (SELECT *, string_agg(added, '') OVER (PARTITION BY conv_id ORDER BY turn) AS whole FROM d)
SELECT conv_id, turn AS seq, added, n_tokens, list_filter({_WORDS}, lambda w: len(fresh) > 0 AND contains(whole, w) AND NOT contains(left(whole, length(whole) - length(added)), w)) AS hits FROM f""")
def stream_growing_text(spark: SparkSession, sf: str) -> DataFrame:
    """What each turn adds to its conversation's text, and the words first heard in it; a streaming query (STM7)."""
    turns = twins.table(spark, f"{sf}/conversations.parquet")
    pieces = turns.select("conv_id", F.col("turn").alias("seq"), F.filter(F.split("text", " "), lambda x: x != "").alias("tokens"))
    return stateful.growing_text(pieces, "conv_id", _WORDS)


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m),
g AS (SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n_events, right(string_agg(event_type, ' ' ORDER BY ts, event_id), 24) AS preroll FROM s GROUP BY ALL)
SELECT user_id, started, ended, n_events, preroll FROM g
QUALIFY session < max(session) OVER (PARTITION BY user_id) OR ended + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that ended by six idle hours, with the end of what was done in them; a streaming query with timers (STM6, STM9)."""
    path = f"{sf}/events.parquet"
    kind = table(spark, sf, "events").schema["ts"].dataType
    events = twins.source(spark, path).select("user_id", "at", F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    out = stateful.idle_sessions(events, "user_id", 6 * 3600, 24)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("started", "ended")})


#: The other side asks something where its last sentence has a comma.
_ASKS = r",[^.]*\.\s*$"


@query(rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, role = 'user' AS user, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS text, role <> 'user' AND regexp_matches(coalesce(text, ''), '{_ASKS}') AS asks, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
s(conv_id, r, said, asked, root, question, depth, resumed, answers, turn, user, shown) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, false, []::VARCHAR[], NULL::BIGINT, false, false FROM t
  UNION ALL SELECT n.conv_id, n.r,
    CASE WHEN n.user THEN left(n.text, 1500) ELSE s.said END,
    CASE WHEN n.user THEN CASE WHEN n.turn - s.asked <= 4 THEN s.asked END WHEN n.asks THEN n.turn END,
    CASE WHEN n.user THEN CASE WHEN n.turn - s.asked <= 4 THEN s.root END WHEN n.asks THEN CASE WHEN s.asked IS NOT NULL AND s.resumed THEN s.root ELSE s.said END END,
    CASE WHEN n.user THEN CASE WHEN n.turn - s.asked <= 4 THEN s.question END WHEN n.asks THEN left(n.text, 1500) END,
    CASE WHEN n.user THEN CASE WHEN n.turn - s.asked <= 4 THEN s.depth ELSE 0 END WHEN n.asks THEN CASE WHEN s.asked IS NOT NULL AND s.resumed THEN s.depth + 1 ELSE 1 END ELSE 0 END,
    CASE WHEN n.user THEN n.turn - s.asked <= 4 AND (s.resumed OR n.text <> '') ELSE false END,
    CASE WHEN n.user THEN CASE WHEN n.turn - s.asked <= 4 THEN CASE WHEN NOT s.resumed AND n.text <> '' THEN list_append(s.answers, n.text) ELSE s.answers END ELSE [] END WHEN n.asks AND s.asked IS NOT NULL AND s.resumed THEN s.answers ELSE [] END,
    n.turn, n.user, n.user AND coalesce(n.turn - s.asked <= 4, false)
  FROM s JOIN t n ON n.conv_id = s.conv_id AND n.r = s.r + 1)
SELECT conv_id, turn, shown AS resumed, root, question, depth, answers FROM s WHERE user""")
def stream_continuations(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of users joined to the questions that wait for them; a streaming query (STM13)."""
    turns = twins.table(spark, f"{sf}/conversations.parquet")
    rows = turns.select("conv_id", "turn", (F.col("role") == "user").alias("user"), "text", ((F.col("role") != "user") & F.coalesce(F.col("text"), F.lit("")).rlike(_ASKS)).alias("asks"))
    return stateful.continuations(rows, "conv_id", wait=4)


@query("""SELECT user_id, count(*) AS n_rows, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS n_errors, CAST(count(*) FILTER (WHERE regexp_matches(props, '"k": *[0-9]')) AS BIGINT) AS n_masked, max(ts) AS updated FROM events GROUP BY user_id""")
def stream_trace_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Traces written without their secrets, and totals by user kept in step with them; a streaming query (SNK8)."""
    path = scratch(spark, "traces")
    clean = lambda rows: rows.withColumn("props", F.regexp_replace("props", r'("k": *)[0-9.]+', '$1"[omitted]"'))
    masked, failed = (F.count_if(c) for c in (F.contains("props", F.lit("[omitted]")), F.col("event_type") == "error"))
    roll_up = lambda rows: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), failed.alias("n_errors"), masked.alias("n_masked"), F.max("ts").alias("updated"))
    stateful.mirrored(twins.table(spark, f"{sf}/events.parquet"), path, clean, roll_up, "user_id", ["n_rows", "n_errors", "n_masked"], f"{path}/log")
    return stateful.totals(spark, path, "user_id")


@query(r"""WITH s AS (SELECT conv_id, string_agg('{"role":"' || role || '","turn":' || turn || '}' || coalesce(text, ''), '' ORDER BY turn) AS whole FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, whole, regexp_extract_all(whole, '\{[^{}]*\}') AS blocks, string_split_regex(whole, '\{[^{}]*\}') AS texts FROM s),
e AS (SELECT conv_id, blocks, texts, unnest(range(1, len(blocks) + 1)) AS i FROM b)
SELECT conv_id, CAST(length(array_to_string(texts[1:i], '')) + length(array_to_string(blocks[1:i - 1], '')) AS BIGINT) AS start, blocks[i] AS block, CASE WHEN contains(blocks[i], 'assistant') THEN 0.9 ELSE 0.4 END::DOUBLE AS confidence FROM e""")
def framed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Commands in braces within the running text of each conversation, read in segments (STM12)."""
    turns = table(spark, sf, "conversations")
    head = F.to_json(F.struct("role", "turn"))
    pieces = turns.select("conv_id", F.col("turn").alias("seq"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return framing.frames(pieces, "conv_id", framing.Rules(keywords=("assistant",)))
