"""Named queries: traces, sessions, token accounting; and their streaming twins over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events as E
from ..streaming import twins as S
from .registry import query, table

ENDED, FAILED = ["purchase"], ["error"]
_TRACE = """t AS (SELECT user_id, min(ts) AS started, max(ts) AS updated, count(*) AS n_events, least(count(*), 200) AS n_kept,
coalesce(arg_max(CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END, struct_pack(ts := ts, event_id := event_id)) FILTER (WHERE event_type IN ('purchase', 'error')), 'running') AS status FROM events GROUP BY user_id)"""


@query(f"WITH {_TRACE} SELECT * FROM t")
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each user's trace (STM1)."""
    return E.trace_summary(table(spark, sf, "events"), "user_id", "ts", "event_type", ENDED, FAILED)


@query(f"WITH {_TRACE} SELECT * FROM t ORDER BY updated DESC, user_id LIMIT 100")
def trace_lru(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred traces updated last (STM2)."""
    return E.latest(trace_summary(spark, sf), "updated", "user_id")


@query("""SELECT event_id, user_id, string_agg(event_type, ' ') OVER w AS window_text, contains(string_agg(event_type, ' ') OVER w, 'click view') AS hit FROM (SELECT * FROM events ORDER BY user_id, ts, event_id)
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""")
def sliding_text_window(spark: SparkSession, sf: str) -> DataFrame:
    """What each user did in the last six hours, matched (STM4)."""
    return E.sliding_text(table(spark, sf, "events"), "user_id", "ts", "event_type", 6 * 3600, "click view").select("event_id", "user_id", "window_text", "hit")


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM s GROUP BY ALL""")
def silence_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions split by six hours of silence (STM5)."""
    return E.sessions(table(spark, sf, "events"), "user_id", "ts", F.expr("INTERVAL 6 HOURS"))


_TOKENS = r"(SELECT conv_id, turn, CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT) AS t FROM conversations)"


@query(f"""SELECT conv_id, CAST(sum(t) AS BIGINT) AS total_tokens, max(t) AS peak_turn_tokens, count(*) AS n_turns, round(sum(t) / 300.0::DOUBLE, 6) AS utilisation, sum(t) >= 0.9 * 300 AS near_limit, sum(t) > 300 AS overflow FROM {_TOKENS} GROUP BY conv_id""")
def token_usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of conversations against a limit (AGG7, AGG8, MTH8)."""
    return E.token_rollup(table(spark, sf, "conversations"), "conv_id", T.token_estimate("text"), limit=300)


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS k FROM conversations), p AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t),
m AS (SELECT *, nullif(list_position(list_transform(range(1, least(len(k), len(b)) + 1), lambda i: k[i] = b[i]), false), 0) AS gap FROM p)
SELECT conv_id, turn, CAST(len(k) AS BIGINT) AS n_tokens, CAST(CASE WHEN b IS NULL THEN 0 ELSE coalesce(gap - 1, least(len(k), len(b))) END AS BIGINT) AS shared FROM m""")
def shared_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Words that each turn shares at its start with the one before (WIN10, STM11)."""
    return E.shared_prefix(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", F.split("text", " ")).drop("text")


@query("""SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def stream_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by user, by a streaming query that reads all files there are and stops (SRC11, STM3)."""
    return S.running_totals(spark, f"{sf}/events.parquet")


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n_events FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions by event time with a watermark; open ones at the end are left out (STM5)."""
    path = f"{sf}/events.parquet"
    kind = table(spark, sf, "events").schema["ts"].dataType
    return S.session_windows(spark, path).withColumns({c: F.col(c).cast(kind) for c in ("started", "ended")})


@query("""WITH e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events),
g AS (SELECT user_id, epoch, count(*) FILTER (WHERE event_type <> 'purchase') - count(DISTINCT event_type) FILTER (WHERE event_type <> 'purchase') AS again, count(DISTINCT event_type) FILTER (WHERE event_type <> 'purchase') AS seen FROM e GROUP BY ALL)
SELECT user_id, CAST(max(epoch) AS BIGINT) AS epoch, CAST(sum(again) AS BIGINT) AS repeats, arg_max(seen, epoch) AS n_seen FROM g GROUP BY user_id""")
def stream_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs and repeated reads of each user's stream, kept in state (STM8)."""
    return S.epochs(spark, f"{sf}/events.parquet")
