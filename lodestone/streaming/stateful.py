"""Streams with state of their own by key: growing hypotheses, idle sessions with a pre-roll, pending questions.

Each is a processor of ``transformWithStateInPandas`` with typed, bounded state in RocksDB. Rows of a key are taken in
their order within a micro-batch; how much a micro-batch reads is bounded by bytes (``twins.source``), so that a hot
key's rows of one batch fit a task. A row that comes before one already seen (by its order) is late, and is dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .twins import finished

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _in_rocks(spark: SparkSession) -> Iterator[None]:
    """Typed state needs the RocksDB provider; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "none", log: str | None = None) -> DataFrame:
    out = rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", time)
    with _in_rocks(rows.sparkSession):
        return finished(out, log=log)


def _ordered(frames: Iterable[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


class _Growing(StatefulProcessor):
    """State: the last token with how much there is, the end of the text, and the words that have fired."""

    def __init__(self, words: list[str], key: str):
        self.words, self.key, self.keep = sorted(set(words)), key, max(map(len, words), default=1) - 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, token string, n_tokens long, tail string")
        self.fired = handle.getListState("fired", "word string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, token, n, tail = self.last.get() if self.last.exists() else (None, None, 0, "")
        fired, out = {w for (w,) in self.fired.get()} if self.fired.exists() else set(), []
        for at, tokens in _ordered(rows, ["seq"])[["seq", "tokens"]].itertuples(index=False):
            if seq is not None and at <= seq:
                continue
            seq, new = at, [t for t in (tokens if tokens is not None else []) if t is not None]
            if new and new[0] == token:
                new = new[1:]  # the two overlap by a token
            added = (" " if n and new else "") + " ".join(new)
            seen = tail + added
            hits = [w for w in self.words if new and w not in fired and w in seen]
            fired.update(hits)
            n, token, tail = n + len(new), new[-1] if new else token, seen[len(seen) - self.keep :] if self.keep else ""
            out.append((key[0], at, added, n, hits))
        self.last.update((seq, token, n, tail))
        if fired:
            self.fired.put([(w,) for w in sorted(fired)])
        yield pd.DataFrame(out, columns=[self.key, "seq", "added", "n_tokens", "hits"])

    def close(self) -> None:
        pass


def growing_text(pieces: DataFrame, key: str, words: list[str], log: str | None = None) -> DataFrame:
    """(key, seq, added, n_tokens, hits) for each piece (key, seq, tokens) of a text that is heard bit by bit.

    A piece that begins with the token the text ends with overlaps it by that token. ``added`` is what the piece appends
    to the text, the blank before it included; ``hits`` are the ``words`` that the text holds now and has not held before,
    each sent once. Null or empty pieces add nothing. State by key: one row and the words fired."""
    kind = pieces.schema[key].dataType.simpleString()
    return _run(pieces.select(key, "seq", "tokens"), key, _Growing(words, key), f"`{key}` {kind}, seq long, added string, n_tokens long, hits array<string>", log=log)


class _Idle(StatefulProcessor):
    """State: a session's bounds and rows, and its latest payload, bounded; a timer at the time it will be idle."""

    def __init__(self, key: str, idle_us: int, keep: int):
        self.key, self.idle, self.keep = key, idle_us, keep
        self.columns = [key, "started", "ended", "n_events", "preroll"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "started long, ended long, n long, preroll string")

    def _timer(self, last: int) -> int:
        return (last + self.idle) // 1000 + 1

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns)
        return out.astype({"started": "int64", "ended": "int64", "n_events": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.session.get() if self.session.exists() else None
        if held:
            self.handle.deleteTimer(self._timer(held[1]))
        out = []
        for at, payload in _ordered(rows, ["at_us", "seq"])[["at_us", "payload"]].itertuples(index=False):
            if held and at < held[1]:
                continue
            if held and at - held[1] > self.idle:
                out.append((key[0], *held))
                held = None
            started, _, n, ring = held or (at, at, 0, "")
            ring = f"{ring} {payload or ''}" if n else payload or ""
            held = (started, at, n + 1, ring[max(0, len(ring) - self.keep) :])
        if held:
            self.session.update(held)
            self.handle.registerTimer(self._timer(held[1]))
        yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.session.exists():
            held = self.session.get()
            if self._timer(held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.session.clear()
                yield self._out([(key[0], *held)])

    def close(self) -> None:
        pass


def idle_sessions(events: DataFrame, key: str, idle_seconds: int, keep: int, late: str = "1 hour", log: str | None = None) -> DataFrame:
    """(key, started, ended, n_events, preroll) of each session that has ended: nothing came for more than
    ``idle_seconds``, told by the key's next event or by the watermark, which forgets the key.

    ``events``: key, ``at`` (event time), ``seq`` (order among equal times), ``payload`` (text; null: empty). ``preroll``:
    the last ``keep`` characters of the payloads, with blanks between them, as a ring keeps them."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark("at", late).select(key, "at", F.unix_micros("at").alias("at_us"), "seq", "payload")
    out = _run(rows, key, _Idle(key, idle_seconds * 1_000_000, keep), f"`{key}` {kind}, started long, ended long, n_events long, preroll string", "EventTime", log)
    return out.withColumns({"started": F.timestamp_micros("started"), "ended": F.timestamp_micros("ended")})


class _Pending(StatefulProcessor):
    """State: the question that waits for an answer, what it is about and what was answered; the user's last words."""

    def __init__(self, key: str, turns: int, chars: int):
        self.key, self.turns, self.chars = key, turns, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "asked long, root string, question string, depth long, resumed boolean")
        self.answers = handle.getListState("answers", "text string")
        self.last = handle.getValueState("last", "turn long, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, said = self.last.get() if self.last.exists() else (None, "")
        asked = self.pending.get() if self.pending.exists() else None
        answers = [a for (a,) in self.answers.get()] if asked and self.answers.exists() else []
        out = []
        for turn, user, text, asks in _ordered(rows, ["turn"])[["turn", "user", "text", "asks"]].itertuples(index=False):
            if last is not None and turn <= last:
                continue
            last, text = turn, text or ""
            if user:
                if asked and turn - asked[0] > self.turns:
                    asked, answers = None, []  # it has waited too long
                if asked and not asked[4] and text.strip():
                    answers, asked = [*answers, text.strip()], (*asked[:4], True)
                out.append((key[0], turn, asked is not None, *((asked[1], asked[2], asked[3]) if asked else (None, None, 0)), list(answers)))
                said = text.strip()[: self.chars]
            elif asks:
                prior = asked if asked and asked[4] else None
                answers = answers if prior else []
                asked = (turn, prior[1] if prior else said, text.strip()[: self.chars], prior[3] + 1 if prior else 1, False)
            else:
                asked, answers = None, []
        self.last.update((last, said))
        if asked:
            self.pending.update(asked)
        else:
            self.pending.clear()
        if answers:
            self.answers.put([(a,) for a in answers])
        else:
            self.answers.clear()
        yield pd.DataFrame(out, columns=[self.key, "turn", "resumed", "root", "question", "depth", "answers"])

    def close(self) -> None:
        pass


def continuations(turns: DataFrame, key: str, wait: int, chars: int = 1500, log: str | None = None) -> DataFrame:
    """(key, turn, resumed, root, question, depth, answers) for each turn of a user in ``turns`` (key, turn, ``user``:
    whether the user speaks, text, ``asks``: whether the other side's turn asks something).

    A question waits for the user's answer up to ``wait`` turns. The answer resumes what the user asked first (``root``);
    if the other side asks again, the question stays part of it: one deeper, with the answers so far. A blank turn
    is no answer but does not end the wait; any other turn of the other side does. Root and question are kept to
    ``chars`` characters."""
    kind = turns.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, turn long, resumed boolean, root string, question string, depth long, answers array<string>"
    return _run(turns.select(key, F.col("turn").cast("long").alias("turn"), "user", "text", "asks"), key, _Pending(key, wait, chars), schema, log=log)


def mirrored(stream: DataFrame, path: str, clean: Callable[[DataFrame], DataFrame], roll_up: Callable[[DataFrame], DataFrame], key: str, sums: list[str], log: str) -> None:
    """Writes a stream of trace rows to ``path``/rows, cleaned, and keeps ``path``/totals by key in step.

    Each micro-batch has its own folder, named by its number, for its rows and for the new totals of the keys it touches:
    those of the batches before it, plus its own (``roll_up``: one row for each key, ``sums`` to be added, other columns
    taken from the newest batch). A batch that runs again writes over its own folders and reads only earlier ones, so a
    replay changes nothing; nothing is written before it is cleaned. Read the result with ``totals``."""

    def keep(batch: DataFrame, number: int) -> None:
        cleaned = clean(batch).persist()
        try:
            cleaned.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            own = roll_up(cleaned)
            if earlier := totals(batch.sparkSession, path, key, before=number):
                old = earlier.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in sums])
                own = own.join(old, F.col(key).eqNullSafe(F.col("__key")), "left")
                own = own.withColumns({c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in sums}).drop("__key", *[f"__{c}" for c in sums])
            own.write.mode("overwrite").parquet(f"{path}/totals/batch={number}")
        finally:
            cleaned.unpersist()

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()


def totals(spark: SparkSession, path: str, key: str, before: int | None = None) -> DataFrame | None:
    """The newest totals of each key, those of batches ``before`` one only if given; None if there are none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.parquet(f"{path}/totals")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("__row")).select(key, "__row.*")
