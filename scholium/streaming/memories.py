"""Long-term memories and recent turns as state of a stream, kept in a state store between batches.

A user's live memories lie in a map state, one entry each, so that a batch writes only what it changes; what is no longer
live leaves the state and stays in the log of changes that the stream gives. A timer in event time stands at the moment
at which the first of them goes stale, by its expiry or by idleness; when it rings, all go that are stale by the
watermark, as a timer that is set then would not ring before the next batch. A conversation's last turns are a list state whose
entries go by themselves after a time. The state store writes to the stream's checkpoint, from which a stopped stream
goes on."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS, Settings
from ..operators.memory import Memories
from ..session import ready

DAY_US = 86_400_000_000
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: A live memory in the state, behind its id; times in microseconds.
STATE = "content string, memory_type string, memory_key string, importance double, confidence double, embedding array<double>, session_id long, expires_at long, updated_at long"
#: A change in the log. seq: the number of the change for its user.
CHANGE = "seq long, id long, change string, content string, memory_type string, memory_key string, importance double, confidence double, session_id long, expires_at long, updated_at long, is_active boolean, superseded_by long"
COLUMNS = [c.split(" ")[0] for c in STATE.split(", ")]
LOGGED = [c.split(" ")[0] for c in CHANGE.split(", ")]


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that map and list states and timers need, for streams that start from now on."""
    ready(spark).conf.set(*STORE)
    return spark


def stale_at(memory: dict, settings: Settings) -> float:
    """The moment, in microseconds, from which a memory is stale if nothing touches it."""
    semantic = memory["memory_type"] == "semantic"
    half, idle = (settings.semantic_half_life_days, settings.semantic_max_idle_days) if semantic else (settings.episodic_half_life_days, settings.episodic_max_idle_days)
    fades = half * math.log2(memory["importance"] / settings.archive_below) if memory["importance"] > 0 else 0.0
    idles = memory["updated_at"] + max(idle, fades) * DAY_US + 1  # strictly less than the limit
    return idles if memory["expires_at"] is None else min(idles, memory["expires_at"])


class _Rememberer(StatefulProcessor):
    def __init__(self, time: str, order: str, threshold: float, settings: Settings) -> None:
        self.time, self.order, self.threshold, self.settings = time, order, threshold, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memories = handle.getMapState("memories", "id long", STATE)
        self.numbers = handle.getValueState("numbers", "next_id long, seq long, timer long")

    def _opened(self, now: pd.Timestamp) -> tuple[Memories, int, int | None]:
        rows = [dict(zip(COLUMNS, value)) | {"id": key[0], "is_active": True, "superseded_by": None} for key, value in self.memories.iterator()]
        next_id, seq, timer = self.numbers.get() if self.numbers.exists() else (1, 0, None)
        at = lambda us: None if us is None else pd.Timestamp(us, unit="us")
        rows = [r | {"expires_at": at(r["expires_at"]), "updated_at": at(r["updated_at"]), "embedding": None if r["embedding"] is None else list(r["embedding"])} for r in rows]
        own = Memories(rows, now, self.threshold, self.settings.episodic_max_idle_days)
        own.next_id = next_id
        return own, seq, timer

    def _archived(self, own: Memories, timers) -> dict[int, str]:
        """Archives what is stale by the watermark, which may be later than a timer; the changes."""
        mark, changes = timers.getCurrentWatermarkInMs() * 1000, {}
        for r in own.live:
            times = {c: None if r[c] is None else r[c].value // 1000 for c in ("expires_at", "updated_at")}
            if stale_at(r | times, self.settings) <= mark:
                r["is_active"] = False
                changes[r["id"]] = "archived"
        own.live = [r for r in own.live if r["is_active"]]
        return changes

    def _closed(self, own: Memories, seq: int, timer: int | None, changes: dict[int, str]) -> Iterator[pd.DataFrame]:
        """Writes what changed, sets the timer, and gives the log's rows, in the order of ids."""
        us = lambda t: None if t is None or pd.isna(t) else t.value // 1000
        out, live = [], []
        for r in sorted(own.rows, key=lambda r: r["id"]):
            value = r | {"expires_at": us(r["expires_at"]), "updated_at": us(r["updated_at"])}
            if r["is_active"]:
                live.append(value)
            if r["id"] not in changes:
                continue
            seq += 1
            out.append(value | {"seq": seq, "change": changes[r["id"]]})
            if r["is_active"]:
                self.memories.updateValue((r["id"],), tuple(value[c] for c in COLUMNS))
            elif self.memories.containsKey((r["id"],)):
                self.memories.removeKey((r["id"],))
        first = math.ceil(min((stale_at(m, self.settings) for m in live), default=-1000) / 1000)  # timers are in milliseconds
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first >= 0 and timer != first:
            self.handle.registerTimer(first)
        self.numbers.update((own.next_id, seq, first if first >= 0 else None))
        if out:
            whole = lambda c: (lambda v: None if v is None or v != v else int(v)) if c in ("session_id", "superseded_by", "expires_at", "updated_at") else lambda v: v
            # by column and as they are, as conversions of a frame take longer than all else of a user
            yield pd.DataFrame({c: np.array([whole(c)(r[c]) for r in out] + [None], object)[:-1] for c in LOGGED})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        records = [dict(zip(frame.columns, values, strict=True)) for frame in rows for values in zip(*(frame[c].tolist() for c in frame.columns), strict=True)]
        records.sort(key=lambda r: (r[self.order] is None or r[self.order] != r[self.order], r[self.order]))
        own, seq, timer = self._opened(pd.Timestamp(max(int(r[self.time]) for r in records if r[self.time] is not None and r[self.time] == r[self.time]), unit="us"))
        plain = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else list(v) if hasattr(v, "shape") and v.shape else v
        changes = self._archived(own, timerValues)
        for c in records:
            for what, i in own.take({f: plain(c.get(f)) for f in (*COLUMNS, "id", "is_active", "superseded_by")}):
                changes[i] = "inserted" if what == "merged" and changes.get(i) == "inserted" else what
        yield from self._closed(own, seq, timer, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own, seq, _ = self._opened(pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))
        changes = self._archived(own, timerValues)
        yield from self._closed(own, seq, None, changes)


def remember(candidates: DataFrame, *, user: str, time: str, order: str, threshold: float = DEFAULTS.redundancy_threshold, settings: Settings = DEFAULTS) -> DataFrame:
    """user and the columns of CHANGE: what each batch of candidates does to the memories of its users, as
    memory.update_in_order with the latest time of the batch's candidates of that user as now; and what goes stale.

    candidates: a stream of user, time, order, content, memory_type, memory_key, importance, confidence, and embedding
    and session_id where there are such. A memory is archived when the watermark, which is the latest time that any batch
    before had, passes the moment from which it is stale: its expiry, or long idleness with little importance left. Of a
    memory that a batch changes several times the last change is logged, and an inserted one that is merged stays that."""
    with_state_store(candidates.sparkSession)
    kinds = dict(x.split(" ") for x in STATE.split(", "))
    some = [(F.col(c) if c in candidates.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS if c not in ("expires_at", "updated_at")]
    rows = candidates.select(F.col(user), F.col(time).cast("timestamp").alias("at_time"), F.unix_micros(F.col(time).cast("timestamp")).alias("at_us"), F.col(order).alias("at_order"), *some).withWatermark("at_time", "0 seconds")
    kind = candidates.schema[user].dataType.simpleString()

    class Keyed(_Rememberer):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            for frame in super().handleInputRows(key, rows, timerValues):
                frame.insert(0, user, key[0])
                yield frame

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            for frame in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
                frame.insert(0, user, key[0])
                yield frame

    log = rows.groupBy(user).transformWithStateInPandas(Keyed("at_us", "at_order", threshold, settings), f"{user} {kind}, {CHANGE}", "Append", "EventTime")
    return log.withColumns({c: F.timestamp_micros(c) for c in ("expires_at", "updated_at")})


def memories_now(log: DataFrame, *, user: str) -> DataFrame:
    """The last state of each memory in the log of changes."""
    fields = [c for c in LOGGED if c not in ("seq", "id")]
    return log.groupBy(user, "id").agg(F.max_by(F.struct(*fields), "seq").alias("m")).select(user, "id", "m.*")


class _Turns(StatefulProcessor):
    def __init__(self, keep: int, ttl_ms: int, order: str) -> None:
        self.keep, self.ttl_ms, self.order = keep, ttl_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "at long, role string, content string", self.ttl_ms)
        self.batch = handle.getValueState("batch", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(r) for frame in rows for r in frame[["at", "role", "content"]].itertuples(index=False)]
        last = sorted([*(tuple(t) for t in self.turns.get()), *new], key=lambda t: t[0])[-self.keep :]
        self.turns.put(last)
        n = (self.batch.get()[0] if self.batch.exists() else 0) + 1
        self.batch.update((n,))
        yield pd.DataFrame({"session": [str(key[0])] * len(last), "batch": n, "position": range(1, len(last) + 1), "at": [t[0] for t in last], "role": [t[1] for t in last], "content": [t[2] for t in last]})


def recent_turns(messages: DataFrame, *, session: str, order: str, role: str, content: str, turns: int, keep_hours: float = 24.0) -> DataFrame:
    """session, batch, position, at, role, content: with each batch the last 2 * turns messages of the sessions that it
    has messages of, in order. What a session said is forgotten keep_hours (of the clock) after it came. Streams that are
    run once over what is there need spark.sql.streaming.noDataMicroBatches.enabled off, as the clock never stands still."""
    with_state_store(messages.sparkSession)
    rows = messages.select(F.col(session).cast("string").alias("session"), F.col(order).cast("long").alias("at"), F.col(role).alias("role"), F.col(content).alias("content"))
    out = "session string, batch long, position int, at long, role string, content string"
    return rows.groupBy("session").transformWithStateInPandas(_Turns(2 * turns, int(keep_hours * 3_600_000), "at"), out, "Append", "ProcessingTime")


def turns_now(windows: DataFrame) -> DataFrame:
    """The last window of each session."""
    last = F.rank().over(Window.partitionBy("session").orderBy(F.desc("batch")))
    return windows.withColumn("_n", last).where("_n = 1").drop("_n", "batch")
