"""Streams over the events, and what depends on their order."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..session import fresh_dir, table
from ..streaming import events as S
from ..streaming import memories as M

QUERIES: dict = {}
QUERY_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            QUERY_SQL[name] = sql
        return fn

    return add


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stream(spark, sf_dir, pattern="events.parquet", time="ts")


def plain(rows: DataFrame) -> DataFrame:
    """Timestamps without a zone, as in the tables."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in rows.dtypes if t == "timestamp"})


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.windowed(source(spark, sf_dir), time="ts", key="event_type", value="value", size="1 hour")
    return plain(S.drain_complete(rows, fresh_dir(spark, "stream")))


@query("stream_sliding", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(4) AS r(k) GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.windowed(source(spark, sf_dir), time="ts", key="event_type", value="value", size="1 hour", slide="15 minutes")
    return plain(S.drain_complete(rows, fresh_dir(spark, "stream")))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.sessions(source(spark, sf_dir), time="ts", key="user_id", gap="30 minutes")
    return plain(S.drain_complete(rows, fresh_dir(spark, "stream")))


@query("stream_last_seen", "SELECT user_id::VARCHAR AS key, count(*) AS n, max(ts) AS last FROM events GROUP BY 1")
def stream_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's state at the end of what is there; keys idle for a day would expire as event time goes on."""
    rows = S.last_seen(source(spark, sf_dir), time="ts", key="user_id", idle_minutes=24 * 60)
    states = S.drain(rows, fresh_dir(spark, "stream"))
    return plain(states.groupBy("key").agg(F.max("n").alias("n"), F.max("last").alias("last")))


def parts(spark: SparkSession, sf_dir: str, columns: list[str], cuts: list) -> str:
    """A folder of the events in files, one for each condition, which are read in this order; ts as it is."""
    where = fresh_dir(spark, "parts")
    rows = table(spark, sf_dir, "events").select(*columns)
    for n, cut in enumerate(cuts):
        rows.where(cut).coalesce(1).write.mode("append").parquet(where)
        time.sleep(0.02)  # files are told apart by their time
    return where


def thirds(spark: SparkSession, sf_dir: str) -> tuple:
    """Two times that cut the events' span into three."""
    first, last = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    return first + (last - first) / 3, first + (last - first) * 2 / 3


def in_runs(rows: DataFrame, cuts: list, where: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream that make makes gives over the rows of each condition in turn: each is a run of its own, which
    takes up the checkpoint of the one before it."""
    out = None
    for cut in cuts:
        rows.where(cut).write.mode("append").parquet(f"{where}/in")
        out = S.drain(make(S.stream(rows.sparkSession, f"{where}/in")), where)
    return out


#: Days that the memories of some kinds are kept.
KEEP_DAYS = 4
MEMORIES = f"""WITH t AS (SELECT min(ts) + (max(ts) - min(ts)) / 3 AS early, min(ts) + (max(ts) - min(ts)) * 2 / 3 AS late FROM events),
e AS (SELECT user_id, event_id, ts, event_type AS key, '用户' || event_type || (event_id % 3) AS content, event_type IN ('view', 'click') AS episodic, (0.5 + (event_id % 5) / 10.0)::DOUBLE AS confidence, CASE WHEN ts < early THEN 1 WHEN ts < late THEN 2 ELSE 3 END AS batch FROM events, t),
c AS (SELECT *, max(ts) OVER (PARTITION BY user_id, batch) AS now FROM e),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) AS mark FROM e GROUP BY batch),
p AS (SELECT *, lag(content) OVER w AS was, lag(now) OVER w AS touched, lag(batch) OVER w AS before FROM c WINDOW w AS (PARTITION BY user_id, key ORDER BY batch, event_id)),
g AS (SELECT p.*, coalesce(episodic AND before < p.batch AND touched + INTERVAL {KEEP_DAYS} DAY <= mark, false) AS gone FROM p LEFT JOIN m ON m.batch = p.batch - 1),
r AS (SELECT *, sum((was IS NULL OR was <> content OR gone)::INT) OVER (PARTITION BY user_id, key ORDER BY batch, event_id) AS run FROM g),
a AS (SELECT user_id, key, run, any_value(content) AS content, any_value(episodic) AS episodic, min((batch, event_id)) AS first, arg_min(gone, (batch, event_id)) AS after_gone, arg_min(now, (batch, event_id)) AS began,
             max(now) AS touched, round(least(1.0, 0.5 + 0.03 * (count(*) - 1)), 6)::DOUBLE AS importance, max(confidence) AS confidence FROM r GROUP BY user_id, key, run),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS id FROM a),
n AS (SELECT *, lead(id) OVER w AS next_id, lead(after_gone) OVER w AS next_gone, lead(began) OVER w AS next_began FROM i WINDOW w AS (PARTITION BY user_id, key ORDER BY run))
SELECT user_id, id, key AS memory_key, content, importance, confidence, CASE WHEN next_id IS NOT NULL AND NOT next_gone THEN next_id END AS superseded_by,
       next_id IS NULL AND NOT (episodic AND touched + INTERVAL {KEEP_DAYS} DAY <= (SELECT max(mark) FROM m)) AS is_active, CASE WHEN next_id IS NULL OR next_gone THEN touched ELSE next_began END AS updated_at,
       CASE WHEN episodic THEN touched + INTERVAL {KEEP_DAYS} DAY END AS expires_at FROM n"""


@query("stream_memories", MEMORIES)
def stream_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidates for memories of their user, in three runs: equal ones merge, others of a kind supersede, and
    those of two kinds expire when nothing touches them."""
    early, late = thirds(spark, sf_dir)
    kind, turn = F.col("event_type"), F.col("event_id") % 3
    kinds = ["signup", "view", "click", "error", "purchase"]
    place = 3 * F.array_position(F.array(*map(F.lit, kinds)), kind) + turn  # contents are alike only where they are equal
    rows = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.concat(F.lit("用户"), kind, turn.cast("string")).alias("content"), F.when(kind.isin("view", "click"), "episodic").otherwise("semantic").alias("memory_type"), kind.alias("memory_key"),
        F.lit(0.5).alias("importance"), (0.5 + (F.col("event_id") % 5) / 10.0).alias("confidence"), F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: (k == place).cast("double")).alias("embedding"),
    )
    cuts = [F.col("ts") < F.lit(early), (F.col("ts") >= F.lit(early)) & (F.col("ts") < F.lit(late)), F.col("ts") >= F.lit(late)]
    settings = replace(DEFAULTS, episodic_max_idle_days=float(KEEP_DAYS))
    log = in_runs(rows, cuts, fresh_dir(spark, "memories"), lambda s: M.remember(s, user="user_id", time="ts", order="event_id", settings=settings))
    now = M.memories_now(log, user="user_id").withColumn("importance", F.round("importance", 6))
    return plain(now.select("user_id", "id", "memory_key", "content", "importance", "confidence", "superseded_by", "is_active", "updated_at", "expires_at"))


@query("stream_recent_turns", """SELECT conv_id::VARCHAR AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, turn AS at, role, sha256(text) AS content
 FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)""")
def stream_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of each conversation, kept between runs of a stream of early, middle and late turns."""
    rows, turn = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text")).distinct(), F.col("turn")
    cuts = [turn < 2, turn.between(2, 4), turn > 4]
    none = "spark.sql.streaming.noDataMicroBatches.enabled"  # which, with a clock, would never end
    before = spark.conf.get(none)
    spark.conf.set(none, "false")
    windows = in_runs(rows, cuts, fresh_dir(spark, "turns"), lambda s: M.recent_turns(s, session="conv_id", order="turn", role="role", content="text", turns=2))
    spark.conf.set(none, before)
    return M.turns_now(windows)


@query("stream_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In three batches, the latest events first: what comes later does not replace what is newer."""
    early, late = thirds(spark, sf_dir)
    where = fresh_dir(spark, "upsert")
    cuts = [F.col("ts") >= F.lit(late), F.col("ts") < F.lit(early), (F.col("ts") >= F.lit(early)) & (F.col("ts") < F.lit(late))]
    rows = S.stream(spark, parts(spark, sf_dir, ["user_id", "event_id", "ts"], cuts), files_per_batch=1).select("user_id", "event_id", F.struct("ts", "event_id").alias("version"))
    S.incremental_upsert(rows, f"{where}/table", key=["user_id"], checkpoint=f"{where}/checkpoint", newest="version")
    return S.current_version(spark, f"{where}/table").select("user_id", "event_id")


#: The times that cut the events' span into three, events that come two batches late, and the watermark then.
LATE = """b AS (SELECT min(ts) AS a, max(ts) AS z FROM events), t AS (SELECT a + (z - a) / 3 AS early, a + (z - a) * 2 / 3 AS late FROM b),
e AS (SELECT events.*, ts < early AND event_id % 50 = 0 AS tardy, ts < early AND event_id % 50 <> 0 AS first FROM events, t),
w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e WHERE first)"""


def tardy_runs(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What make gives of the events in three runs by time, a fiftieth of the first third with the last; then of two far
    later events, which close all before them. Nothing runs between the runs' batches, so what is late in one is judged
    as in a stream that never stops."""
    early, late = thirds(spark, sf_dir)
    tardy = (F.col("ts") < F.lit(early)) & (F.col("event_id") % 50 == 0)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    end = lambda days: events.limit(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(late) + F.make_dt_interval(days=F.lit(days))).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    cuts = [(F.col("ts") < F.lit(early)) & ~tardy, (F.col("ts") >= F.lit(early)) & (F.col("ts") < F.lit(late)), (F.col("ts") >= F.lit(late)) | tardy]
    where, out = fresh_dir(spark, "stream"), None
    none = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(none)
    spark.conf.set(none, "false")
    for part in [*(events.where(cut) for cut in cuts), end(4_000), end(8_000)]:
        part.write.mode("append").parquet(f"{where}/in")
        out = S.drain(make(S.stream(spark, f"{where}/in", time="ts")), where)
    spark.conf.set(none, before)
    return out


@query("stream_closed_windows", f"""WITH {LATE} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, w
 WHERE NOT (tardy AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark) GROUP BY ALL""")
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: each window once, when it is closed; what comes for a window that was closed before is dropped."""
    closed = tardy_runs(spark, sf_dir, lambda rows: S.windowed(rows, time="ts", key="event_type", value="value", size="1 hour"))
    return plain(closed.where("event_type <> 'end'"))


@query("stream_expired", f"WITH {LATE} SELECT user_id::VARCHAR AS key, count(*) AS n, max(ts) AS last FROM e, w WHERE NOT (tardy AND ts <= mark + INTERVAL 10 MINUTE) GROUP BY 1")
def stream_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a key when its state expires, idle for five years of event time; late events are not counted."""
    states = tardy_runs(spark, sf_dir, lambda rows: S.last_seen(rows, time="ts", key="user_id", idle_minutes=5 * 365 * 24 * 60))
    return plain(states.where("expired and key <> '-1'").select("key", "n", "last"))


BREAKER = """WITH RECURSIVE c AS (SELECT event_type AS service, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, epoch_us(ts) / 1000000.0 AS moment, event_id % 4 <> 0 AS ok FROM events),
w AS (SELECT service, 0::BIGINT AS i, 'closed' AS state, 0::BIGINT AS n, 0::DOUBLE AS since, true AS allowed, 0::BIGINT AS event_id FROM c GROUP BY service
 UNION ALL SELECT service, i, CASE WHEN NOT allowed THEN pre WHEN ok THEN 'closed' WHEN pre = 'half_open' OR n + 1 >= 3 THEN 'open' ELSE 'closed' END,
  CASE WHEN allowed AND ok AND pre = 'half_open' THEN 0 WHEN allowed AND NOT ok AND pre = 'closed' THEN n + 1 ELSE n END, CASE WHEN allowed AND NOT ok AND (pre = 'half_open' OR n + 1 >= 3) THEN moment ELSE since END, allowed, event_id
  FROM (SELECT w.service, c.i, c.moment, c.ok, w.n, w.since, c.event_id, CASE WHEN w.state = 'open' AND c.moment - w.since > 60 THEN 'half_open' ELSE w.state END AS pre, NOT (w.state = 'open' AND c.moment - w.since <= 60) AS allowed FROM w JOIN c ON c.service = w.service AND c.i = w.i + 1))
SELECT service, event_id, state, allowed FROM w WHERE i > 0"""


@query("breaker_states", BREAKER)
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a call of its type's service, in the order of ids; every fourth fails."""
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("service"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_id") % 4 != 0).alias("ok"))
    return S.breaker_states(calls, service="service", order="event_id", at="at", ok="ok")
