"""Event-time windows, expiring state and incremental loading as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ready


def stream(spark: SparkSession, path: str, *, pattern: str | None = None, time: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files below path (whose names match the pattern), the oldest first, time as a timestamp."""
    schema = spark.read.parquet(f"{path}/{pattern}" if pattern else path).schema
    reader = ready(spark).readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp")) if time else rows


def drain(result: DataFrame, where: str, *, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there, into Parquet at where, and reads that. Append mode gives closed windows only."""
    query = result.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start(f"{where}/rows")
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{where}/rows")


def drain_complete(result: DataFrame, where: str) -> DataFrame:
    """As drain for an aggregation of which the last state of every group is wanted: each batch replaces the rows."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows")

    result.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{where}/rows")


def windowed(events: DataFrame, *, time: str, key: str, value: str, size: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """start, key, n, total for each tumbling or sliding window and key."""
    parts = [F.window(time, size, slide) if slide else F.window(time, size), F.col(key)]
    rows = events.withWatermark(time, lateness).groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return rows.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, *, time: str, key: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """start, end, key, n: runs of a key's events without a gap."""
    rows = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def last_seen(events: DataFrame, *, time: str, key: str, idle_minutes: int) -> DataFrame:
    """key, n, last, expired: a key's count so far with each batch; its state goes when it is idle for long in event time."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"key": [str(k[0])], "n": [n], "last": [pd.Timestamp(last, unit="us")], "expired": [True]})
            return
        n, last = state.get if state.exists else (0, 0)
        for frame in frames:
            n += len(frame)
            last = max(last, int(frame[time].astype("datetime64[us]").astype("int64").max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + idle_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [str(k[0])], "n": [n], "last": [pd.Timestamp(last, unit="us")], "expired": [False]})

    rows = events.withWatermark(time, "0 minutes").select(F.col(key).cast("string").alias("key"), time)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, n long, last timestamp, expired boolean", "n long, last long", "append", "EventTimeTimeout")


def incremental_upsert(rows: DataFrame, target: str, *, key: list[str], checkpoint: str, newest: str, buckets: int = 64, on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Loads a stream into a table below target of one row for each key: that of the greatest newest, whichever batch it
    comes in. Of equals the one that came first stays.

    Rows lie in buckets by a hash of the key. A batch writes new versions of the buckets that it touches, then the list
    of all buckets' versions; readers follow the last list. A batch that runs again writes the same again."""
    spark = rows.sparkSession

    def load(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")
        fresh = batch.select("*", bucket)
        fresh = fresh.groupBy("bucket", *key).agg(F.max_by(F.struct(*batch.columns), newest).alias("r")).select("bucket", "r.*").persist()
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # `buckets` at most
        versions = _versions(spark, target, before=number)
        old = _buckets(spark, target, {b: v for b, v in versions.items() if b in touched}, fresh.schema)
        both = old.withColumn("_is_new", F.lit(False)).unionByName(fresh.withColumn("_is_new", F.lit(True)))
        best = both.groupBy("bucket", *key).agg(F.max_by(F.struct(*batch.columns), F.struct(F.col(newest).alias("v"), (~F.col("_is_new")).alias("first"))).alias("r"))
        best.select("bucket", "r.*").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v{number}")
        now = versions | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{target}/current/at={number}")
        fresh.unpersist()
        if on_batch is not None:
            on_batch(batch, number)

    rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket, by the last list (before a batch)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/current")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return {}
    done = [int(f.getPath().getName()[3:]) for f in store.listStatus(folder) if f.getPath().getName().startswith("at=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    last = max([n for n in done if before is None or n < before], default=None)
    return {} if last is None else {r["bucket"]: r["version"] for r in spark.read.parquet(f"{target}/current/at={last}").collect()}


def _buckets(spark: SparkSession, target: str, versions: dict[int, int], schema: T.StructType) -> DataFrame:
    """bucket and the rows of the given buckets, each at its version."""
    out = spark.createDataFrame([], schema)
    for version in sorted(set(versions.values())):
        own = [b for b, v in versions.items() if v == version]
        out = out.unionByName(spark.read.schema(schema).parquet(f"{target}/v{version}").where(F.col("bucket").isin(own)))
    return out


def current_version(spark: SparkSession, target: str) -> DataFrame:
    """The rows of the table as its last complete batch left it."""
    versions = _versions(spark, target)
    kind = spark.read.parquet(f"{target}/v{max(versions.values())}").schema
    return _buckets(spark, target, versions, kind).drop("bucket")


def breaker_states(calls: DataFrame, *, service: str, order: str, at: str, ok: str, failures: int = 3, cooldown_s: float = 60.0) -> DataFrame:
    """order, state after, allowed, for each call of a service in order: closed, open and half-open.

    at: seconds. A failure in the closed state counts up and opens at `failures`; success does not reset the count.
    An open breaker lets one probe through after the cooldown; its success closes and resets, its failure opens again.
    Each state depends on the one before, so a service's calls go through one task, in order, of which only the state
    is held."""
    schema = calls.select(service, order).schema
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, count, since = object(), "closed", 0, 0.0
        for batch in batches:
            states, allowed = [], []
            for own, now, good in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True):
                if own != name:
                    name, state, count, since = own, "closed", 0, 0.0
                if state == "open" and now - since > cooldown_s:
                    state = "half_open"
                allowed.append(state != "open")
                if state != "open" and good:
                    state, count = "closed", 0 if state == "half_open" else count
                elif state != "open":
                    count += state == "closed"
                    if state == "half_open" or count >= failures:
                        state, since = "open", now
                states.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]), batch.column(1).cast(kinds[1]), pa.array(states, pa.string()), pa.array(allowed, pa.bool_())], names=[service, order, "state", "allowed"])

    out = T.StructType([*schema, T.StructField("state", T.StringType()), T.StructField("allowed", T.BooleanType())])
    ready(calls.sparkSession)
    return calls.select(service, order, at, ok).repartition(service).sortWithinPartitions(service, order).mapInArrow(fold, out)
