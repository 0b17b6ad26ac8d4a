"""Running sums, places and percentiles in an order, without any group in one task.

Rows are cut into ranges of (group, order) and sorted within them; a range continues the sums of the ranges of its group
before it, which are as many as the ranges and groups together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def running(rows: DataFrame, *, by: list[str], order: list[Column], value: Column | None = None, ranges: list[Column] | None = None) -> DataFrame:
    """rows with _n (the place in its group, from 1) and _before (the sum of value over what comes before it there).

    ranges: what is cut into ranges, where that is less than order, and never less for a row that comes later; a sample
    of it goes to the driver. The rows are written to the shared folder once, so they should be narrow."""
    spark = rows.sparkSession
    keys = [F.col(f"`{c}`") for c in by]
    dealt = rows.withColumn("_value", F.lit(0) if value is None else value).repartitionByRange(*keys, *(ranges or order)).sortWithinPartitions(*keys, *order)
    shared_dir(spark)
    placed = dealt.withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True).withColumn("_part", F.shiftright("_id", 33))
    placed = placed.withColumn("_group", F.struct(*keys) if by else F.struct(F.lit(0).alias("all")))
    inside = Window.partitionBy("_part", "_group").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.withColumns({"_at": F.row_number().over(Window.partitionBy("_part", "_group").orderBy("_id")), "_sum": F.sum("_value").over(inside)})
    ends = placed.groupBy("_part", "_group").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_value").alias("_total"))
    past = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_total").over(past), F.lit(0)).alias("_sum_before"))
    met = within.join(starts, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    summed = met.withColumns({"_n": F.col("_rows_before") + F.col("_at"), "_before": F.col("_sum_before") + F.coalesce("_sum", F.lit(0)) - F.coalesce("_value", F.lit(0))})
    return summed.select(*[F.col(f"`{c}`") for c in rows.columns], "_n", "_before")


def percentiles(rows: DataFrame, *, group: str, value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """group, p50, p95, p99: the value at that share of the way, its place rounded half to even. Exact."""
    # equal values are counted first, so that a frequent one is one row
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_times"))
    placed = running(counted, by=[group], order=[F.col(value)], value=F.col("_times"))
    n = counted.groupBy(F.col(group).alias("_key")).agg(F.sum("_times").alias("_count"))
    place = lambda p: (F.bround(F.lit(p) * (F.col("_count") - 1)) + 1).cast("long")
    wanted = n.select("_key", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), place(p).alias("at")) for k, p in enumerate(ps)])).alias("w")).select("_key", "w.k", "w.at")
    here = (F.col("at") > F.col("_before")) & (F.col("at") <= F.col("_before") + F.col("_times"))
    met = placed.join(wanted, F.col(group).eqNullSafe(F.col("_key")) & here)  # as many rows as percentiles
    return met.groupBy(group).agg(*[F.max(F.when(F.col("k") == k, F.col(value))).alias(f"p{round(p * 100)}") for k, p in enumerate(ps)])


def carried(rows: DataFrame, *, by: list[str], order: list[Column], value: Column) -> DataFrame:
    """rows with _carried: the last value that is not null, of the row itself or those before it in its group."""
    keys = [F.col(f"`{c}`") for c in by]
    dealt = rows.withColumn("_value", value).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    shared_dir(rows.sparkSession)
    placed = dealt.withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True).withColumns({"_part": F.shiftright("_id", 33), "_group": F.struct(*keys)})
    inside = Window.partitionBy("_part", "_group").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.withColumn("_own", F.last("_value", ignorenulls=True).over(inside))
    ends = placed.groupBy("_part", "_group").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_id"))).alias("_last"))
    past = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), F.last("_last", ignorenulls=True).over(past).alias("_prior"))
    met = within.join(before, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("_own", "_prior").alias("_carried"))
