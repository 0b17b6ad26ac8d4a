"""General relational operators: as-of and range joins, grouping sets, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carried


def asof_join(left: DataFrame, right: DataFrame, *, by: str, at: str, values: list[str]) -> DataFrame:
    """left with the values of the last row of right of the same key at or before its time; no time twice in a key of right.

    One sort by key and time, in ranges, and a carried value: none is paired with another, and a frequent key lies in as
    many ranges as it fills."""
    l = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)).withColumn("_row", F.struct(*left.columns))
    r = right.select(F.col(by), F.col(at), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    both = l.select(by, at, "_side", "_v", "_row").unionByName(r)
    got = carried(both, by=[by], order=[F.col(at), F.col("_side")], value=F.col("_v"))
    return got.where("_side = 1").select("_row.*", *[F.col(f"_carried.{v}").alias(v) for v in values])


def range_join(points: DataFrame, intervals: DataFrame, *, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= value < high, met by buckets of the given width; intervals go to each bucket that they touch."""
    bucket = F.floor(F.col(value) / width)
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_b", bucket).join(spread, "_b").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_b")


def top_k(rows: DataFrame, k: int, *, within: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("rank") <= k)


def join(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str, *, broadcast_rows: int = 200_000) -> DataFrame:
    """Any kind of equi or conditional join; the right side is broadcast only if it was counted to be small."""
    small = how in ("inner", "left", "left_semi", "left_anti") and right.limit(broadcast_rows + 1).count() <= broadcast_rows
    return left.join(F.broadcast(right) if small else right, on, how)
