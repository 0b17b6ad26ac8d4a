"""Relational breadth on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..session import table

QUERIES: dict = {}
QUERY_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            QUERY_SQL[name] = sql
        return fn

    return add


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("segment_revenue", """SELECT n_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL""")
def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, l, n, r = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation", "region"))
    places = F.broadcast(n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey, "left_semi"))  # 25 rows at any size
    met = c.join(places, c.c_nationkey == places.n_nationkey).join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("n_name", "c_mktsegment").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("rollup_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[s], [p], []], s, p).agg(F.count(F.lit(1)).alias("n"))


@query("asof_events", """SELECT e.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type <> 'view') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return R.asof_join(e.where("event_type <> 'view'").select("event_id", "user_id", "ts"), views, by="user_id", at="ts", values=["view_id"]).select("event_id", "view_id")


@query("range_join", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 20")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return R.range_join(table(spark, sf_dir, "part"), s, value="p_retailprice", low="low", high="high", width=50.0).select("p_partkey", "s_suppkey")


@query("join_kinds", """SELECT 'inner' AS kind, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'left', count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'right', count(*) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey
 UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'left_semi', count(*) FROM customer SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'left_anti', count(*) FROM customer ANTI JOIN orders ON c_custkey = o_custkey""")
def join_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    counts = [R.join(c, o, c.c_custkey == o.o_custkey, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("inner", "left", "right", "full", "left_semi", "left_anti")]
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out


@query("set_operations", """SELECT 'intersect' AS op, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union_all', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, l, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier"))
    sets = [("intersect", l.select("l_suppkey").intersect(s.where("s_acctbal > 0").select("s_suppkey"))), ("except", c.select("c_custkey").subtract(o.select("o_custkey"))), ("union", c.select("c_nationkey").union(s.select("s_nationkey")).distinct()), ("union_all", c.select("c_nationkey").union(s.select("s_nationkey")))]
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n") for name, x in sets]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("window_frames", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, lag(event_id) OVER w AS before, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS type_rank, ntile(4) OVER w AS quarter, round(avg(value) OVER (PARTITION BY user_id), 4) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("last3"), F.lag("event_id").over(w).alias("before"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("type_rank"), F.ntile(4).over(w).alias("quarter"), F.round(F.avg("value").over(Window.partitionBy("user_id")), 4).alias("mean"))


@query("top_orders", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(table(spark, sf_dir, "orders"), 3, within=["o_custkey"], order=[F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")


@query("approx_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near_count, true AS near_median FROM lineitem GROUP BY 1")
def approx_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate aggregates beside exact ones: within three times the asked error of 2 %, and within 1 % of ranks."""
    rows = table(spark, sf_dir, "lineitem")
    sketches = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("sketch"), F.percentile_approx("l_quantity", 0.5, 1000).alias("median"), F.count(F.lit(1)).alias("n"))
    # by itself: beside a distinct count, there would be sketches of each part
    parts = rows.where("l_partkey is not null").select(F.col("l_returnflag").alias("_flag"), "l_partkey").distinct().groupBy("_flag").agg(F.count(F.lit(1)).alias("_parts"))
    sketches = sketches.join(parts, F.col("l_returnflag") == F.col("_flag"), "left").select("l_returnflag", "sketch", "median", "n", F.coalesce("_parts", F.lit(0)).alias("parts"))
    met = rows.select("l_returnflag", "l_quantity").join(F.broadcast(sketches), "l_returnflag")  # a row for each of three flags
    below = F.sum((F.col("l_quantity") < F.col("median")).cast("long")) / F.first("n")
    upto = F.sum((F.col("l_quantity") <= F.col("median")).cast("long")) / F.first("n")
    near = F.abs(F.first("sketch") / F.first("parts") - 1) <= 0.06
    return met.groupBy("l_returnflag").agg(F.first("parts").alias("parts"), near.alias("near_count"), ((below <= 0.51) & (upto >= 0.49)).alias("near_median"))


@query("json_props", "SELECT json_extract_string(props, '$.k')::INT % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
