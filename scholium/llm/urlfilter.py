"""URL rules by a sort-merge range join, in DataFrame operations only.

Reversed hosts make a host and its subdomains one interval of keys, and a path prefix is an interval of paths.
A sweep puts the interval ends and the keys in order and carries the stack of intervals open at each key: every
end has the stack that holds after it, and a key takes that of the last end before it. The first sweep finds
for each URL the rule hosts above its host, the second, for each of these hosts, the rules whose path its path
begins with. The longest rule wins (host and path together; of equal lengths the longer host).

Each sweep works in groups (top-level label; rule host). Groups of more rows than half a task's fair share are dealt
into salts of that size, with the group's interval ends repeated for each salt, so that no task gets a hot group
whole. Such groups are at most twice as many as there are partitions; only their list is broadcast.

Defined cases: a URL that is null or lacks "://" has empty host and path and meets no rule. Rules with an empty or
null host or a null path are void; of equal rules a block wins. Repeated rows of pages each give a row. Columns
beside the id and the URL are ignored, whatever their names. Without a rule the verdict is `default`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii

URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    """a.example.org becomes org,example,a, — every label is ended, so a parent's key begins its children's."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","))


def sweep(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """points (group, key, row) with stack: the members of prefixes (group, key; distinct) that begin the key, outermost first.

    Points without any have an empty stack."""
    points = cut(points)
    counts = points.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    share = max(1, points.count() // (2 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(counts.where(F.col("n") > share).select("group", F.ceil(F.col("n") / share).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    inner = prefixes.select("group", F.col("key").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("key"))).alias("n"))
    above = inner.select("group", "inner", F.substring("inner", F.lit(1), F.col("n")).alias("key")).join(prefixes, ["group", "key"])
    nested = above.groupBy("group", "inner").agg(F.array_sort(F.collect_list("key")).alias("stack"))  # as many as its key has prefixes
    opens = nested.select("group", F.col("inner").cast("binary").alias("at"), F.lit(1).alias("kind"), "stack")
    closes = nested.select("group", F.concat(F.col("inner").cast("binary"), F.unhex(F.lit("FF"))).alias("at"), F.lit(0).alias("kind"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    ends = opens.unionByName(closes).join(hot, "group", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    shape = points.schema["row"].dataType
    ends = ends.withColumn("row", F.lit(None).cast(shape))
    keyed = points.join(hot, "group", "left").select("group", F.col("key").cast("binary").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("array<string>").alias("stack"), F.pmod(F.xxhash64("key", "row"), salts).cast("int").alias("salt"), "row")
    order = Window.partitionBy("group", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = keyed.unionByName(ends).withColumn("open", F.last("stack", ignorenulls=True).over(order))
    return carried.where("kind = 2").select("group", "row", F.coalesce("open", F.array().cast("array<string>")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages. rules: host, path, verdict (allow or block)."""
    usable = rules.where("host <> '' and path is not null").select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
    usable = usable.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
    top = lambda rev: F.substring_index(rev, ",", 1)
    hosts = usable.select(reversed_host(F.col("host")).alias("key")).distinct().select(top(F.col("key")).alias("group"), "key")
    urls = pages.groupBy(F.col(page_id).alias("id"), F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("copies"))
    split = urls.select("id", "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    points = split.select(reversed_host(F.col("host")).alias("key"), F.struct("id", "url", "copies", "host", "path").alias("row"))
    under = sweep(points.select(top(F.col("key")).alias("group"), "key", "row"), hosts)
    met = under.where(F.size("stack") > 0).select(F.explode("stack").alias("group"), F.col("row.path").alias("key"), "row")
    paths = usable.select(reversed_host(F.col("host")).alias("group"), F.col("path").alias("key"))
    fits = sweep(met, paths).where(F.size("stack") > 0).select("group", F.element_at("stack", -1).alias("key"), "row")
    named = usable.select(reversed_host(F.col("host")).alias("group"), F.col("path").alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
    won = fits.join(named, ["group", "key"]).groupBy(F.col("row.id").alias("w_id"), F.col("row.url").alias("w_url")).agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict")).alias("best"))
    same = split["id"].eqNullSafe(won["w_id"]) & split["url"].eqNullSafe(won["w_url"])
    all_rows = split.join(won, same, "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return all_rows.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
