"""A manifest of a dataset by Merkle trees: a hash for each row, one for each group of rows, and one for all.

Leaves are numbered within their group in the order of their ids. A level's nodes meet in runs of consecutive ones, by
the floor of their number divided by the fanout, and each run's sorted digests are hashed into its parent, until one
node of a group is left: its subroot. The subroots form a tree of their own, up to the root. From the root downwards
each level's runs are joined to the paths of their parents, and every node gets its siblings in front of its parent's
path. A run has at most as many nodes as the fanout, numbering goes by sorted ranges (ordered.running), and a path is
joined to a run, not to each of its nodes: so no task holds a group, however large, and paths are shuffled once for each
run. The number of levels is the logarithm of the rows, so the driver's loop is short.

Digests are hexadecimal text where they are hashed again, and binary in between.

Defined cases: a null in a column is hashed as "-", so it differs from every value. A null group is a group and comes
first. Rows without an id come first in their group; rows that share an id are ordered by their leaf, and equal rows are
interchangeable. A group of one row has its leaf as subroot. An empty table gives no rows, and no root. Columns that are
not named are neither hashed nor carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running
from .common import cut

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(values: Sequence[Column]) -> Column:
    """Hexadecimal digest of the values, each with the number of its bytes before it."""
    as_text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in as_text]
    return F.sha2(F.concat(*parts), 256)


def _hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hexadecimal digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda below, run: F.sha2(F.concat(_hex(run["before"]), below, _hex(run["after"])), 256))


def siblings(path: Column) -> Column:
    """array<binary>: the siblings of a path, level by level upwards, each level's from left to right."""
    return F.flatten(F.transform(path, lambda run: F.concat(run["before"], run["after"])))


def digest_of(digests: Column) -> Column:
    """Hexadecimal digest of binary digests, as their concatenated hexadecimal text."""
    return F.sha2(_hex(digests), 256)


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, and of each group its subroot and the level on which it stood alone.

    nodes: grp, idx (from 0 in its group), digest, and what else its children keep. A run that is its group's first and
    has one node is no run: that node stands for the group."""
    levels: list[DataFrame] = []
    tops = None
    more = True
    while more:
        kept = [c for c in nodes.columns if c != "grp"]
        grouped = nodes.groupBy("grp", F.expr(f"idx div {fanout}").alias("parent"))
        runs = cut(grouped.agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("children")).withColumn("alone", (F.col("parent") == 0) & (F.size("children") == 1)))
        alone = runs.where("alone").select("grp", F.col("children")[0]["digest"].alias("top"), F.lit(len(levels)).alias("level"))
        tops = alone if tops is None else tops.unionByName(alone)
        levels.append(runs)
        above = digest_of(F.transform("children", lambda c: c["digest"]))
        nodes = runs.where("not alone").select("grp", F.col("parent").alias("idx"), F.unhex(above).alias("digest"))
        more = not nodes.isEmpty()
    return levels, tops


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level's nodes with path and top. tops: grp, top, level, and the path that its group's nodes end with."""
    heads = None
    for level in reversed(range(len(levels))):
        own = tops.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), "path", "top")
        heads = own if heads is None else heads.unionByName(own)
        named = heads.select(F.col("grp").alias("h_grp"), F.col("idx").alias("h_idx"), "path", "top")
        met = levels[level].join(named, F.col("grp").eqNullSafe(F.col("h_grp")) & (F.col("parent") == F.col("h_idx")))
        digests = met.withColumn("digests", F.transform("children", lambda c: c["digest"]))
        each = digests.select("grp", "alone", "digests", "path", "top", F.posexplode("children").alias("at", "node"))
        run = F.struct(F.slice("digests", F.lit(1), F.col("at")).alias("before"), F.slice("digests", F.col("at") + 2, F.size("digests")).alias("after"))
        path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(run), F.col("path")))
        heads = each.select("grp", "node.*", path.alias("path"), "top")
        if level:
            heads = cut(heads.select("grp", "idx", "path", "top"))
    return heads


def manifest(rows: DataFrame, *, group: str = "source", row_id: str = "doc_id", fields: Sequence[str] = FIELDS, keep: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """id, the keep columns, leaf, subroot, root (hexadecimal) and path for each row of rows.

    path: array<struct<before, after>>, arrays of the digests of a run's other nodes on the left and on the right, from
    the leaf's run up to the root's. keep: further columns to carry, computed from rows."""
    extra = keep or {}
    named = {f"k{i}": c for i, c in enumerate(extra.values())}
    leaves = rows.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{row_id}`").alias("id"), F.unhex(leaf_of([F.col(f"`{f}`") for f in fields])).alias("digest"), *[c.alias(k) for k, c in named.items()])
    placed = running(cut(leaves), by=["grp"], order=[F.col("id").asc_nulls_first(), F.col("digest")])
    nodes = placed.select("grp", (F.col("_n") - 1).alias("idx"), "digest", "id", *named)
    levels, tops = _climb(nodes, fanout)
    tops = cut(tops)
    numbered = running(tops.select(F.lit(0).alias("all"), F.col("grp").alias("name"), F.col("top").alias("digest")), by=["all"], order=[F.col("name").asc_nulls_first()])
    upper, root = _climb(numbered.select(F.col("all").alias("grp"), (F.col("_n") - 1).alias("idx"), "digest", "name"), fanout)
    none = F.array().cast("array<struct<before:array<binary>,after:array<binary>>>")
    ends = _descend(upper, root.withColumn("path", none)).select("name", "path", F.col("top").alias("root"))
    first = root.first()
    paths = tops.join(ends, F.col("grp").eqNullSafe(F.col("name"))).select("grp", "top", "level", "path")
    found = _descend(levels, cut(paths))
    whole = F.lit(bytes(first["top"]).hex() if first else None).cast("string")
    return found.select("id", *[F.col(k).alias(c) for k, c in zip(named, extra)], F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("top")).alias("subroot"), whole.alias("root"), "path")
