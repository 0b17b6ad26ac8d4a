"""A kept index for BM25: postings in blocks with what their best score can be, changes as further segments, and a search
that reads only blocks which can matter.

Documents are cut by their ids into shards of a bounded number of documents, and lie there in that order, in ranges of a
few. A row of postings is one token of one shard, with a block for each range that has it. A block keeps its best pairs
(frequency, length of document): those that no other has more of and less. They give the block's highest score for any
average length, so insertions and deletions leave them right.

A search goes shard by shard, without a shuffle of scores: of each question a shard gets the blocks' bounds, sums them by
range, scores the ranges with the greatest sums whole, and so has a score that the k-th best has at least. Then it takes
the question's tokens from the one that can add most down, reads their blocks in the ranges that can still reach that
score, and drops ranges as they fall behind. What is left is exact.

Below the index's folder: postings/seg=N (written once), terms/at=N (changes of document frequencies), gone/at=N (deleted
documents by segment and shard), and current/at=N, the version that a reader follows, written last. So a change that
fails is never seen, and the next question after a change sees it. merge writes one segment of what is left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import tokens
from ..session import ready, shared_dir
from .ordered import running
from .retrieval import Tokenizer

#: Documents of a shard, documents of a range, questions that meet a shard at once.
SHARD, RANGE, QUESTIONS = 20_000, 8, 500
#: What no token is: the row of a shard's documents, and that of its deleted ones.
DOCUMENTS, GONE = "", " "
#: Ranges that are scored whole at first, for each document that is wanted.
FIRST = 4
#: Scores nearer than this may be equal when they are rounded.
SLACK = 2e-6

POSTINGS = "seg int, shard int, token string, ranges array<int>, sizes array<int>, best_sizes array<int>, best_f array<int>, best_dl array<int>, docs array<int>, fs array<int>, ids array<long>"
CURRENT = "version int, segments array<int>, changes array<int>, n long, length long, mean_raw double"


@dataclass(frozen=True)
class Version:
    """What a reader follows. changes: the numbers of the folders of terms and gone."""

    version: int
    segments: tuple[int, ...]
    changes: tuple[int, ...]
    n: int
    length: int
    mean_raw: float


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, where: str) -> Version:
    """The last version that was written whole; version -1 where there is none."""
    folder, store = _path(spark, f"{where}/current")
    names = [f.getPath() for f in store.listStatus(folder)] if store.exists(folder) else []
    whole = [int(p.getName()[3:]) for p in names if p.getName().startswith("at=") and store.exists(_path(spark, f"{p}/_SUCCESS")[0])]
    if not whole:
        return Version(-1, (), (), 0, 0, 0.0)
    row = spark.read.schema(CURRENT).parquet(f"{where}/current/at={max(whole)}").first()
    return Version(row.version, tuple(row.segments), tuple(row.changes), row.n, row.length, row.mean_raw)


def _raw(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _frequencies(spark: SparkSession, where: str, changes: tuple[int, ...]) -> DataFrame:
    """token, df of all tokens that a document has."""
    rows = spark.read.schema("token string, df long").parquet(*[f"{where}/terms/at={c}" for c in changes])
    return rows.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")


def _publish(spark: SparkSession, where: str, at: int, segments: tuple[int, ...], changes: tuple[int, ...], n: int, length: int) -> Version:
    mean = _frequencies(spark, where, changes).agg(F.avg(_raw(F.lit(n), F.col("df")))).first()[0] or 0.0
    row = (at, list(segments), list(changes), n, length, mean)
    spark.createDataFrame([row], CURRENT).coalesce(1).write.mode("overwrite").parquet(f"{where}/current/at={at}")
    return Version(at, segments, changes, n, length, mean)


COUNTED = "id long, dl int, tokens array<string>, fs array<int>"


def _shard_of(ids: DataFrame, docs_per_range: int) -> tuple[np.ndarray, Callable[[Column], Column]]:
    """The first id of each shard, and the shard of an id: shards are cut from all ids in order, in whole ranges."""
    size = -(-SHARD // docs_per_range) * docs_per_range
    firsts = np.array(sorted(r["id"] for r in running(ids, by=[], order=[F.col("id")]).where((F.col("_n") - 1) % size == 0).collect()), np.int64)  # one of SHARD

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, ids.to_numpy(), side="right") - 1)

    return firsts, shard


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values))


def _blocks(shard: int, table: pa.Table, docs_per_range: int) -> pa.RecordBatch:
    """The postings of one shard. table: COUNTED rows of its documents."""
    table = table.sort_by("id")
    ids, dl = table.column("id").to_numpy(), table.column("dl").to_numpy().astype(np.int32)
    lists = table.column("tokens").combine_chunks()
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes, fs = coded.indices.to_numpy(zero_copy_only=False), pc.list_flatten(table.column("fs").combine_chunks()).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")  # within a token by document
    codes, doc, fs = codes[order], doc[order], fs[order]
    spot = doc // docs_per_range
    first = np.ones(len(codes), bool)  # of a block
    first[1:] = (codes[1:] != codes[:-1]) | (spot[1:] != spot[:-1])
    starts = np.flatnonzero(first)
    sizes, block = np.diff(np.append(starts, len(codes))), np.cumsum(first) - 1
    # the best pairs: by falling frequency, those that are shorter than all before them in their block
    ranked = np.lexsort((dl[doc], -fs, block))
    place, least, best = np.arange(len(codes)) - starts[block], np.full(len(starts), np.iinfo(np.int32).max), np.zeros(len(codes), bool)
    for r in range(int(sizes.max(initial=0))):
        at = ranked[place == r]
        own, lengths = block[at], dl[doc[at]]
        best[at] = lengths < least[own]
        least[own] = np.minimum(least[own], lengths)
    best_sizes = np.bincount(block[best], minlength=len(starts))
    n_tokens = len(coded.dictionary)
    block_ends = np.searchsorted(codes[starts], np.arange(n_tokens), side="right")
    pair_ends = np.searchsorted(codes, np.arange(n_tokens), side="right")
    best_ends = np.searchsorted(codes[best], np.arange(n_tokens), side="right")
    # the row of the documents themselves comes last
    every = np.arange(len(ids), dtype=np.int32)
    ranges = np.unique(every // docs_per_range).astype(np.int32)
    i32, also = lambda *xs: np.concatenate(xs).astype(np.int32), lambda ends, n: np.append(ends, (ends[-1] if len(ends) else 0) + n)
    columns = [
        pa.array(np.full(n_tokens + 1, shard, np.int32)), pa.array([*coded.dictionary.to_pylist(), DOCUMENTS], pa.string()), _lists(i32(spot[starts], ranges), also(block_ends, len(ranges))), _lists(i32(sizes, np.bincount(every // docs_per_range)), also(block_ends, len(ranges))),
        _lists(i32(best_sizes, np.zeros(len(ranges))), also(block_ends, len(ranges))), _lists(i32(fs[best]), also(best_ends, 0)), _lists(i32(dl[doc[best]]), also(best_ends, 0)), _lists(i32(doc, every), also(pair_ends, len(every))), _lists(i32(fs, dl), also(pair_ends, len(every))),
        pa.array([None] * n_tokens + [ids], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in POSTINGS.split(", ")[1:]])


def _write_segment(rows: DataFrame, where: str, seg: int, ids: DataFrame, docs_per_range: int) -> None:
    """postings of one segment. rows: COUNTED; ids: their ids, however they are found. The rows are shuffled once."""
    firsts, shard = _shard_of(ids, docs_per_range)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _blocks(key[0].as_py(), pa.Table.from_batches(list(batches)).drop_columns(["shard"]), docs_per_range)

    dealt = rows.withColumn("shard", shard("id"))
    out = dealt.repartition(max(1, len(firsts)), "shard").groupBy("shard").applyInArrow(run, POSTINGS.split(", ", 1)[1])
    out.sortWithinPartitions("token", "shard").write.mode("overwrite").parquet(f"{where}/postings/seg={seg}")  # row groups of few tokens


def _postings(spark: SparkSession, where: str, version: Version) -> DataFrame:
    paths = [f"{where}/postings/seg={s}" for s in version.segments]
    return spark.read.schema(POSTINGS).option("basePath", f"{where}/postings").parquet(*paths) if paths else spark.createDataFrame([], POSTINGS)


def _gone(spark: SparkSession, where: str, version: Version) -> DataFrame:
    """seg, shard, ids: the documents deleted from segments that are still read."""
    rows = spark.read.schema("seg int, shard int, ids array<long>").parquet(*[f"{where}/gone/at={c}" for c in version.changes])
    return rows.where(F.col("seg").isin(list(version.segments))).groupBy("seg", "shard").agg(F.flatten(F.collect_list("ids")).alias("ids"))


def _without(spark: SparkSession, where: str, version: Version, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the documents whose id is in ids: seg, shard, ids of those that the version has; and for their tokens the
    number of them, with the sum of their lengths for DOCUMENTS. Only shards that have such a document are looked at."""
    postings, gone = _postings(spark, where, version), _gone(spark, where, version)
    asked = ids.select(F.col("id").cast("long").alias("id")).distinct()
    known = postings.where(F.col("token") == DOCUMENTS).select("seg", "shard", F.explode(F.arrays_zip("ids", "docs")).alias("d")).select("seg", "shard", F.col("d.ids").alias("id"), F.col("d.docs").alias("doc"))
    found = known.join(asked, "id", "left_semi").join(gone.select("seg", "shard", F.explode("ids").alias("id")), ["seg", "shard", "id"], "left_anti")
    hit = found.groupBy("seg", "shard").agg(F.collect_list("id").alias("ids"), F.collect_list("doc").alias("docs")).checkpoint(eager=True)  # a shard's at most

    def count(own: pa.Table, hits: pa.Table) -> pa.Table:
        """token, n, length of one shard: what the documents of hits have."""
        if not hits.num_rows or not own.num_rows:
            return pa.table({"token": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "length": pa.array([], pa.int64())})
        lists = own.column("docs").combine_chunks()
        row, docs, fs = (x.to_numpy(zero_copy_only=False) for x in (pc.list_parent_indices(lists), pc.list_flatten(lists), pc.list_flatten(own.column("fs").combine_chunks())))
        goes = np.zeros(int(docs.max(initial=0)) + 1, bool)
        goes[hits.column("docs").combine_chunks().flatten().to_numpy()] = True
        goes = goes[docs]
        n = np.bincount(row[goes], minlength=own.num_rows)
        length = np.where(np.array(own.column("token").to_pylist()) == DOCUMENTS, np.bincount(row[goes], fs[goes], minlength=own.num_rows), 0)
        return pa.table({"token": own.column("token"), "n": n, "length": length.astype(np.int64)})

    met = postings.select("seg", "shard", "token", "docs", "fs").join(F.broadcast(hit.select("seg", "shard")), ["seg", "shard"], "left_semi")  # a row for each shard
    counts = met.groupBy("seg", "shard").cogroup(hit.select("seg", "shard", "docs").groupBy("seg", "shard")).applyInArrow(count, "token string, n long, length long")
    return hit.select("seg", "shard", "ids"), counts.groupBy("token").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).where("n > 0")


def _counted(docs: DataFrame, doc_id: str, text: str, cut: Tokenizer) -> DataFrame:
    """COUNTED of each document."""
    words = docs.select(F.col(doc_id).cast("long").alias("id"), F.array_sort(F.coalesce(cut(F.col(text)), F.array().cast("array<string>"))).alias("ts"))
    # the sorted tokens' ends tell how often each stands there
    last = F.filter(F.transform("ts", lambda t, i: F.struct(t.alias("token"), i.alias("i"))), lambda x: ~x["token"].eqNullSafe(F.get("ts", x["i"] + 1)))
    ends = words.select("id", F.size("ts").alias("dl"), last.alias("ends"))
    before = lambda i: F.coalesce(F.get("ends", i - 1)["i"], F.lit(-1))
    return ends.select("id", "dl", F.col("ends.token").alias("tokens"), F.transform("ends", lambda x, i: x["i"] - before(i)).alias("fs"))


def put(docs: DataFrame, where: str, *, doc_id: str = "doc_id", text: str = "text", docs_per_range: int = RANGE, cut: Tokenizer = tokens) -> Version:
    """Adds the documents as a segment of the index below where; those whose ids it has are replaced. Ids are distinct."""
    spark = ready(docs.sparkSession)
    shared_dir(spark)
    was = current(spark, where)
    at = was.version + 1
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    _write_segment(_counted(docs, doc_id, text, cut), where, at, ids, docs_per_range)
    own = spark.read.schema(POSTINGS).parquet(f"{where}/postings/seg={at}")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    n, length = own.where(F.col("token") == DOCUMENTS).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(total("fs")), F.lit(0))).first()
    added = own.where(F.col("token") != DOCUMENTS).groupBy("token").agg(F.sum(total("sizes")).alias("df"))
    lost_n = lost_length = 0
    gone = spark.createDataFrame([], "seg int, shard int, ids array<long>")
    if was.segments:
        gone, lost = _without(spark, where, was, ids)
        lost = lost.checkpoint(eager=True)
        lost_n, lost_length = _lost(lost)
        added = added.unionByName(lost.where(F.col("token") != DOCUMENTS).select("token", (-F.col("n")).alias("df")))
    added.write.mode("overwrite").parquet(f"{where}/terms/at={at}")
    gone.write.mode("overwrite").parquet(f"{where}/gone/at={at}")
    return _publish(spark, where, at, (*was.segments, at), (*was.changes, at), was.n + n - lost_n, was.length + length - lost_length)


def _lost(counts: DataFrame) -> tuple[int, int]:
    row = counts.where(F.col("token") == DOCUMENTS).first()
    return (row.n, row.length) if row else (0, 0)


def delete(ids: DataFrame, where: str) -> Version:
    """Takes the documents whose id is in the column id away; ids that the index has not are ignored."""
    spark = ready(ids.sparkSession)
    shared_dir(spark)
    was = current(spark, where)
    at = was.version + 1
    gone, counts = _without(spark, where, was, ids)
    counts = counts.checkpoint(eager=True)
    n, length = _lost(counts)
    counts.where(F.col("token") != DOCUMENTS).select("token", (-F.col("n")).alias("df")).write.mode("overwrite").parquet(f"{where}/terms/at={at}")
    gone.write.mode("overwrite").parquet(f"{where}/gone/at={at}")
    return _publish(spark, where, at, was.segments, (*was.changes, at), was.n - n, was.length - length)


def merge(spark: SparkSession, where: str, *, docs_per_range: int = RANGE) -> Version:
    """One segment of all documents that are left; searches give the same as before."""
    shared_dir(ready(spark))
    was = current(spark, where)
    at = was.version + 1
    postings = _postings(spark, where, was)
    gone = _gone(spark, where, was)
    held = postings.where(F.col("token") == DOCUMENTS).select("seg", "shard", F.explode("ids").alias("id"))
    ids = held.join(gone.select("seg", "shard", F.explode("ids").alias("id")), ["seg", "shard", "id"], "left_anti").select("id")

    def documents(own: pa.Table, away: pa.Table) -> pa.Table:
        """The documents of one shard that are left, from its postings."""
        tokens_of = own.column("token").to_pylist()
        at = tokens_of.index(DOCUMENTS) if DOCUMENTS in tokens_of else -1
        if at < 0:
            return pa.table({"id": pa.array([], pa.int64()), "dl": pa.array([], pa.int32()), "tokens": pa.array([], pa.list_(pa.string())), "fs": pa.array([], pa.list_(pa.int32()))})
        row = own.slice(at, 1)
        ids, places, lengths = (row.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "docs", "fs"))
        stays = ~np.isin(ids, away.column("ids").combine_chunks().flatten().to_numpy()) if away.num_rows else np.ones(len(ids), bool)
        new = np.full(int(places.max()) + 1, -1, np.int64)
        new[places[stays]] = np.arange(int(stays.sum()))
        lists = own.column("docs").combine_chunks()
        token, docs, fs = (x.to_numpy(zero_copy_only=False) for x in (pc.list_parent_indices(lists), pc.list_flatten(lists), pc.list_flatten(own.column("fs").combine_chunks())))
        keep = (token != at) & (new[docs] >= 0)
        token, docs, fs = token[keep], new[docs[keep]], fs[keep]
        order = np.argsort(docs, kind="stable")
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=int(stays.sum()))))), pa.int32())
        names = own.column("token").combine_chunks().take(pa.array(token[order]))
        return pa.table({"id": ids[stays], "dl": lengths[stays].astype(np.int32), "tokens": pa.ListArray.from_arrays(offsets, names), "fs": pa.ListArray.from_arrays(offsets, pa.array(fs[order].astype(np.int32)))})

    rows = postings.select("seg", "shard", "token", "docs", "fs", "ids").groupBy("seg", "shard").cogroup(gone.groupBy("seg", "shard")).applyInArrow(documents, COUNTED)
    _write_segment(rows, where, at, ids, docs_per_range)
    _frequencies(spark, where, was.changes).write.mode("overwrite").parquet(f"{where}/terms/at={at}")
    spark.createDataFrame([], "seg int, shard int, ids array<long>").write.mode("overwrite").parquet(f"{where}/gone/at={at}")
    return _publish(spark, where, at, (at,), (at,), was.n, was.length)


class _Shard:
    """The blocks of one shard's tokens, as arrays."""

    def __init__(self, table: pa.Table, k1: float, b: float, avgdl: float) -> None:
        self.k1, self.b, self.avgdl = k1, b, avgdl
        self.tokens: dict[str, dict] = {}
        gone: list = []
        column = {c: table.column(c).combine_chunks() for c in ("ranges", "sizes", "best_sizes", "best_f", "best_dl", "docs", "fs", "ids")}
        part = lambda c, i: column[c][i].values.to_numpy(zero_copy_only=False)
        for i, token in enumerate(table.column("token").to_pylist()):
            if token == DOCUMENTS:
                self.ids, at, lengths = part("ids", i), part("docs", i), part("fs", i)
            elif token == GONE:
                gone.extend(part("ids", i).tolist())
            else:
                self.tokens[token] = {c: part(c, i) for c in ("ranges", "sizes", "best_sizes", "best_f", "best_dl", "docs", "fs")}
        self.n = int(at.max()) + 1
        self.dl = np.zeros(self.n)
        self.dl[at] = lengths
        self.live = ~np.isin(self.ids, gone)
        for t in self.tokens.values():
            t["ends"] = np.cumsum(t["sizes"])
            firsts = np.concatenate(([0], np.cumsum(t["best_sizes"])[:-1])).astype(np.int64)
            t["bound"] = np.maximum.reduceat(self.part(t["best_f"], t["best_dl"]), firsts)  # of a weight of 1

    def part(self, f: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return f * (self.k1 + 1) / (f + self.k1 * (1 - self.b + self.b * dl / self.avgdl))

    def add(self, scores: np.ndarray, token: dict, blocks: np.ndarray, weight: float) -> int:
        """Reads the blocks into the scores."""
        if not len(blocks):
            return 0
        sizes = token["sizes"][blocks]
        jump = np.repeat(token["ends"][blocks] - np.cumsum(sizes), sizes)
        at = np.arange(int(sizes.sum())) + jump
        docs = token["docs"][at]
        scores[docs] += weight * self.part(token["fs"][at], self.dl[docs])
        return len(blocks)

    def best(self, asked: list[tuple[str, float]], k: int, docs_per_range: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """ids and scores of the k best documents (and those that rounding may make equal), blocks read, and all blocks."""
        known = [(self.tokens[t], w) for t, w in asked if t in self.tokens]
        ranges = -(-self.n // docs_per_range)
        bounds = [max(0.0, w) * t["bound"] for t, w in known]
        rest = np.zeros(ranges)
        for (t, _), bound in zip(known, bounds):
            rest[t["ranges"]] += bound
        scores, read, every = np.zeros(ranges * docs_per_range), 0, sum(len(t["ranges"]) for t, _ in known)
        live = np.zeros(ranges * docs_per_range, bool)
        live[: self.n] = self.live
        reach = lambda: np.where(live, scores, 0.0).reshape(ranges, docs_per_range).max(axis=1)
        first = np.zeros(ranges, bool)
        first[np.argsort(-rest, kind="stable")[: FIRST * k]] = True
        for t, w in known:
            read += self.add(scores, t, np.flatnonzero(first[t["ranges"]]), w)
        open_ones, least = ~first & (rest > 0), 0.0
        order = sorted(range(len(known)), key=lambda i: -bounds[i].max(initial=0.0))
        order.sort(key=lambda i: known[i][1] >= 0)  # what takes away comes first, so that scores only grow
        for i in [None, *order]:
            if i is not None:
                t, w = known[i]
                read += self.add(scores, t, np.flatnonzero(open_ones[t["ranges"]]), w)
                rest[t["ranges"]] -= bounds[i]
            if self.n > k and (i is None or known[i][1] >= 0):
                least = max(least, np.partition(np.where(live & (np.repeat(first, docs_per_range) | (i is not None)), scores, 0.0), -k)[-k])
            open_ones &= reach() + rest >= least - SLACK
        found = np.flatnonzero(live & np.repeat(first | open_ones, docs_per_range) & (scores > 0))
        top = scores[found]
        if len(found) > k:
            found = found[top >= np.partition(top, len(found) - k)[len(found) - k] - SLACK]
        return self.ids[found], scores[found], read, every


FOUND = "question_id long, doc_id long, score double, blocks_read long, blocks long"


def search(questions: DataFrame, where: str, k: int = DEFAULTS.recall_k, *, question_id: str = "question_id", question: str = "question", settings: Settings = DEFAULTS, docs_per_range: int = RANGE, with_blocks: bool = False, cut: Tokenizer = tokens) -> DataFrame:
    """question_id, doc_id, score, rank: as retrieval.bm25 over the documents that the index has now.

    with_blocks: question_id, blocks_read, blocks instead. Questions meet shards in groups of about QUESTIONS, through
    the postings of their tokens; what a shard sends is k rows for each question. docs_per_range, cut: as in put."""
    spark = ready(questions.sparkSession)
    version = current(spark, where)
    k1, b, avgdl = settings.bm25_k1, settings.bm25_b, version.length / version.n if version.n else 1.0
    asked = questions.select(F.col(question_id).cast("long").alias("question_id"), F.explode(cut(F.col(question))).alias("token")).groupBy("question_id", "token").agg(F.count(F.lit(1)).alias("times"))
    groups = max(1, math.ceil(questions.count() / QUESTIONS))
    raw = _raw(F.lit(version.n), F.col("df"))
    idf = F.when(raw < 0, settings.bm25_epsilon * version.mean_raw).otherwise(raw)
    frequencies = _frequencies(spark, where, version.changes) if version.changes else spark.createDataFrame([], "token string, df long")
    terms = asked.join(frequencies, "token").select("question_id", "token", (F.col("times") * idf).alias("weight"), F.pmod(F.xxhash64("question_id"), F.lit(groups)).cast("int").alias("group"))
    askers = terms.groupBy("group", "token").agg(F.collect_list(F.struct("question_id", "weight")).alias("askers"))  # QUESTIONS or about that
    always = spark.range(groups).select(F.col("id").cast("int").alias("group"), F.explode(F.array(F.lit(DOCUMENTS), F.lit(GONE))).alias("token"), F.array().cast(askers.schema["askers"].dataType).alias("askers"))
    postings = _postings(spark, where, version)
    if version.changes:
        gone = _gone(spark, where, version)
        none = {c: F.lit(None).cast(kind) for c, kind in (x.split(" ") for x in POSTINGS.split(", "))}
        postings = postings.unionByName(gone.select(*[F.lit(GONE).alias("token") if c == "token" else F.col(c) if c in ("seg", "shard", "ids") else none[c].alias(c) for c in none]))
    met = postings.join(askers.unionByName(always), "token")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asking: dict[int, list[tuple[str, float]]] = {}
        for token, who in zip(table.column("token").to_pylist(), table.column("askers").to_pylist()):
            for a in who:
                asking.setdefault(a["question_id"], []).append((token, a["weight"]))
        shard = _Shard(table, k1, b, avgdl)
        for q, own in asking.items():
            ids, scores, read, every = shard.best(sorted(own), k, docs_per_range)
            ids, scores = (np.concatenate((x, [y])) for x, y in ((ids, -1), (scores, 0.0)))  # the last row tells of the blocks
            n = len(ids)
            blocks = [np.concatenate((np.zeros(n - 1, np.int64), [x])) for x in (read, every)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q)), pa.array(ids), pa.array(scores), *map(pa.array, blocks)], names=["question_id", "doc_id", "score", "blocks_read", "blocks"])

    found = met.groupBy("group", "seg", "shard").applyInArrow(run, FOUND)
    if with_blocks:
        return found.groupBy("question_id").agg(F.sum("blocks_read").alias("blocks_read"), F.sum("blocks").alias("blocks"))
    scored = found.where("blocks = 0").select("question_id", "doc_id", F.round("score", 6).alias("score")).where("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k)
