"""Vector functions and exact top-k by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ready


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


#: Bytes of queries that go out in one broadcast.
QUERY_BYTES = 128 << 20


class Best:
    """The k greatest scores of each query so far, of equal ones those of the lesser ids; what a task holds of its rows."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.n = k, np.zeros(queries, np.int64)
        self.scores, self.ids = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)

    def add(self, first: int, v: np.ndarray, scores: np.ndarray) -> None:
        """scores: of the queries from `first` on and the rows v; -inf is none."""
        many, keep = len(scores), min(self.k, len(v))
        least = self.scores[first : first + many, -1]
        least = np.maximum(least, np.partition(scores, len(v) - keep, axis=1)[:, len(v) - keep] if len(v) > self.k else -np.inf)
        q, at = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))  # ties stay for the ids to decide
        self.take(first + q, v[at], scores[q, at])

    def take(self, q: np.ndarray, v: np.ndarray, scores: np.ndarray) -> None:
        """Takes the ids v with their scores for the queries at q."""
        old, at = np.unique(q, return_inverse=True)
        held = np.arange(self.k)[None] < self.n[old][:, None]
        who = np.concatenate([np.nonzero(held)[0], at])
        ids, all_scores = np.concatenate([self.ids[old][held], v]), np.concatenate([self.scores[old][held], scores])
        order = np.lexsort((ids, -all_scores, who))
        who, ids, all_scores = who[order], ids[order], all_scores[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        stay = place < self.k
        self.ids[old[who[stay]], place[stay]], self.scores[old[who[stay]], place[stay]] = ids[stay], all_scores[stay]
        self.n[old] = np.minimum(self.k, np.bincount(who, minlength=len(old)))

    def batches(self, queries: np.ndarray, sign: int, size: int = 65_536) -> Iterator[pa.RecordBatch]:
        """q, v and score times sign of what is held."""
        q, place = np.nonzero(np.arange(self.k)[None] < self.n[:, None])
        for at in range(0, len(q), size):
            a, b = q[at : at + size], place[at : at + size]
            yield pa.RecordBatch.from_arrays([pa.array(queries[a]), pa.array(self.ids[a, b]), pa.array(self.scores[a, b] * sign)], names=["q", "v", "score"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str, vector_id: str, embedding: str = "embedding", metric: str = "cosine", exclude_self: bool = False, block: int = 1024, query_bytes: int = QUERY_BYTES, digits: int = 6) -> DataFrame:
    """query_id, vector_id, score, rank: the k best vectors of each query, ties by vector_id.

    Queries go out in broadcasts of a checked size, one scan of the vectors for each (for 64 numbers, 260,000 queries);
    a task multiplies a block of queries with its rows by matrix, holds the k best of each query and passes on only these,
    so the shuffle carries k rows for each query and task. Cosine: higher is better; l2 (squared): lower. Rows without an
    embedding match nothing."""
    spark = ready(vectors.sparkSession)
    rows = queries.select(F.col(query_id).cast("long").alias("q"), F.col(embedding).alias("e"))
    size = rows.agg(F.sum(F.coalesce(F.size("e"), F.lit(0)) * 8 + 8)).first()[0] or 0
    slices, found = max(1, -(-size // query_bytes)), None
    # those without an embedding are left out by the tasks: a filter would make a computed embedding twice
    plain = vectors.select(F.col(vector_id).cast("long").alias("v"), F.col(embedding).alias("e"))
    for k_slice in range(slices):
        part = (rows.where(F.pmod(F.xxhash64("q"), F.lit(slices)) == k_slice) if slices > 1 else rows).collect()  # query_bytes, or about that
        part = [r for r in part if r["e"] is not None]
        ids, matrix = np.array([r["q"] for r in part], np.int64), np.array([r["e"] for r in part], np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            all_ids, all_rows = shared.value
            best = Best(len(all_ids), k)
            for batch in batches if len(all_ids) else ():
                batch = batch.filter(batch.column(1).is_valid())
                if not batch.num_rows:
                    continue
                v = batch.column(0).to_numpy()
                e = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, all_rows.shape[1])
                own = np.linalg.norm(e, axis=1)
                for first in range(0, len(all_ids), block):
                    ids, rows = all_ids[first : first + block], all_rows[first : first + block]
                    norms, scores = np.linalg.norm(rows, axis=1), rows @ e.T
                    if metric == "cosine":
                        scale = np.outer(norms, own)
                        scores = np.divide(scores, scale, out=np.zeros_like(scores), where=scale > 0)
                    else:
                        scores = -((norms**2)[:, None] + (own**2)[None] - 2 * scores)
                    scores = np.round(scores, digits)
                    if exclude_self:
                        scores[ids[:, None] == v[None]] = -np.inf
                    best.add(first, v, scores)
            yield from best.batches(all_ids, 1 if metric == "cosine" else -1)

        got = plain.mapInArrow(search, "q long, v long, score double")
        found = got if found is None else found.unionByName(got)
    better = F.desc("score") if metric == "cosine" else F.asc("score")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(better, "v"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("v").alias("vector_id"), (F.col("score") + F.lit(0.0)).alias("score"), "rank")


#: Vectors that the cells of an index are fitted on, and cells, at most.
SAMPLE, MOST_CELLS = 20_000, 4096


def means(rows: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centres of the rows by Lloyd's method; one that loses all its rows begins again at a random row."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), cells, replace=False)]
    for _ in range(rounds):
        own = nearest(rows, centres, 1)[:, 0]
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=cells)
        np.add.at(sums, own, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rows[rng.integers(0, len(rows), cells)])
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): the nearest centres of each row, the nearest first."""
    far = (centres**2).sum(axis=1)[None] - 2 * rows @ centres.T
    n = min(n, len(centres))
    some = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)


def matrix_of(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def build_cells(vectors: DataFrame, where: str, *, vector_id: str, embedding: str = "embedding", cells: int | None = None) -> None:
    """An index for search_cells below where: every vector in the folder of its nearest centre, and the centres.

    The centres are fitted on at most SAMPLE vectors, the first by a hash of their ids; there are as many as the square
    root of the number of vectors, unless said otherwise."""
    spark = ready(vectors.sparkSession)
    rows = vectors.where(F.col(embedding).isNotNull()).select(F.col(vector_id).cast("long").alias("v"), F.col(embedding).cast("array<double>").alias("e"))
    sample = np.array([r["e"] for r in rows.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()], np.float64)
    n = max(1, min(cells or int(rows.count() ** 0.5), MOST_CELLS, len(sample)))
    centres = means(sample, n) if len(sample) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)  # MOST_CELLS rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = nearest(matrix_of(batch.column(1)), shared.value, 1)[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], names=["v", "e", "cell"])

    placed = rows.mapInArrow(place, "v long, e array<double>, cell int")
    placed.repartition("cell", F.pmod("v", F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(f"{where}/vectors")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, e array<double>").coalesce(1).write.mode("overwrite").parquet(f"{where}/centres")


def search_cells(queries: DataFrame, where: str, k: int, *, query_id: str, embedding: str = "embedding", probes: int = 8, query_bytes: int = QUERY_BYTES, digits: int = 6) -> DataFrame:
    """query_id, vector_id, score (cosine), rank: the k best vectors in the `probes` cells nearest to each query, ties by
    vector_id. Only the cells that some query probes are read. Not all of the k best need be there; see the tests."""
    spark = ready(queries.sparkSession)
    centres = np.array([r["e"] for r in spark.read.parquet(f"{where}/centres").orderBy("cell").collect()], np.float64)
    rows = queries.where(F.col(embedding).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(embedding).cast("array<double>").alias("e"))
    size, found = rows.agg(F.sum(F.size("e") * 8 + 8)).first()[0] or 0, None
    slices = max(1, -(-size // query_bytes))
    stored = spark.read.schema("v long, e array<double>, cell int").parquet(f"{where}/vectors")
    for k_slice in range(slices):
        part = (rows.where(F.pmod(F.xxhash64("q"), F.lit(slices)) == k_slice) if slices > 1 else rows).collect()  # query_bytes, or about that
        ids, matrix = np.array([r["q"] for r in part], np.int64), np.array([r["e"] for r in part], np.float64).reshape(len(part), -1 if part else 1)
        cells = nearest(matrix, centres, probes) if len(part) else np.zeros((0, 1), np.int64)
        asked = {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}
        shared = spark.sparkContext.broadcast((ids, matrix, asked))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, asked = shared.value
            norms = np.linalg.norm(matrix, axis=1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, e, own = batch.column(0).to_numpy(), matrix_of(batch.column(1)), batch.column(2).to_numpy()
                for c in np.unique(own):
                    at, who = np.flatnonzero(own == c), asked.get(int(c), np.zeros(0, np.int64))
                    if not len(who):
                        continue
                    scale = np.outer(norms[who], np.linalg.norm(e[at], axis=1))
                    products = matrix[who] @ e[at].T
                    scores = np.round(np.divide(products, scale, out=np.zeros_like(products), where=scale > 0), digits)
                    keep = min(k, len(at))
                    worst = np.partition(scores, len(at) - keep, axis=1)[:, len(at) - keep]
                    q, x = np.nonzero(scores >= worst[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who[q]]), pa.array(v[at[x]]), pa.array(scores[q, x])], names=["q", "v", "score"])

        got = stored.where(F.col("cell").isin(sorted(asked))).mapInArrow(search, "q long, v long, score double")
        found = got if found is None else found.unionByName(got)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("v").alias("vector_id"), (F.col("score") + F.lit(0.0)).alias("score"), "rank")
