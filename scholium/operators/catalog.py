"""The catalogue of libraries and papers: numbering, sparse updates, deletion, recovery, versions, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_index(existing: DataFrame, uploads: DataFrame, *, group: str, name: str, order: str, index: str = "library_index") -> DataFrame:
    """uploads with their library index: that of the latest paper of the same name, else the next after the greatest.

    New names are numbered in the order of their first upload, and repeated ones share a number."""
    top = existing.groupBy(group).agg(F.max(index).alias("_top"))
    known = existing.groupBy(group, name).agg(F.max_by(index, order).alias("_known"))
    first = uploads.groupBy(group, name).agg(F.min(order).alias("_first")).join(known, [group, name], "left").join(top, group, "left")
    fresh = F.sum(F.col("_known").isNull().cast("int")).over(Window.partitionBy(group).orderBy("_first", name).rowsBetween(Window.unboundedPreceding, 0))
    numbered = first.withColumn(index, F.coalesce("_known", F.coalesce("_top", F.lit(0)) + fresh)).select(group, name, index)
    return uploads.join(numbered, [group, name])


def number_legacy(papers: DataFrame, *, group: str, key: str, index: str = "library_index") -> DataFrame:
    """Papers with index 0 or null numbered after the greatest of their library, by key."""
    none = F.coalesce(F.col(index), F.lit(0)) == 0
    top = F.max(F.coalesce(F.col(index), F.lit(0))).over(Window.partitionBy(group))
    place = F.sum(none.cast("int")).over(Window.partitionBy(group).orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return papers.withColumn("_top", top).withColumn("_n", place).withColumn(index, F.when(none, F.col("_top") + F.col("_n")).otherwise(F.col(index))).drop("_top", "_n")


def sparse_update(rows: DataFrame, changes: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """rows with the non-null fields of changes (one row for each key)."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    met = rows.join(new, F.col(key) == F.col("_k"), "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def upsert(rows: DataFrame, new: DataFrame, *, key: list[str]) -> DataFrame:
    """new, and what it does not replace."""
    return rows.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(gone.select(*on).distinct(), on, "left_anti")


def cascade_delete(parents: DataFrame, children: list[tuple[DataFrame, list[str]]], gone: DataFrame, key: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """parents without gone, and each further table without what hangs on what went before it.

    children: tables with the columns that name their parent in the table before."""
    lost, left, out = gone.select(*key).distinct(), without(parents, gone, key), []
    for rows, on in children:
        named = lost.toDF(*on)
        out.append(without(rows, named, on))
        lost = rows.join(named, on, "left_semi").select(rows.columns[0]).distinct()
    return left, out


def classify_removal(asked: DataFrame, papers: DataFrame, *, key: str, group: str, status: str) -> DataFrame:
    """key, outcome of each distinct id asked for (key, group): deleted, missing, other library, busy."""
    p = papers.select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.col(status).alias("_s"))
    met = asked.select(key, group).distinct().join(p, F.col(key) == F.col("_k"), "left")
    outcome = F.when(F.col("_k").isNull(), "missing").when(F.col("_g") != F.col(group), "other library").when(F.col("_s").isin("parsing", "indexing"), "busy").otherwise("deleted")
    return met.select(key, outcome.alias("outcome"))


def recover(papers: DataFrame, chunks: DataFrame, *, key: str, status: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ready papers, their chunks, and the ids that a crash left unready."""
    unready = papers.where(F.coalesce(status, F.lit("")) != "ready").select(key)
    return papers.where(F.col(status) == "ready"), without(chunks, unready, [key]), unready


def governance(chunks: DataFrame, origin: DataFrame, *, key: str, keep: list[str]) -> DataFrame:
    """chunks after plugins with the columns of keep as they were at the origin, by key."""
    own = origin.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in keep])
    met = chunks.join(own, F.col(key) == F.col("_k"), "left")
    return met.select(*[c for c in chunks.columns if c not in keep], *[F.col(f"_{c}").alias(c) for c in keep])


def figure_text(summary: Column, caption: Column) -> Column:
    caption, summary = F.nullif(caption, F.lit("")), F.nullif(summary, F.lit(""))
    none = F.when(caption.isNull() & summary.isNull(), F.lit("Visual summary unavailable; original figure is stored for multimodal answering."))
    return F.concat_ws("\n", F.lit("Figure"), F.concat(F.lit("Caption: "), caption), F.concat(F.lit("Visual summary: "), summary), none)


def attach_figures(blocks: DataFrame, images: DataFrame, summaries: DataFrame, *, doc: str) -> DataFrame:
    """Figure blocks with their images' paths, hashes and index texts, and a block for each image that no block has.

    images: doc, block_id, image_path, content (binary); one summary serves all images of equal content."""
    hashed = images.select(doc, F.col("block_id").alias("_b"), "image_path", F.sha2("content", 256).alias("image_hash"))
    first = summaries.dropDuplicates(["image_hash"]).select(F.col("image_hash").alias("_h"), "summary")
    known = hashed.join(first, F.col("image_hash") == F.col("_h"), "left").drop("_h")
    met = blocks.join(known.withColumnRenamed(doc, "_d"), (F.col(doc) == F.col("_d")) & (F.col("block_id") == F.col("_b")), "left").drop("_d", "_b")
    loose = known.join(blocks.select(F.col(doc).alias("_d"), F.col("block_id").alias("_i")), (F.col(doc) == F.col("_d")) & (F.col("_b") == F.col("_i")), "left_anti")
    extra = loose.select(doc, F.col("_b").alias("block_id"), F.lit(None).cast("string").alias("caption"), "image_path", "image_hash", "summary")
    both = met.select(doc, "block_id", "caption", "image_path", "image_hash", "summary").unionByName(extra)
    return both.withColumn("index_text", figure_text(F.col("summary"), F.col("caption")))


def valid_batch(rows: DataFrame, *, key: str, embedding: str) -> DataFrame:
    """One row: n, n_keys, n_dims, least_dim, least norm; an append is allowed if n = n_keys, n_dims = 1 and least_dim > 0."""
    norm = F.sqrt(F.aggregate(F.col(embedding), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(key)).alias("n_keys"), F.count_distinct(F.size(embedding)).alias("n_dims"), F.min(F.coalesce(F.size(embedding), F.lit(0))).alias("least_dim"), F.round(F.min(norm), 4).alias("least_norm"))


def update_fields(rows: DataFrame, changes: DataFrame, *, key: str, allowed: list[str], now: Column, stamp: str = "updated_at") -> DataFrame:
    """rows with what changes says of the allowed fields, null where it says nothing, and the time of the change.

    Other columns of changes change nothing; a row without an allowed change keeps its time."""
    fields = [f for f in allowed if f in changes.columns]
    met = sparse_update(rows, changes, key=key, fields=fields)
    touched = changes.where(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull() if fields else F.lit(False)).select(F.col(key).alias("_t")).distinct()
    marked = met.join(touched, F.col(key) == F.col("_t"), "left")
    return marked.withColumn(stamp, F.when(F.col("_t").isNotNull(), now).otherwise(F.col(stamp))).drop("_t")


def visible(chunks: DataFrame, versions: DataFrame, *, doc: str, version: str, status: str) -> DataFrame:
    """The chunks that readers see: of each document those of its latest ready version. What a failed load left behind
    belongs to a version that is not ready, so a rollback has nothing to undo."""
    last = versions.where(F.col(status) == "ready").groupBy(F.col(doc).alias("_d")).agg(F.max(version).alias("_v"))
    return chunks.join(last, (F.col(doc) == F.col("_d")) & (F.col(version) == F.col("_v")), "left_semi")


def delete_step(papers: DataFrame, outcomes: DataFrame, *, key: str, status: str) -> DataFrame:
    """papers after a deletion was tried: gone where the chunks and files went, cleanup_failed where either stayed, so
    that it is tried again; those still deleting have no outcome yet. outcomes: key, chunks_gone, files_gone."""
    own = outcomes.select(F.col(key).alias("_k"), (F.col("chunks_gone") & F.col("files_gone")).alias("_gone"))
    met = papers.join(own, F.col(key) == F.col("_k"), "left").where(~F.coalesce("_gone", F.lit(False)) | (F.col(status) != "deleting"))
    return met.withColumn(status, F.when((F.col(status) == "deleting") & F.col("_gone").isNotNull(), "cleanup_failed").otherwise(F.col(status))).drop("_k", "_gone")
