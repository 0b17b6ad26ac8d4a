"""Files to searchable chunks: parse, chunk, embed, write under a version, publish.

A version's rows are written whole before the catalogue row that makes readers see them, so what a failed run left
behind is never read, and a rerun writes the same version again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, is_safe_filename
from ..operators import catalog as K
from ..operators.layout import BLOCK, chunk_documents
from ..sources.readers import parsed_files, plain_pages
from .answer import embed, hashing_embedding
from .plugins import Plugins


def _doc_id():
    return F.xxhash64("path").bitwiseAND(F.lit((1 << 63) - 1))


def papers_of(files: DataFrame) -> DataFrame:
    """path, filename, status: proper names that come once are parsing, the others are rejected."""
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"))
    n = F.count(F.lit(1)).over(Window.partitionBy(base_name(F.col("filename"))))
    return named.withColumn("status", F.when(is_safe_filename(F.col("filename")) & (n == 1), "parsing").otherwise("rejected"))


def ingest(spark: SparkSession, path: str, library: str, *, group_id: int, parse: Callable[[bytes, str], dict] = plain_pages, model: Callable[[list[str]], list[list[float]]] | None = None, plugins: Plugins | None = None) -> DataFrame:
    """The catalogue after the files below path are loaded into the library folder.

    Writes library/chunks/group_id=…/version=… and library/catalog/version=…; the catalogue's greatest version counts.
    A file that replaces one of the same name keeps its library index, and the old version's chunks are no longer read.
    A file without text keeps its old version."""
    old = catalog(spark, library)
    version = 1 + (old.agg(F.max("version")).first()[0] or 0)
    parsed = parsed_files(spark, path, parse)
    named = parsed.withColumn("filename", F.element_at(F.split("path", "/"), -1)).where("error IS NULL")
    uploads = named.select(F.lit(group_id).alias("group_id"), "filename", _doc_id().alias("doc_id"), F.col("filename").alias("name"))
    mine = old.where(F.col("group_id") == group_id)
    numbered = K.assign_index(mine, uploads, group="group_id", name="filename", order="doc_id").select("doc_id", "library_index")
    none = F.lit(None).cast(f"array<{BLOCK}>").alias("blocks")
    bodies = named.select(_doc_id().alias("doc_id"), "filename", none, "pages", "markdown").join(numbered, "doc_id")
    chunks = chunk_documents(bodies).drop("group_id", "version").withColumn("permission", F.lit(f"group:{group_id}"))  # the former two are in the path
    chunks = chunks.withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index", F.lit(version)))
    if plugins is not None:
        changed = plugins.run("before_ingest", chunks).value
        chunks = K.governance(changed, chunks, key="chunk_id", keep=["doc_id", "filename", "library_index"])
    vectors = chunks.withColumn("embedding", hashing_embedding(F.col("text")).cast("array<float>")) if model is None else embed(chunks, model, text="text")
    where = f"{library}/chunks/group_id={group_id}/version={version}"
    vectors.write.mode("overwrite").parquet(where)
    written = spark.read.parquet(where)
    state = K.valid_batch(written, key="chunk_id", embedding="embedding").first()
    if state["n"] and not (state["n"] == state["n_keys"] and state["n_dims"] == 1 and state["least_dim"] > 0):
        raise ValueError(f"the chunks written do not fit together: {state}")
    fresh = written.groupBy("doc_id", "filename", "library_index").agg(F.count(F.lit(1)).alias("num_chunks"))
    rows = fresh.select(F.lit(group_id).cast("long").alias("group_id"), "doc_id", "filename", F.col("library_index").cast("long").alias("library_index"), F.col("num_chunks").cast("long").alias("num_chunks"), F.lit("ready").alias("status"), F.lit(version).cast("long").alias("version"))
    kept = K.without(old, rows, ["group_id", "filename"])
    kept.unionByName(rows).withColumn("published", F.lit(version).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{library}/catalog/at={version}")
    return catalog(spark, library)


CATALOG = "group_id long, doc_id long, filename string, library_index long, num_chunks long, status string, version long, published long"


def catalog(spark: SparkSession, library: str) -> DataFrame:
    """The latest catalogue, empty before the first load."""
    empty = spark.createDataFrame([], CATALOG)
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{library}/catalog")
    if not store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        return empty.drop("published")
    rows = spark.read.schema(f"{CATALOG}, at long").parquet(f"{library}/catalog")
    last = rows.agg(F.max("at")).first()[0]
    return rows.where(F.col("at") == last).drop("at", "published")


def library_chunks(spark: SparkSession, library: str, group_id: int) -> DataFrame:
    """The chunks of a library's ready papers, each at its own version; other libraries' folders are not read."""
    ready = catalog(spark, library).where((F.col("group_id") == group_id) & (F.col("status") == "ready")).select("doc_id", "version")
    return spark.read.parquet(f"{library}/chunks/group_id={group_id}").join(ready, ["doc_id", "version"], "left_semi")
