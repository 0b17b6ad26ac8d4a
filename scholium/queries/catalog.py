"""The catalogue: customers are libraries, orders are papers, line items are chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_safe_filename
from ..operators import catalog as K
from ..operators.layout import paper_titles
from ..session import table
from .documents import CLEAN, PLAUSIBLE

QUERIES: dict = {}
QUERY_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            QUERY_SQL[name] = sql
        return fn

    return add


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ("ready", "ready", "parsing", "indexing", "cleanup_failed"))), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"), F.concat(F.col("o_orderpriority"), F.lit(".pdf")).alias("filename"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"))


PAPERS = "p AS (SELECT o_orderkey AS id, o_custkey AS group_id, o_orderpriority || '.pdf' AS filename, (['ready', 'ready', 'parsing', 'indexing', 'cleanup_failed'])[(o_orderkey % 5 + 1)::INT] AS status, o_orderdate AS created_at, o_totalprice AS price FROM orders)"


@query("paper_list", f"WITH {PAPERS} SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY created_at DESC, id) AS pos FROM p")
def paper_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("group_id", "id", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("created_at"), "id")).alias("pos"))


@query("paper_lookup", f"WITH {PAPERS} SELECT * FROM p WHERE id = 7")
def paper_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where("id = 7")


NUMBERED = """e AS (SELECT group_id, filename, id, dense_rank() OVER (PARTITION BY group_id ORDER BY first) AS library_index FROM (SELECT *, min(id) OVER (PARTITION BY group_id, filename) AS first FROM p WHERE id % 2 = 0))"""


@query("library_index", f"""WITH {PAPERS}, {NUMBERED}, u AS (SELECT * FROM p WHERE id % 2 = 1), top AS (SELECT group_id, max(library_index) AS top FROM e GROUP BY 1), known AS (SELECT group_id, filename, arg_max(library_index, id) AS known FROM e GROUP BY ALL),
f AS (SELECT group_id, filename, min(id) AS first FROM u GROUP BY ALL), n AS (SELECT f.*, known, coalesce(top, 0) AS top FROM f LEFT JOIN known USING (group_id, filename) LEFT JOIN top USING (group_id))
SELECT u.id, coalesce(known, top + count(*) FILTER (known IS NULL) OVER (PARTITION BY n.group_id ORDER BY n.first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS library_index FROM n, u WHERE false
UNION ALL SELECT u.id, library_index FROM u JOIN (SELECT group_id, filename, coalesce(known, top + count(*) FILTER (known IS NULL) OVER (PARTITION BY group_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS library_index FROM n) USING (group_id, filename)""")
def library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even papers are in the libraries, odd ones come."""
    p = papers(spark, sf_dir)
    here = p.where("id % 2 = 0").withColumn("first", F.min("id").over(Window.partitionBy("group_id", "filename")))
    here = here.withColumn("library_index", F.dense_rank().over(Window.partitionBy("group_id").orderBy("first")).cast("long"))
    return K.assign_index(here, p.where("id % 2 = 1"), group="group_id", name="filename", order="id").select("id", "library_index")


@query("legacy_number", f"""WITH {PAPERS}, l AS (SELECT id, group_id, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN id % 50 + 1 END AS library_index FROM p)
SELECT id, CASE WHEN coalesce(library_index, 0) = 0 THEN max(coalesce(library_index, 0)) OVER (PARTITION BY group_id) + count(*) FILTER (coalesce(library_index, 0) = 0) OVER (PARTITION BY group_id ORDER BY id) ELSE library_index END AS library_index FROM l""")
def legacy_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 3
    old = papers(spark, sf_dir).withColumn("library_index", F.when(k == 0, F.lit(0)).when(k == 1, F.col("id") % 50 + 1))
    return K.number_legacy(old, group="group_id", key="id").select("id", "library_index")


@query("sparse_update", f"WITH {PAPERS} SELECT id, CASE WHEN id % 4 = 0 THEN 'ready' ELSE status END AS status, CASE WHEN id % 8 = 0 THEN -1.0 ELSE price END AS price FROM p")
def sparse_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    changes = p.where("id % 4 = 0").select("id", F.lit("ready").alias("status"), F.when(F.col("id") % 8 == 0, F.lit(-1.0)).alias("price"))
    return K.sparse_update(p, changes, key="id", fields=["status", "price"]).select("id", "status", "price")


@query("cascade_delete", """SELECT 'libraries' AS level, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'papers', count(*) FROM orders WHERE o_custkey % 10 <> 0
 UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    libraries, orders, items = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    left, (kept, chunks) = K.cascade_delete(libraries, [(orders, ["o_custkey"]), (items, ["l_orderkey"])], libraries.where("c_custkey % 10 = 0"), ["c_custkey"])
    counts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "n") for name, x in (("libraries", left), ("papers", kept), ("chunks", chunks))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("recover_non_ready", f"WITH {PAPERS} SELECT status, count(DISTINCT id) AS papers, count(l_orderkey) FILTER (status = 'ready') AS chunks_left FROM p LEFT JOIN lineitem ON l_orderkey = id GROUP BY status")
def recover_non_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, items = papers(spark, sf_dir), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    _, chunks, unready = K.recover(p, items, key="id", status="status")
    left = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    gone = unready.withColumn("gone", F.lit(True))
    met = p.join(left, "id", "left").join(gone, "id", "left")
    return met.groupBy("status").agg(F.count(F.lit(1)).alias("papers"), F.sum(F.when(F.col("gone").isNull(), F.coalesce("c", F.lit(0))).otherwise(0)).alias("chunks_left"))


@query("removal_classify", f"""WITH {PAPERS}, a AS (SELECT DISTINCT id + CASE WHEN id % 50 = 0 THEN 1000000000 ELSE 0 END AS id, group_id + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS g FROM p)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p.id IS NULL THEN 'missing' WHEN p.group_id <> g THEN 'other library' WHEN status IN ('parsing', 'indexing') THEN 'busy' ELSE 'deleted' END AS outcome FROM a LEFT JOIN p USING (id)) GROUP BY outcome""")
def removal_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = papers(spark, sf_dir), F.col("id")
    asked = p.select((i + F.when(i % 50 == 0, 1_000_000_000).otherwise(0)).alias("id"), (F.col("group_id") + F.when(i % 7 == 0, 1).otherwise(0)).alias("group_id"))
    done = K.classify_removal(asked.unionByName(asked), p.select(F.col("id"), F.col("group_id"), F.col("status")), key="id", group="group_id", status="status")
    return done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("version_upsert", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 6 = 0 THEN -l_quantity ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 6 <> 0 OR l_linenumber < 4")
def version_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version of every sixth paper's chunks, without those from the fourth on, replaces the old one."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = items.where("l_orderkey % 6 = 0 AND l_linenumber < 4").withColumn("l_quantity", -F.col("l_quantity"))
    rest = K.without(items, items.where("l_orderkey % 6 = 0"), ["l_orderkey"])
    return rest.unionByName(new)


@query("previous_version", f"WITH {PAPERS} SELECT u.id, max(e.id) AS previous_id FROM (SELECT * FROM p WHERE id % 2 = 1) u LEFT JOIN (SELECT * FROM p WHERE id % 2 = 0) e ON u.group_id = e.group_id AND u.filename = e.filename GROUP BY u.id")
def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    last = p.where("id % 2 = 0").groupBy("group_id", "filename").agg(F.max("id").alias("previous_id"))
    return p.where("id % 2 = 1").join(last, ["group_id", "filename"], "left").select("id", "previous_id")


@query("governance", "SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag FROM lineitem")
def governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin overwrote the return flags; they come back."""
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")).alias("chunk_id"), "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    changed = items.withColumn("l_returnflag", F.lit("X"))
    origin = items.dropDuplicates(["chunk_id"])
    return K.governance(changed, origin, key="chunk_id", keep=["l_returnflag"]).drop("chunk_id")


@query("stage_timings", "SELECT event_type AS stage, round(sum(value), 3) AS total, round(avg(value), 3) AS mean, max(value) AS slowest, count(*) AS n FROM events GROUP BY 1")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 3).alias("mean"), F.max("value").alias("slowest"), F.count(F.lit(1)).alias("n"))


@query("batch_progress", f"WITH {PAPERS} SELECT group_id, round(avg(CASE status WHEN 'ready' THEN 1 WHEN 'indexing' THEN 0.7 WHEN 'parsing' THEN 0.2 ELSE 0 END), 6) AS progress FROM p GROUP BY 1")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.when(F.col("status") == "ready", 1.0).when(F.col("status") == "indexing", 0.7).when(F.col("status") == "parsing", 0.2).otherwise(0.0)
    return papers(spark, sf_dir).groupBy("group_id").agg(F.round(F.avg(share), 6).alias("progress"))


@query("group_ids", f"WITH {PAPERS} SELECT DISTINCT group_id FROM p")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("group_id").distinct()


FIGURES = """i AS (SELECT page_id AS doc_id, 'b' || (page_id % 3) AS block_id, 'img/' || page_id || '.png' AS image_path, sha256(split_part(html, '<body>', 1)) AS h FROM pages),
b AS (SELECT page_id AS doc_id, 'b1' AS block_id, 'cap ' || page_id AS caption FROM pages UNION ALL SELECT page_id, 'b2', NULL FROM pages),
s AS (SELECT DISTINCT h, 'about ' || substr(h, 1, 6) AS summary FROM i WHERE substr(h, 1, 1) < '8'), k AS (SELECT i.*, summary FROM i LEFT JOIN s USING (h)),
o AS (SELECT b.doc_id, b.block_id, caption, image_path, h AS image_hash, summary FROM b LEFT JOIN k ON k.doc_id = b.doc_id AND k.block_id = b.block_id UNION ALL SELECT doc_id, block_id, NULL, image_path, h, summary FROM k WHERE block_id = 'b0')"""


@query("figure_blocks", f"""WITH {FIGURES} SELECT doc_id, block_id, image_path, image_hash, concat_ws(chr(10), 'Figure', 'Caption: ' || caption, 'Visual summary: ' || summary,
 CASE WHEN caption IS NULL AND summary IS NULL THEN 'Visual summary unavailable; original figure is stored for multimodal answering.' END) AS index_text FROM o""")
def figure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    images = pages.select(i.alias("doc_id"), F.concat(F.lit("b"), (i % 3).cast("string")).alias("block_id"), F.concat(F.lit("img/"), i.cast("string"), F.lit(".png")).alias("image_path"), F.substring_index("html", "<body>", 1).cast("binary").alias("content"))
    blocks = pages.select(i.alias("doc_id"), F.lit("b1").alias("block_id"), F.concat(F.lit("cap "), i.cast("string")).alias("caption")).unionByName(pages.select(i.alias("doc_id"), F.lit("b2").alias("block_id"), F.lit(None).cast("string").alias("caption")))
    hashed = images.select(F.sha2("content", 256).alias("image_hash")).where(F.substring("image_hash", 1, 1) < "8")
    return K.attach_figures(blocks, images, hashed.withColumn("summary", F.concat(F.lit("about "), F.substring("image_hash", 1, 6))), doc="doc_id").select("doc_id", "block_id", "image_path", "image_hash", "index_text")


@query("vector_batch", "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_keys, count(DISTINCT len(embedding)) AS n_dims, min(len(embedding))::INT AS least_dim, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS least_norm FROM embeddings")
def vector_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.valid_batch(table(spark, sf_dir, "embeddings"), key="vec_id", embedding="embedding")


@query("filename_safety", r"SELECT p_partkey, regexp_full_match(f, '(?i)[^/\\]+\.pdf') AS safe FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '.pdf' WHEN 1 THEN 'a/' || p_name || '.pdf' WHEN 2 THEN p_name || '.PDF' ELSE p_name END AS f FROM part)")
def filename_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit(".pdf"))).when(k == 1, F.concat(F.lit("a/"), "p_name", F.lit(".pdf"))).when(k == 2, F.concat("p_name", F.lit(".PDF"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", is_safe_filename(name).alias("safe"))


@query("title_backfill", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE doc_id % 3 = 0),
g AS (SELECT doc_id, pos, t FROM (SELECT doc_id, pos, {CLEAN.format("line")} AS t FROM l WHERE pos < 20) WHERE {PLAUSIBLE}),
f AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM g QUALIFY place < 8),
b AS (SELECT doc_id, first(t ORDER BY round(55 - 2 * place + least(length(t), 120) / 30.0 - CASE WHEN lower(t) = lower(source) THEN 35 ELSE 0 END, 6) DESC, length(t) DESC, place) AS title FROM f JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(title, source) ELSE lang END AS title FROM documents LEFT JOIN b USING (doc_id)""")
def title_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles for the third of the papers that have a blank one, found on their first pages."""
    rows = table(spark, sf_dir, "documents").withColumn("title", F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("lang")))
    blank = rows.where(F.trim(F.coalesce("title", F.lit(""))) == "")
    parsed = blank.select("doc_id", F.concat("source", F.lit(".pdf")).alias("filename"), F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text"))).alias("pages"))
    return K.sparse_update(rows.select("doc_id", "title"), paper_titles(parsed, doc="doc_id", filename="filename"), key="doc_id", fields=["title"])
