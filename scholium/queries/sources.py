"""What comes from files and services: golden sets, pages, pictures, searches, versions and deletions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_markdown, text_of
from ..operators import catalog as K
from ..operators import layout as L
from ..operators import retrieval as R
from ..session import fresh_dir, table
from ..sources import images as I
from ..sources.readers import data_urls, golden_set
from ..sources.services import search_papers
from .retrieval import VECTORS, vectors

QUERIES: dict = {}
QUERY_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            QUERY_SQL[name] = sql
        return fn

    return add


@query("golden_rows", "SELECT 'q' || item_id AS id, text AS question, item_id % 3 = 0 AS expect_refusal, 2 AS page_tolerance, CASE WHEN item_id % 3 <> 0 THEN 'p' || item_id || '.pdf' END AS filename, p AS page FROM benchmark JOIN (VALUES (0, 3), (0, 4)) AS v(z, p) ON item_id % 3 <> 0 UNION ALL SELECT 'q' || item_id, text, true, 2, NULL, NULL FROM benchmark WHERE item_id % 3 = 0")
def golden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden set, written as one JSON object and read again: two pages of evidence an item, none for refusals."""
    i = F.col("item_id")
    page = lambda n: F.struct(F.concat(F.lit("p"), i.cast("string"), F.lit(".pdf")).alias("filename"), F.lit(n).alias("page"))
    evidence = F.when(i % 3 != 0, F.array(page(3), page(4))).otherwise(F.slice(F.array(page(3)), 1, 0))
    item = F.struct(F.concat(F.lit("q"), i.cast("string")).alias("id"), F.col("text").alias("question"), F.lit("").alias("ground_truth"), evidence.alias("evidence"), F.when(i % 3 == 0, F.lit(True)).alias("expect_refusal"))
    where = fresh_dir(spark, "golden")
    whole = table(spark, sf_dir, "benchmark").groupBy().agg(F.collect_list(item).alias("items")).select(F.lit(2).alias("page_tolerance"), "items")
    whole.select(F.to_json(F.struct("page_tolerance", "items")).alias("value")).write.text(where)
    return golden_set(spark, where).select("id", "question", "expect_refusal", "page_tolerance", "filename", "page")


@query("pages_both_ways", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_pages, sha256(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN lang || chr(10) || chr(10) || source ELSE '' END) AS text_sha256 FROM documents")
def pages_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third has Markdown alone, a third pages alone, a third neither."""
    k = F.col("doc_id") % 3
    page = lambda n, c: F.struct(F.lit(n).alias("page"), F.col(c).alias("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, F.col("text")).otherwise("").alias("markdown"), F.when(k == 1, F.array(page(1, "lang"), page(2, "source"))).cast(f"array<{L.PAGE}>").alias("pages"))
    both = L.pages_and_markdown(rows)
    return both.select("doc_id", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"), F.sha2("markdown", 256).alias("text_sha256"))


@query("polymorphic_text", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN trim(lang) WHEN 1 THEN lang || chr(10) || source WHEN 2 THEN source WHEN 3 THEN '{"x": "' || lang || '"}' ELSE '' END AS text FROM documents""")
def polymorphic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are strings, lists, objects with a text somewhere, other objects, or null."""
    k = F.col("doc_id") % 5
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    value = (
        F.when(k == 0, F.concat(F.lit('" '), F.col("lang"), F.lit(' "'))).when(k == 1, F.concat(F.lit("["), quoted("lang"), F.lit(', "", null, '), quoted("source"), F.lit("]")))
        .when(k == 2, F.concat(F.lit('{"text": " ", "html": ['), quoted("source"), F.lit("]}"))).when(k == 3, F.concat(F.lit('{"x": '), quoted("lang"), F.lit("}"))).otherwise("null")
    )
    return table(spark, sf_dir, "documents").select("doc_id", text_of(value).alias("text"))


IMAGES = """i AS (SELECT page_id % 10 AS q, page_id AS rank, CASE WHEN page_id % 4 = 3 THEN '/etc/' ELSE '/store/' END || (page_id % 7) || CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '.JPG' END AS path FROM pages),
u AS (SELECT q, path, min(rank) AS o FROM i WHERE starts_with(path, '/store/') GROUP BY q, path QUALIFY row_number() OVER (PARTITION BY q ORDER BY o, path) <= 3)"""


@query("image_urls", f"WITH {IMAGES} SELECT q, path AS image_path, 'data:' || CASE WHEN path LIKE '%.png' THEN 'image/png' ELSE 'image/jpeg' END || ';base64,' || base64(path::BLOB) AS data_url FROM u")
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three different pictures of each question inside the store, as data URLs."""
    i = F.col("page_id")
    path = F.concat(F.when(i % 4 == 3, "/etc/").otherwise("/store/"), (i % 7).cast("string"), F.when(i % 2 == 0, ".png").otherwise(".JPG"))
    rows = table(spark, sf_dir, "pages").select((i % 10).alias("q"), i.alias("rank"), path.alias("image_path"), path.cast("binary").alias("content"))
    return data_urls(rows, root="/store", most_images=3, group="q", order="rank")


@query("extracted_figures", """WITH r AS (SELECT page_id, 1 AS idx, 'b1' AS block_id, 1 AS page, 'png' AS suffix, html AS data FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 2, 'b2', 2, 'png', html FROM pages WHERE page_id % 2 = 0
 UNION ALL SELECT page_id, 3, 'b3', 1, 'png', 'first of ' || page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 1, 'figure_0001_001', 1, 'jpg', url FROM pages WHERE page_id % 2 = 1),
h AS (SELECT *, sha256(data) AS h, first_value(idx) OVER (PARTITION BY page_id, data ORDER BY idx) AS f FROM r WHERE data <> '')
SELECT page_id, block_id, page, printf('image_%03d', idx) AS image_id, '/store/doc_' || page_id || printf('/images/figure_%03d_', f) || substr(h, 1, 12) || '.' || suffix AS image_path, CASE suffix WHEN 'png' THEN 'image/png' ELSE 'image/jpeg' END AS image_mime_type, f = idx AS stored FROM h""")
def extracted_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: half have figure blocks, of which two show the same and one has no box, the others a picture inside."""
    block = lambda name, page, box: F.struct(F.lit(name).alias("block_id"), F.lit(page).alias("page"), (F.array(*map(F.lit, box)) if box else F.lit(None)).cast("array<double>").alias("bbox"))
    blocks = F.when(F.col("page_id") % 2 == 0, F.array(block("b1", 1, (0.0, 0.0, 9.0, 9.0)), block("b2", 2, (0.0, 0.0, 9.0, 9.0)), block("b3", 0, None)))
    content = F.to_json(F.struct("page_id", "html", "url")).cast("binary")
    files = table(spark, sf_dir, "pages").select("page_id", content.alias("content"), blocks.alias("blocks"))

    def render(raw: bytes, page: int, box: list | None) -> bytes | None:
        file = json.loads(raw)
        return file["html"].encode() if box else f"first of {file['page_id']}".encode()

    found = I.rendered_figures(files, render, lambda raw: [(1, json.loads(raw)["url"].encode(), "jpg")], doc="page_id")
    return I.stored_figures(found, doc="page_id", root="/store").select("page_id", "block_id", "page", "image_id", "image_path", "image_mime_type", F.col("data").isNotNull().alias("stored"))


SHELF = "SELECT doc_id FROM documents WHERE contains(text, 'the') AND doc_id % {0} = 0 ORDER BY doc_id LIMIT 20"


@query("federated_search", f"""WITH a AS ({SHELF.format(2)}), b AS ({SHELF.format(3)})
SELECT 'semantic_scholar' AS provider, 'T' || doc_id AS title, '10.1/' || doc_id AS doi FROM a UNION ALL SELECT 'crossref', 'T' || doc_id, '10.1/' || doc_id FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def federated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes of the documents that share some, a third that is down: what each has first for a word, each paper
    once, of the first index that has it. An index gives as many papers as it is asked for."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the"))).select("doc_id", "text")
    shelf = {p: docs.where(F.col("doc_id") % k == 0).orderBy("doc_id").limit(20).collect() for p, k in (("semantic_scholar", 2), ("crossref", 3))}

    def transport(provider: str, asked: str, limit: int) -> str:
        if provider == "openalex":
            raise OSError("down")
        found = [(r["doc_id"], r["text"]) for r in shelf[provider] if asked in r["text"]][:limit]
        if provider == "crossref":
            return json.dumps({"message": {"items": [{"DOI": f"10.1/{i}", "title": [f"T{i}"], "abstract": t} for i, t in found]}})
        return json.dumps({"data": [{"paperId": str(i), "title": f"T{i}", "abstract": t, "externalIds": {"DOI": f"10.1/{i}"}} for i, t in found]})

    return search_papers(spark, "  the ", transport, keys={"openalex": "k"}).papers.select("provider", "title", "doi")


VERSIONS = "v AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS version, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'failed' ELSE 'ready' END AS status FROM lineitem)"


@query("visible_versions", f"WITH {VERSIONS}, last AS (SELECT doc, max(version) AS version FROM v WHERE status = 'ready' GROUP BY doc) SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN last ON l_orderkey = doc AND l_linenumber = version")
def visible_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks, their numbers as versions, a third of which failed to load."""
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    versions = chunks.select("l_orderkey", "l_linenumber").distinct().withColumn("status", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, "failed").otherwise("ready"))
    return K.visible(chunks, versions, doc="l_orderkey", version="l_linenumber", status="status")


@query("deletion_states", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 5 = 4 THEN 'deleting' ELSE 'cleanup_failed' END ELSE 'ready' END AS status FROM part WHERE NOT (p_partkey % 4 = 0 AND p_partkey % 5 < 2)")
def deletion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter is being deleted; chunks or files stay for some, and some have no outcome yet."""
    k = F.col("p_partkey")
    papers = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, "deleting").otherwise("ready").alias("status"))
    outcomes = table(spark, sf_dir, "part").where("p_partkey % 5 < 4").select("p_partkey", (k % 5 != 2).alias("chunks_gone"), (k % 5 != 3).alias("files_gone"))
    return K.delete_step(papers, outcomes, key="p_partkey", status="status")


@query("field_updates", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS updated_at FROM customer")
def field_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a field that may be changed and of one that may not; a third changes, and only its time."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.lit(1).alias("updated_at"))
    changes = rows.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "new").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return K.update_fields(rows, changes, key="c_custkey", allowed=["c_mktsegment", "c_comment"], now=F.lit(2))


@query("base_union", f"""WITH {VECTORS}, u AS (SELECT query_id, vector_id, 0 AS l, rank FROM alike UNION ALL SELECT query_id, vector_id, 1, rank FROM near),
k AS (SELECT query_id, CASE WHEN vector_id % 2 = 0 THEN vector_id::VARCHAR ELSE '' END AS c, vector_id % 5 AS d, vector_id % 3 AS i, l, rank, vector_id FROM u)
SELECT query_id, first(vector_id ORDER BY l, rank) AS vector_id, row_number() OVER (PARTITION BY query_id ORDER BY min((l, rank))) AS rank FROM k GROUP BY query_id, c, d, i""")
def base_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of a question and its expansion, each chunk once by all four parts of its key."""
    v = F.col("vector_id")
    both = vectors(spark, sf_dir, "cosine").withColumn("l", F.lit(0)).unionByName(vectors(spark, sf_dir, "l2").withColumn("l", F.lit(1)))
    keyed = both.withColumn("key", R.union_key(chunk_id=F.when(v % 2 == 0, v.cast("string")), doc_id=v % 5, chunk_index=v % 3, text=F.lit(None)))
    first = R.first_of_each(keyed, within=["query_id"], key=["key"], order=[F.col("l"), F.col("rank")])
    return first.select("query_id", "vector_id", "rank")


@query("rerank_fallback", f"""WITH {VECTORS}, c AS (SELECT query_id, vector_id, rank AS recalled, CASE WHEN query_id % 100 = 0 OR vector_id % 2 = 0 THEN (vector_id * 37) % 101 / 100.0 END AS service, CASE WHEN query_id % 150 <> 0 THEN score END AS similarity FROM near),
h AS (SELECT *, CASE WHEN count(service) OVER w = count(*) OVER w THEN 'service' WHEN count(similarity) OVER w = count(*) OVER w THEN 'similarity' ELSE 'recall' END AS how FROM c WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT *, CASE how WHEN 'service' THEN service WHEN 'similarity' THEN similarity END AS s FROM h)
SELECT query_id, vector_id, how, round(s, 4) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, recalled) AS rank FROM s QUALIFY rank <= 5""")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service that scores some questions' candidates, similarities that are known for others, and recall for the rest."""
    q, v = F.col("query_id"), F.col("vector_id")
    rows = vectors(spark, sf_dir, "l2").select("query_id", "vector_id", F.col("rank").alias("recalled"), F.when((q % 100 == 0) | (v % 2 == 0), (v * 37) % 101 / 100.0).alias("service"), F.when(q % 150 != 0, F.abs("score")).alias("similarity"))
    return R.rerank_with_fallback(rows, query="query_id", service="service", similarity="similarity", recalled="recalled").select("query_id", "vector_id", "how", "rerank_score", "rank")


@query("batch_clock", "SELECT user_id, round(epoch(max(ts)) - epoch(min(ts)), 3) AS wall_s, round(sum(value), 3) AS work_s, count(*) AS n FROM events GROUP BY user_id")
def batch_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wall clock of each batch beside the sum of its stages."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round((F.max(at) - F.min(at)) / 1e6, 3).alias("wall_s"), F.round(F.sum("value"), 3).alias("work_s"), F.count(F.lit(1)).alias("n"))


@query("session_list", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each library, the latest first."""
    from pyspark.sql import Window

    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(order).alias("pos"))


@query("escaped_titles", r"SELECT p_partkey, regexp_replace(p_name || ' [x](y) *z*_' || p_brand, '([\\`*_{}\[\]()<>#+\-.!|])', '\\\1', 'g') AS title FROM part")
def escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", escape_markdown(F.concat("p_name", F.lit(" [x](y) *z*_"), "p_brand")).alias("title"))
