"""External records: pages and documents stand for what indexes reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import academic as A
from ..operators import review as V
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


@query("url_safety", r"""SELECT page_id, CASE WHEN regexp_full_match(u, '(?i)https?://[^/?#@\s]+(?:[/?#].*)?') THEN u ELSE '' END AS safe FROM
 (SELECT page_id, trim(CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN 'javascript:' || url WHEN 3 THEN ' ' || upper(url) ELSE 'https:///x' END) AS u FROM pages)""")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("page_id") % 5, F.col("url")
    shown = F.when(k == 0, u).when(k == 1, F.replace(u, F.lit("://"), F.lit("://user:pw@"))).when(k == 2, F.concat(F.lit("javascript:"), u)).when(k == 3, F.concat(F.lit(" "), F.upper(u))).otherwise("https:///x")
    return table(spark, sf_dir, "pages").select("page_id", A.safe_url(shown).alias("safe"))


@query("doi_normalise", "SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN '' ELSE '10.1000/' || doc_id END AS doi FROM documents")
def doi_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    k, d = i % 5, F.concat(F.lit("10.1000/"), i.cast("string"))
    raw = F.when(k == 0, d).when(k == 1, F.concat(F.lit("https://doi.org/"), d)).when(k == 2, F.concat(F.lit(" DOI: "), d)).when(k == 3, F.concat(F.lit("10.1 "), d)).otherwise(F.concat(F.lit("http://dx.doi.org/"), d))
    return table(spark, sf_dir, "documents").select("doc_id", A.normal_doi(raw).alias("doi"))


@query("inverted_abstract", """SELECT item_id, string_agg(w, ' ' ORDER BY i) AS abstract FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, unnest(range(len(regexp_extract_all(lower(text), '[a-z]+')))) AS i FROM benchmark) GROUP BY 1""")
def inverted_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by position to an inverted index and back."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("pos", "w"))
    lists = words.groupBy("item_id", "w").agg(F.collect_list("pos").alias("at"))
    index = lists.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("item_id", A.rebuild_abstract(F.col("index")).alias("abstract"))


def raw(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    """Every document as a record; every seventh lacks its abstract."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.lit(provider).alias("provider"), i.cast("string").alias("external_id"), F.concat(F.lit("<b>Paper</b> "), i.cast("string")).alias("title"), F.when(i % 7 != 0, F.col("text")).alias("abstract"), F.split(F.concat("lang", F.lit("~A&amp;B~")), "~").alias("authors"),
        F.when(i % 3 == 0, F.lit(2020)).alias("publication_year"), F.col("source").alias("venue"), F.when(i % 2 == 0, F.concat(F.lit("doi:10.1/"), i.cast("string"))).alias("doi"), F.concat(F.lit("https://x.example.org/"), i.cast("string")).alias("url"), i.cast("int").alias("citation_count"),
    )


PAPERS = r"""a AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g').regexp_replace('\s+', ' ', 'g')) AS abstract FROM documents WHERE doc_id % 7 <> 0),
p AS (SELECT doc_id, '论文题名：Paper ' || doc_id || chr(10) || '作者：' || lang || ', A&B' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '年份：2020' || chr(10) ELSE '' END || '期刊/会议：' || source || chr(10) || '摘要：' || CASE WHEN length(abstract) > 5000 THEN rtrim(substr(abstract, 1, 5000)) || '…' ELSE abstract END AS page_content,
 CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id ELSE doc_id::VARCHAR END AS own FROM a WHERE abstract <> '')"""


@query("paper_projection", f"WITH {PAPERS} SELECT doc_id::VARCHAR AS external_id, 'academic:crossref:' || own AS evidence_id, page_content FROM p")
def paper_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.papers(raw(spark, sf_dir, "crossref")).select("external_id", "evidence_id", "page_content")


@query("provider_dedup", f"WITH {PAPERS} SELECT DISTINCT ON (k) doc_id::VARCHAR AS external_id, provider FROM (SELECT doc_id, provider, o, CASE WHEN doc_id % 2 = 0 THEN own ELSE 'academic:' || provider || ':' || own END AS k FROM p, (VALUES ('semantic_scholar', 0), ('crossref', 1)) AS v(provider, o)) ORDER BY k, o, doc_id")
def provider_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [A.papers(raw(spark, sf_dir, p)).withColumn("pos", F.col("external_id").cast("long")) for p in ("semantic_scholar", "crossref")]
    return A.union_distinct(lists).select("external_id", "provider")


@query("providers_in_order", "SELECT source AS provider, min(doc_id) AS first FROM documents GROUP BY source")
def providers_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("provider")).agg(F.min("doc_id").alias("first"))


@query("adapter_replies", "SELECT doc_id::VARCHAR AS external_id, 'T' || doc_id AS title, 2000 + (doc_id % 20)::INT AS publication_year, CASE WHEN doc_id % 2 = 0 THEN 'https://www.semanticscholar.org/paper/' || doc_id || '?utm_source=api' ELSE 'https://e.example.org/' || doc_id END AS url, (doc_id % 9)::INT AS citation_count FROM documents")
def adapter_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in the shape of one index, a paper each, read by its adapter."""
    i = F.col("doc_id")
    paper = F.struct(i.cast("string").alias("paperId"), F.concat(F.lit("T"), i.cast("string")).alias("title"), F.lit("x").alias("abstract"), (2000 + i % 20).cast("int").alias("year"), F.when(i % 2 == 1, F.concat(F.lit("https://e.example.org/"), i.cast("string"))).otherwise("").alias("url"), (i % 9).cast("int").alias("citationCount"))
    replies = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.array(paper).alias("data"))).alias("body"))
    return A.semantic_scholar(replies, body="body").select("external_id", "title", "publication_year", "url", "citation_count")


@query("openalex_replies", "SELECT 'W' || doc_id AS external_id, 'T' || doc_id AS title, 'b a b' AS abstract, 'https://doi.org/10.1/' || doc_id AS doi, (1990 + doc_id % 30)::INT AS publication_year, lang AS venue, CASE WHEN doc_id % 2 = 0 THEN 'https://e.example.org/' || doc_id ELSE 'https://doi.org/10.1/' || doc_id END AS url, CASE WHEN doc_id % 2 = 0 THEN 'https://e.example.org/' || doc_id || '.pdf' ELSE '' END AS open_access_pdf_url, '2020-01-0' || (doc_id % 9 + 1) AS publication_date FROM documents WHERE doc_id % 5 <> 0")
def openalex_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with abstracts as inverted indexes; every fifth paper is retracted, a third have a title by its other name."""
    i = F.col("doc_id")
    d = i.cast("string")
    source = F.struct(F.struct(F.col("lang").alias("display_name")).alias("source"), F.when(i % 2 == 0, F.concat(F.lit("https://e.example.org/"), d)).alias("landing_page_url"), F.when(i % 2 == 0, F.concat(F.lit("https://e.example.org/"), d, F.lit(".pdf"))).alias("pdf_url"))
    index = F.create_map(F.lit("a"), F.array(F.lit(1)), F.lit("b"), F.array(F.lit(0), F.lit(2)))
    paper = F.struct(F.concat(F.lit("W"), d).alias("id"), F.when(i % 3 != 0, F.concat(F.lit("T"), d)).when(i % 3 == 0, "").alias("display_name"), F.concat(F.lit("T"), d).alias("title"), F.concat(F.lit("2020-01-0"), (i % 9 + 1).cast("string")).alias("publication_date"), F.concat(F.lit("https://doi.org/10.1/"), d).alias("doi"), (1990 + i % 30).cast("int").alias("publication_year"), (i % 5 == 0).alias("is_retracted"), index.alias("abstract_inverted_index"), source.alias("primary_location"))
    replies = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.array(paper).alias("results"))).alias("body"))
    return A.openalex(replies, body="body").select("external_id", "title", "abstract", "doi", "publication_year", "venue", "url", "open_access_pdf_url", "publication_date")


@query("crossref_replies", "SELECT '10.1/' || doc_id AS external_id, CASE WHEN doc_id % 4 <> 0 THEN 'T' || doc_id END AS title, CASE doc_id % 3 WHEN 0 THEN 2001 WHEN 1 THEN 2002 END::INT AS publication_year, 'G' || doc_id || ' F|Solo' AS authors, source AS venue, CASE WHEN doc_id % 2 = 0 THEN 'https://x.example.org/' || doc_id ELSE 'https://doi.org/10.1/' || doc_id END AS url FROM documents")
def crossref_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose years stand in several places, with names in parts."""
    i = F.col("doc_id")
    d = i.cast("string")
    date = lambda year: F.struct(F.array(F.array(F.lit(year), F.lit(1))).alias("date-parts"))
    people = F.array(F.struct(F.concat(F.lit("G"), d).alias("given"), F.lit("F").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("Solo").alias("family")), F.struct(F.lit("").alias("given"), F.lit("").alias("family")))
    paper = F.struct(F.concat(F.lit("10.1/"), d).alias("DOI"), F.when(i % 4 != 0, F.array(F.concat(F.lit("T"), d))).otherwise(F.array().cast("array<string>")).alias("title"), people.alias("author"), F.when(i % 3 == 0, date(2001)).alias("published-print"), F.when(i % 3 == 1, date(2002)).alias("issued"), F.array("source").alias("container-title"), F.when(i % 2 == 0, F.concat(F.lit("https://x.example.org/"), d)).alias("URL"))
    replies = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.struct(F.array(paper).alias("items")).alias("message"))).alias("body"))
    return A.crossref(replies, body="body").select("external_id", "title", "publication_year", F.array_join("authors", "|").alias("authors"), "venue", "url")


@query("usable_evidence", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 8 AND doc_id % 2 = 0 AND doc_id % 3 <> 0")
def usable_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), F.when(F.col("doc_id") % 2 == 0, "academic_search").otherwise("library").alias("evidence_origin"), F.when(F.col("doc_id") % 3 == 0, "guess").otherwise("abstract").alias("evidence_level"), F.lit("t").alias("page_content"))
    return A.usable_evidence(rows, query="source", rank="rank", top_k=8).select("source", "doc_id")


@query("external_context", "SELECT conv_id, string_agg('[外部来源: ' || role || ']' || chr(10) || substr(text, 1, 8000), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE role <> 'user' GROUP BY conv_id")
def external_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of those who are not the user, as trusted context, cut as the reference cuts them."""
    rows = table(spark, sf_dir, "conversations").withColumn("allowed", F.col("role") != "user")
    return V.outside_context(rows, question="conv_id", position="turn", source="role", content="text", allowed="allowed")


REVIEWS = {
    "contradiction": '{"answerable": true, "coverage": "insufficient", "keep": [1]}', "refusal": 'No. {"answerable": false, "coverage": "insufficient", "keep": []} So be it.',
    "kept": '```json\n{"answerable": true, "coverage": "direct", "keep": [3, 1, 99, 0, -1, true, 2.0, "2", 3]}\n```', "second": '{"answerable": true, "coverage": "scoped", "keep": [2]}', "texts": '{"answerable": true, "coverage": "direct", "keep": ["1"]}', "word": '{"answerable": "true", "coverage": "direct", "keep": [1]}',
}


def replies_of(spark: SparkSession, sf_dir: str, pairs: list[tuple[str, str | None]], texts: dict[str, str]) -> DataFrame:
    """conv_id, first, second: the pairs of replies in turn."""
    k = F.col("conv_id") % len(pairs)
    pick = lambda side: F.get(F.array(*[F.lit(texts[p[side]] if p[side] else None).cast("string") for p in pairs]), k.cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", pick(0).alias("first"), pick(1).alias("second"))


@query("review_keep", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, conv_id % 8 AS k FROM conversations) WHERE CASE k WHEN 0 THEN true WHEN 1 THEN n IN (1, 3) AND n <= 12 WHEN 2 THEN n = 2 WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN true ELSE true END")
def review_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as evidence. Reviews contradict themselves, keep some, refuse once or twice, fail the second time, keep by words, say yes in words, or are no JSON: what does not hold takes nothing away."""
    pairs = [("contradiction", None), ("kept", None), ("refusal", "second"), ("refusal", "refusal"), ("refusal", "contradiction"), ("texts", None), ("word", None), ("none", None)]
    replies = replies_of(spark, sf_dir, pairs, REVIEWS | {"none": "I cannot say."})
    return V.reviewed_evidence(table(spark, sf_dir, "conversations"), replies, question="conv_id", position="turn").select("conv_id", "turn")


@query("answer_review", "SELECT DISTINCT conv_id, CASE conv_id % 6 WHEN 0 THEN 'kept' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'refused' ELSE 'failed' END AS outcome, CASE conv_id % 6 WHEN 0 THEN 'As reviewed' WHEN 1 THEN 'Second' END AS answer FROM conversations")
def answer_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of answers: mended, refused once or twice, blank, or of another type."""
    texts = {"kept": '{"answerable": true, "coverage": "scoped", "answer": "  As reviewed\\n"}', "second": '{"answerable": true, "coverage": "direct", "answer": "Second"}', "refusal": REVIEWS["refusal"], "blank": '{"answerable": true, "coverage": "direct", "answer": " "}', "number": '{"answerable": true, "coverage": "direct", "answer": 3}'}
    pairs = [("kept", None), ("refusal", "second"), ("refusal", "refusal"), ("blank", None), ("number", None), ("refusal", "blank")]
    rows = replies_of(spark, sf_dir, pairs, texts).select("conv_id", V.answer_verdict(F.col("first")).alias("a"), V.answer_verdict(F.col("second")).alias("b"))
    state = V.outcome(F.col("a.state"), F.col("b.state"))
    return rows.select("conv_id", state.alias("outcome"), F.when(state == "kept", F.col("a.answer")).when(state == "confirmed", F.col("b.answer")).alias("answer"))


@query("shown_documents", "SELECT source, string_agg('[' || n || '] ' || lang || chr(10) || substr(text, 1, 2000), chr(10) || chr(10) ORDER BY n) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 12 GROUP BY source")
def shown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.shown_documents(table(spark, sf_dir, "documents"), question="source", position="doc_id", label="lang", text="text")
