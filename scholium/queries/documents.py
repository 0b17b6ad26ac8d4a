"""Documents as parsed papers: their lines are blocks, their block types go round a fixed list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bar_row, caption_number, content_hash, is_continued, is_meaningful, similarity_ratio, splitter, squash, stride_split, visible
from ..functions.text import table_rows as cells_of
from ..operators import layout as L
from ..session import table
from ..sources.readers import content_list

QUERIES: dict = {}
QUERY_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            QUERY_SQL[name] = sql
        return fn

    return add


RAW_TYPES = ["section_title", "text", "Paragraph", "text", "table_caption", "Table", "list_item", "text", "image", "interline_equation", "reference", "weird", "text"]
LINES = f"""l AS (SELECT doc_id, pos, line, ({RAW_TYPES!r})[(pos % {len(RAW_TYPES)}) + 1] AS raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))"""
KINDS = LINES + """, b AS (SELECT doc_id, pos, line, raw, CASE WHEN contains(lower(raw), 'table') THEN CASE WHEN contains(lower(raw), 'caption') THEN 'table_caption' ELSE 'table' END
 WHEN contains(lower(raw), 'image') OR contains(lower(raw), 'figure') THEN CASE WHEN contains(lower(raw), 'caption') THEN 'figure_caption' ELSE 'figure' END
 WHEN contains(lower(raw), 'equation') OR contains(lower(raw), 'formula') THEN 'equation' WHEN contains(lower(raw), 'title') OR contains(lower(raw), 'heading') THEN 'heading' WHEN contains(lower(raw), 'list') THEN 'list_item'
 WHEN lower(raw) IN ('text', 'reference') THEN lower(raw) ELSE 'paragraph' END AS kind FROM l)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.withColumn("raw", F.get(F.array(*map(F.lit, RAW_TYPES)), F.col("pos") % len(RAW_TYPES)))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "pos", F.col("line").alias("text"), L.chunk_kind(F.col("raw")).alias("kind"), (F.floor(F.col("pos") / 5) + 1).cast("int").alias("page"), F.lit(None).cast("double").alias("reading_order"))
    rows = rows.withColumns({"page_end": F.col("page"), "block_id": F.concat(F.lit("b"), F.col("pos").cast("string"))})
    return L.carry_section(L.reading_order(rows, doc="doc_id"), doc="doc_id")


@query("block_types", f"WITH {KINDS} SELECT kind, raw, CASE WHEN kind IN ('text', 'reference') THEN 'paragraph' ELSE kind END AS parsed, count(*) AS n FROM b GROUP BY ALL")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("raw", L.chunk_kind(F.col("raw")).alias("kind"), L.parsed_kind(F.col("raw")).alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


SECTIONS = KINDS + r""", s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN nullif(trim(regexp_replace(trim(line), '^#{1,6}\s+', '')), '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '正文') AS section FROM b)"""


@query("section_carry", f"WITH {SECTIONS} SELECT doc_id, pos, kind, section FROM s")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "pos", "kind", "section")


@query("greedy_pack", f"""WITH RECURSIVE {SECTIONS},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, kind IN ('table', 'equation', 'figure', 'figure_caption', 'table_caption') AS atomic FROM s WHERE trim(line) <> ''),
w AS (SELECT doc_id, 0::BIGINT AS i, 0 AS pack, 0::BIGINT AS used, true AS closed, false AS placed FROM r GROUP BY doc_id
  UNION ALL SELECT r.doc_id, r.i,
    CASE WHEN kind = 'heading' THEN w.pack WHEN w.closed OR atomic OR w.used + length(trim(line)) > 1000 THEN w.pack + 1 ELSE w.pack END,
    CASE WHEN kind = 'heading' THEN w.used WHEN w.closed OR atomic OR w.used + length(trim(line)) > 1000 THEN length(line) ELSE w.used + length(line) END,
    kind = 'heading' OR atomic, kind <> 'heading'
  FROM w JOIN r ON r.doc_id = w.doc_id AND r.i = w.i + 1)
SELECT doc_id, w.pack - 1 AS chunk, length(string_agg(trim(line), chr(10) || chr(10) ORDER BY i)) AS n_chars, min(pos // 5 + 1)::INT AS page, max(pos // 5 + 1)::INT AS page_end, arg_min(section, i) AS section,
       arg_min(CASE WHEN atomic THEN kind ELSE 'paragraph' END, i) AS content_type, count(*) AS n_blocks
FROM w JOIN r USING (doc_id, i) WHERE placed GROUP BY doc_id, w.pack""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = L.pack(blocks(spark, sf_dir), doc="doc_id")
    return packs.select("doc_id", "chunk", F.length("text").alias("n_chars"), "page", "page_end", "section", "content_type", F.size("block_ids").alias("n_blocks"))


@query("page_texts", """SELECT doc_id, page, length(string_agg(t, chr(10) ORDER BY pos)) AS n_chars, count(*) AS n FROM
 (SELECT doc_id, pos, pos // 5 + 1 AS page, trim(line) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)) WHERE t <> '' GROUP BY ALL""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("page", F.floor(F.col("pos") / 5) + 1)
    pages = L.page_texts(rows, doc="doc_id", page="page", order="pos", text="line")
    return pages.select("doc_id", "page", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n"))


@query("page_sections", r"""WITH l AS (SELECT doc_id, pos // 5 + 1 AS page, arg_min(trim(line), pos) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE trim(line) <> '' GROUP BY ALL),
f AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\s+(.+)$') THEN trim(regexp_extract(line, '^#{1,6}\s+(.+)$', 1))
   WHEN (regexp_full_match(line, '\d+(\.\d+){0,3}\.?\s+\S.{0,60}') AND NOT regexp_matches(line, '[。，,]$')) OR (length(line) <= 40 AND NOT regexp_matches(line, '[。.，,；;]$')) THEN line END AS h FROM l)
SELECT doc_id, page, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '正文') AS section FROM f""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = L.page_texts(lines(spark, sf_dir).withColumn("page", F.floor(F.col("pos") / 5) + 1), doc="doc_id", page="page", order="pos", text="line")
    return L.page_section(pages, doc="doc_id", page="page", text="text").select("doc_id", "page", "section")


@query("page_and_box", """SELECT event_id, greatest(1, coalesce(k + 1, 1))::INT AS page, CASE WHEN k % 3 = 0 THEN 0 ELSE 4 END AS n_box, (k % 3 <> 0 AND k > 0) AS proper
 FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def page_and_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    written = lambda form: F.replace(F.lit(form), F.lit("K"), k)
    raw = F.when(k.cast("int") % 3 == 0, written('["0", "x", K, K]')).when(k.cast("int") % 3 == 1, written('{"x0": 0, "y0": 0, "x1": K, "y1": K, "z": 9}')).otherwise(written('[0, "0", K, K, 9]'))
    rows = table(spark, sf_dir, "events").select("event_id", L.page_number(k, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("page"), L.box_of(raw).alias("box"))
    return rows.select("event_id", "page", F.size("box").alias("n_box"), L.is_proper_box(F.col("box")).alias("proper"))


@query("meaningful_pages", r"""SELECT page_id, length(v) AS n_visible, length(regexp_replace(v, '[^\p{L}\p{N}]', '', 'g')) >= 4 AS meaningful
 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g') AS v FROM pages)""")
def meaningful_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(visible(F.col("html"))).alias("n_visible"), is_meaningful(F.col("html")).alias("meaningful"))


PLAUSIBLE = r"""length(t) BETWEEN 6 AND 320 AND length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) >= 5 AND length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) / length(t) >= 0.35
  AND NOT regexp_matches(t, '(?i)^(?:\d+(?:\.\d+)*[.、]?\s*)?(?:abstract|摘要|introduction|引言|绪论|contents?|目录|references?|参考文献|acknowledg(?:e)?ments?|致谢|methods?|方法|results?|结果|conclusions?|结论)\s*$')
  AND NOT regexp_matches(t, '(?i)(?:doi\s*:|https?://|www\.|@|issn|isbn|arxiv|transactions\s+on|proceedings\s+of|journal\s+of|volume\s+\d+|vol\.\s*\d+|copyright|all rights reserved|microsoft\s+word\s*-)')"""
CLEAN = r"regexp_replace(trim(regexp_replace(regexp_replace(trim({0}), '^#{{1,6}}\s*', ''), '\s+', ' ', 'g')), '^[ \-–—|_]+|[ \-–—|_]+$', '', 'g')"


@query("title_argmax", rf"""WITH l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
c AS (SELECT doc_id, source, pos, {CLEAN.format("line")} AS t FROM l), g AS (SELECT * FROM c WHERE {PLAUSIBLE}),
h AS (SELECT * FROM g WHERE doc_id % 2 = 0 AND pos < 5 AND pos % 5 IN (0, 3)),
f AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM g WHERE doc_id % 2 = 1 AND pos < 20 QUALIFY place < 8),
z AS (SELECT doc_id, pos, t, 10 + (pos * 7) % 5 AS size, pos * 90 AS y FROM g WHERE doc_id % 3 = 0 AND pos < 6 AND pos * 90 <= 390),
r AS (SELECT *, size / top AS rel FROM (SELECT *, max(size) OVER (PARTITION BY doc_id) AS top FROM z) WHERE size / top >= 0.78),
k AS (SELECT doc_id, 120 - least(pos, 20)::DOUBLE AS score, 1000 + pos AS pos, t FROM h
 UNION ALL SELECT doc_id, 126, 10000000, string_agg(t, ' ' ORDER BY pos) FROM h GROUP BY doc_id HAVING count(*) BETWEEN 2 AND 3
 UNION ALL SELECT doc_id, 55 - 2 * place + least(length(t), 120) / 30.0, 20000000 + place, t FROM f
 UNION ALL SELECT doc_id, 90 + least(length(t), 120) / 30.0, 30000000, t FROM (SELECT doc_id, 'Properties of ' || source || ' ' || lang AS t FROM documents WHERE doc_id % 5 = 0)
 UNION ALL SELECT doc_id, 100 + 12 * rel - y / 600.0 * 8 + least(length(t), 120) / 30.0, 30000001 + pos, t FROM r
 UNION ALL SELECT doc_id, 114 + 8 * max(rel), 40000000, string_agg(t, ' ' ORDER BY pos) FROM r GROUP BY doc_id HAVING count(*) BETWEEN 2 AND 4),
b AS (SELECT k.doc_id, first(t ORDER BY round(score - CASE WHEN lower(t) = lower(source) THEN 35 ELSE 0 END, 6) DESC, length(t) DESC, pos) AS title FROM (SELECT * FROM k WHERE {PLAUSIBLE}) AS k JOIN documents USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, coalesce(title, source) AS title FROM documents LEFT JOIN b USING (doc_id)""")
def title_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by headings, first lines, file properties and large lines, each for some documents."""
    k, lines = F.col("doc_id"), F.split("text", "\n")
    kind = lambda i: F.when(i % 5 == 0, "section_title").when(i % 5 == 3, "Heading").otherwise("text")
    block = lambda x, i: F.struct(kind(i).alias("type"), x.alias("text"), (F.floor(i / 5) + 1).cast("int").alias("page"), F.lit(None).cast("double").alias("reading_order"))
    large = lambda x, i: F.struct((10 + (i * 7) % 5).cast("double").alias("size"), (i * 90).cast("double").alias("y"), x.alias("text"))
    parsed = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", F.lit(".pdf")).alias("filename"), F.when(k % 2 == 0, F.transform(lines, block)).alias("blocks"), F.when(k % 2 == 1, F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text")))).alias("pages"),
        F.when(k % 5 == 0, F.concat_ws(" ", F.lit("Properties of"), "source", "lang")).alias("metadata_title"), F.lit(600.0).alias("page_height"), F.when(k % 3 == 0, F.transform(F.slice(lines, 1, 6), large)).alias("lines"),
    )
    return L.paper_titles(parsed, doc="doc_id", filename="filename")


TABLES = r"""t AS (SELECT doc_id, pos, list_transform(string_split(regexp_replace(trim(line), '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c)) AS cells FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE contains(line, '|')),
r AS (SELECT doc_id, pos, cells FROM t WHERE len(list_filter(cells, lambda c: NOT regexp_full_match(c, '[:\-\s]*'))) > 0)"""


def bar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", bar_row(F.col("line")).alias("cells")).where("cells is not null")


@query("table_rows", f"WITH {TABLES} SELECT doc_id, pos, len(cells) AS n, array_to_string(cells, '~') AS cells FROM r")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_rows(spark, sf_dir).select("doc_id", "pos", F.size("cells").alias("n"), F.array_join("cells", "~").alias("cells"))


@query("fill_down", f"""WITH {TABLES}, p AS (SELECT doc_id, pos, unnest(list_resize(cells, w, '')) AS raw, unnest(range(w)) AS col FROM (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id) AS w FROM (SELECT doc_id, pos, list_transform(cells, lambda c: CASE WHEN length(c) % 4 = 0 THEN '' ELSE c END) AS cells FROM r)))
SELECT doc_id, pos, col, coalesce(last_value(nullif(raw, '') IGNORE NULLS) OVER (PARTITION BY doc_id, col ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS cell FROM p""")
def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    blanked = bar_rows(spark, sf_dir).withColumn("cells", F.transform("cells", lambda c: F.when(F.length(c) % 4 == 0, "").otherwise(c)))
    return L.fill_down(blanked, table=["doc_id"], order="pos", cells="cells")


@query("table_text", f"""WITH {TABLES}, p AS (SELECT doc_id, pos, unnest(list_resize(cells, w, '')) AS raw, unnest(range(w)) AS col FROM (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id) AS w FROM r)),
f AS (SELECT doc_id, pos, col, raw, coalesce(last_value(nullif(raw, '') IGNORE NULLS) OVER (PARTITION BY doc_id, col ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS cell, dense_rank() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM p),
n AS (SELECT doc_id, col, cell AS name FROM f WHERE i = 0),
w AS (SELECT doc_id, i, 'Row ' || i || ': ' || string_agg(CASE WHEN name = '' THEN 'column' ELSE name END || '=' || cell, '; ' ORDER BY col) AS line FROM f JOIN n USING (doc_id, col) WHERE i > 0 AND cell <> '' GROUP BY doc_id, i),
a AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM r GROUP BY doc_id), c AS (SELECT doc_id, string_agg(name, '; ' ORDER BY col) AS names FROM n GROUP BY doc_id), t2 AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM w GROUP BY doc_id)
SELECT doc_id, trim('Table: table ' || doc_id || chr(10) || 'Pages: ' || CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END || chr(10) || 'Columns: ' || names || coalesce(chr(10) || body, ''), ' ') AS text FROM a JOIN c USING (doc_id) LEFT JOIN t2 USING (doc_id)""")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with bars of each document as one table, in words."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda r: r["cells"])
    rows = bar_rows(spark, sf_dir).groupBy("doc_id").agg(listed.alias("rows"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    text = L.table_text(F.concat(F.lit("table "), F.col("doc_id").cast("string")), F.col("a"), F.col("b"), F.col("rows"), F.lit(""))
    return rows.select("doc_id", text.alias("text"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of table lines on a page is a table; pages give captions and boxes in turn."""
    rows = bar_rows(spark, sf_dir).withColumn("page", (F.floor(F.col("pos") / 5) + 1).cast("int"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda r: r["cells"])
    tables = rows.groupBy("doc_id", "page").agg(listed.alias("rows"), (F.min(F.col("pos") % 5) / 5).alias("top"), ((F.max(F.col("pos") % 5) + 1) / 5).alias("bottom"))
    k = F.col("page") % 4
    caption = F.when(k == 0, F.concat(F.lit("Table "), F.floor(F.col("page") / 4).cast("string"))).when(k == 1, "Table 1 (continued)").otherwise("")
    none = F.lit(None).cast("double")
    return tables.select("doc_id", F.col("page").alias("ord"), caption.alias("caption"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "rows", F.when(k != 2, F.col("top")).otherwise(none).alias("top"), F.when(k != 2, F.col("bottom")).otherwise(none).alias("bottom"))


@query("continued_tables")
def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that go on over pages, joined. The likeness of headers is no SQL function."""
    return L.merge_continued(page_tables(spark, sf_dir), doc="doc_id").withColumn("n_rows", F.size("rows")).drop("rows")


@query("header_likeness")
def header_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the first words of neighbouring documents of a source are, by matching blocks."""
    head = F.substring_index("text", "\n", 1)
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", head.alias("head"), F.lag(head).over(Window.partitionBy("source").orderBy("doc_id")).alias("before"))
    return rows.where("before is not null").select("doc_id", F.round(similarity_ratio("before", "head"), 6).alias("ratio"))


@query("markup_tables", """SELECT page_id, 4 AS n_rows, 'lang~' || page_id || '~' || page_id || '|a & b~c~|x~~' || substr(url, 1, 8) || '|1~2~3' AS cells FROM pages""")
def markup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in HTML, with spans, references and rows without text, read to cells."""
    page = F.col("page_id").cast("string")
    rows = [F.lit("<table><TR><th>lang</th><th colspan='2'>"), page, F.lit("</th></TR><tr><td> </td></tr><tr><td>a &amp; <b>b</b></td><td>c</td><td></td></tr><tr><td>x<td><td>"), F.substring("url", 1, 8), F.lit("</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>")]
    found = table(spark, sf_dir, "pages").select("page_id", cells_of(F.concat(*rows)).alias("rows"))
    return found.select("page_id", F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), "|").alias("cells"))


@query("content_items", """SELECT event_id, 1 + (event_id % 2 = 0)::INT AS n, CASE WHEN event_id % 2 = 0 THEN 'title|' || event_type ELSE event_type END AS types, json_extract_string(props, '$.k')::INT + 1 AS page FROM events""")
def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, bare or wrapped, made of events and read again."""
    k = F.get_json_object("props", "$.k").cast("int")
    item = F.struct(F.col("event_type").alias("type"), F.lit("x").alias("text"), k.alias("page_idx"))
    title = F.struct(F.lit("title").alias("type"), F.lit("y").alias("text"), k.alias("page_idx"))
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.array(title, item).alias("content_list")))).otherwise(F.to_json(F.array(item)))
    rows = table(spark, sf_dir, "events").select("event_id", content_list(body).alias("items"))
    page = L.page_number(F.get("items", F.lit(0))["page_idx"], F.lit(None).cast("int"), F.lit(None).cast("int"))
    return rows.select("event_id", F.size("items").alias("n"), F.array_join(F.transform("items", lambda i: i["type"]), "|").alias("types"), page.alias("page"))


@query("artifact_rank", """WITH f AS (SELECT user_id, event_id, ts, event_type || '/' || CASE WHEN event_id % 3 = 0 THEN 'view' WHEN event_id % 3 = 1 THEN 'preview_' || event_type ELSE 'other' END || '.md' AS path, event_id % 100 AS size FROM events),
s AS (SELECT *, CASE WHEN split_part(split_part(path, '/', 2), '.', 1) = 'view' THEN 100 WHEN contains(split_part(split_part(path, '/', 2), '.', 1), 'view') THEN 30 ELSE 0 END + CASE WHEN split_part(path, '/', 1) = 'view' THEN 50 ELSE 0 END AS points FROM f)
SELECT user_id, event_id, points, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, ts DESC, size DESC, path DESC) AS rank FROM (SELECT *, max(points) OVER (PARTITION BY user_id) AS top FROM s) WHERE points > 0 OR top = 0""")
def artifact_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 3 == 0, "view").when(F.col("event_id") % 3 == 1, F.concat(F.lit("preview_"), "event_type")).otherwise("other")
    files = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.concat("event_type", F.lit("/"), name, F.lit(".md")).alias("path"), (F.col("event_id") % 100).alias("size"), F.lit("view").alias("stem"))
    return L.rank_artifacts(files, doc="user_id", path="path", stem="stem", mtime="ts", size="size").select("user_id", "event_id", "points", "rank")


@query("stride_split", """SELECT doc_id, unnest(range(n)) AS piece, length(substr(text, (1 + 800 * unnest(range(n)))::INT, 1000)) AS n_chars FROM (SELECT doc_id, text, greatest(1, ceil((length(text) - 200) / 800.0))::INT AS n FROM documents WHERE length(text) > 0)""")
def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(stride_split(F.col("text"), 1000, 200)).alias("piece", "t"))
    return rows.select("doc_id", "piece", F.length("t").alias("n_chars"))


@query("recursive_split")
def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(splitter(1000, 200)("text")).alias("piece", "text"))
    return rows.select("doc_id", "piece", F.length("text").alias("n_chars"))


#: Characters of a block or page at most in the query of chunks: less than a chunk's, so that packing alone decides.
PIECE = 900
PIECES = f"flatten(list_transform(string_split(text, chr(10)), lambda s: list_transform(range(greatest(1, (length(s) + {PIECE - 1}) // {PIECE})), lambda i: substr(s, {PIECE} * i + 1, {PIECE}))))"
CHUNK_COLUMNS = ["doc_id", "chunk_index", "page", "page_start", "page_end", "section", "content_type", "char_count", "table_id", "table_caption", "continued_table", "paper_title", "library_index", "permission", "layout_confidence"]


@query("chunk_documents", rf"""WITH RECURSIVE {SECTIONS.replace("string_split(text, chr(10))", PIECES)},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, kind IN ('table', 'equation', 'figure', 'figure_caption', 'table_caption') AS atomic FROM s WHERE trim(line) <> '' AND doc_id % 2 = 0),
w AS (SELECT doc_id, 0::BIGINT AS i, 0 AS pack, 0::BIGINT AS used, true AS closed, false AS placed FROM r GROUP BY doc_id
  UNION ALL SELECT r.doc_id, r.i,
    CASE WHEN kind = 'heading' THEN w.pack WHEN w.closed OR atomic OR w.used + length(trim(line)) > 1000 THEN w.pack + 1 ELSE w.pack END,
    CASE WHEN kind = 'heading' THEN w.used WHEN w.closed OR atomic OR w.used + length(trim(line)) > 1000 THEN length(line) ELSE w.used + length(line) END,
    kind = 'heading' OR atomic, kind <> 'heading'
  FROM w JOIN r ON r.doc_id = w.doc_id AND r.i = w.i + 1),
blocks AS (SELECT doc_id, 0 AS way, w.pack AS part, string_agg(trim(line), chr(10) || chr(10) ORDER BY i) AS text, min(pos // 5 + 1) AS page, min(pos // 5 + 1) AS page_start, max(pos // 5 + 1) AS page_end, arg_min(section, i) AS section,
  arg_min(CASE WHEN atomic THEN kind ELSE 'paragraph' END, i) AS content_type FROM w JOIN r USING (doc_id, i) WHERE placed GROUP BY doc_id, w.pack),
o AS (SELECT doc_id, pos, trim(line) AS line FROM l WHERE doc_id % 2 = 1),
x AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\s+(.+)$') THEN trim(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1)) WHEN line <> '' AND ((regexp_full_match(line, '\d+(\.\d+){{0,3}}\.?\s+\S.{{0,60}}') AND NOT regexp_matches(line, '[。，,]$')) OR (length(line) <= 40 AND NOT regexp_matches(line, '[。.，,；;]$'))) THEN line END AS h FROM o),
pages AS (SELECT doc_id, 0 AS way, pos AS part, line AS text, pos + 1 AS page, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '正文') AS section FROM x),
tables AS (SELECT doc_id, 1 AS way, 0 AS part, CASE WHEN doc_id % 4 = 1 THEN 'Table: ' || lang ELSE 'Table t1' || chr(10) || 'Pages: 2-3' || chr(10) || 'Caption:' || chr(10) || lang || ' | ' || source END AS text, 2 AS page, CASE WHEN doc_id % 4 = 1 THEN 'Cap ' || lang ELSE 'Table' END AS section, CASE WHEN doc_id % 4 = 1 THEN 'Cap ' || lang ELSE '' END AS caption FROM documents WHERE doc_id % 2 = 1),
u AS (SELECT doc_id, way, part, text, page, page_start, page_end, section, content_type, NULL::VARCHAR AS table_id, NULL::VARCHAR AS table_caption, NULL::BOOLEAN AS continued_table FROM blocks
 UNION ALL SELECT doc_id, way, part, text, page, NULL::BIGINT, NULL::BIGINT, section, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BOOLEAN FROM pages WHERE text <> ''
 UNION ALL SELECT doc_id, way, part, text, page, 2, 3, section, 'table', 't1', caption, doc_id % 4 = 1 FROM tables)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY way, part) - 1 AS chunk_index, page, page_start, page_end, section, content_type, length(u.text) AS char_count, table_id, table_caption, coalesce(continued_table, false) AS continued_table, source AS paper_title, (doc_id % 7)::INT AS library_index, 'group:' || (doc_id % 3) AS permission,
 CASE WHEN doc_id % 2 = 0 THEN 'high' END AS layout_confidence FROM u JOIN documents USING (doc_id)""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed papers: half have blocks, which are packed to the target of 1,000 characters, the others pages
    and tables. Lines are cut into pieces below the target, as how a longer text is split is no SQL function."""
    k = F.col("doc_id")
    kind = lambda i: F.get(F.array(*map(F.lit, RAW_TYPES)), i % len(RAW_TYPES))
    none = F.lit(None)
    block = lambda x, i: F.struct(F.concat(F.lit("b"), i.cast("string")).alias("block_id"), kind(i).alias("type"), x.alias("text"), (F.floor(i / 5) + 1).cast("int").alias("page"), none.cast("int").alias("page_end"), none.cast("double").alias("reading_order"))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(s) - 1) / PIECE).cast("int"))), lambda i: F.substring(s, PIECE * i + 1, F.lit(PIECE)))
    lines = F.flatten(F.transform(F.split("text", "\n"), cut))
    one = F.struct(F.lit("t1").alias("table_id"), F.when(k % 4 == 1, F.concat(F.lit("Cap "), "lang")).alias("caption"), F.lit(2).alias("page_start"), F.lit(3).alias("page_end"), (k % 4 == 1).alias("continued"), F.when(k % 4 == 1, F.concat(F.lit("Table: "), "lang")).alias("normalized_text"), F.concat_ws(" | ", "lang", "source").alias("raw_text"))
    parsed = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 2 == 0, F.transform(lines, block)).alias("blocks"), F.when(k % 2 == 1, F.transform(lines, lambda x, i: F.struct((i + 1).alias("page"), F.trim(x).alias("text")))).alias("pages"), F.lit("").alias("markdown"),
        F.array(one).alias("tables"), F.concat("source", F.lit(".pdf")).alias("filename"), (k % 7).cast("string").alias("library_index"), (k % 3).alias("group_id"),
    )
    return L.chunk_documents(parsed).select(*CHUNK_COLUMNS).withColumn("continued_table", F.coalesce("continued_table", F.lit(False)))


@query("chunk_markdown")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown alone, split where separators allow; the splits are no SQL function."""
    none = F.lit(None)
    parsed = table(spark, sf_dir, "documents").select("doc_id", none.cast(f"array<{L.BLOCK}>").alias("blocks"), none.cast(f"array<{L.PAGE}>").alias("pages"), F.col("text").alias("markdown"))
    return L.chunk_documents(parsed).select("doc_id", "chunk_index", "page", "section", "char_count")


@query("caption_numbers", r"""SELECT doc_id, lower(regexp_extract(line, '(?i)(?:table|tab\.?|表)\s*([a-z]?\d+(?:[.-]\d+)*)', 1)) AS number, regexp_matches(line, '(?i)continued|cont\.|续表|接上表|续') AS continued FROM
 (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Table ' || doc_id || '.1 x' WHEN 1 THEN 'Tab. A' || doc_id || ' (continued)' WHEN 2 THEN '续表 ' || doc_id ELSE lang END AS line FROM documents)""")
def caption_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 4
    line = F.when(k == 0, F.concat(F.lit("Table "), d, F.lit(".1 x"))).when(k == 1, F.concat(F.lit("Tab. A"), d, F.lit(" (continued)"))).when(k == 2, F.concat(F.lit("续表 "), d)).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", caption_number(line).alias("number"), is_continued(line).alias("continued"))


@query("content_hash", r"SELECT doc_id, sha256(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))) AS h FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("h"))


@query("squashed_text", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_sha256 FROM pages")
def squashed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(squash(F.regexp_replace("html", r"<[^>]+>", " ")), 256).alias("text_sha256"))


@query("locate_evidence", """WITH e AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN nullif(substr(text, 101, 180), '') WHEN 1 THEN nullif(substr(text, 101, 110), '') || '#~#' ELSE nullif(substr(text, 101, 70), '') || '#~#' END AS e FROM documents),
p AS (SELECT doc_id, instr(text, substr(e, 1, 180)) AS p180, instr(text, substr(e, 1, 110)) AS p110, instr(text, substr(e, 1, 70)) AS p70 FROM e)
SELECT doc_id, CASE WHEN p180 > 0 THEN 180 WHEN p110 > 0 THEN 110 WHEN p70 > 0 THEN 70 END AS width, CASE WHEN p180 > 0 THEN p180 WHEN p110 > 0 THEN p110 WHEN p70 > 0 THEN p70 END AS at FROM p""")
def locate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a piece of evidence begins in its page, by windows of 180, 110 and 70 characters; it differs from its page after 110 or 70 in two of three. Null where there is none or no window is found."""
    k = F.col("doc_id") % 3
    own = lambda w: F.nullif(F.substring("text", 101, w), F.lit(""))
    e = F.when(k == 0, own(180)).when(k == 1, F.concat(own(110), F.lit("#~#"))).otherwise(F.concat(own(70), F.lit("#~#")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", e.alias("e"))
    return rows.select("doc_id", L.locate(F.col("e"), F.col("text")).alias("f")).select("doc_id", "f.width", "f.at")


@query("parsed_blocks", f"""WITH {LINES}, k AS (SELECT doc_id, pos, line, pos // 5 + 1 AS page, CASE WHEN contains(lower(raw), 'table') THEN CASE WHEN contains(lower(raw), 'caption') THEN 'table_caption' ELSE 'table' END WHEN contains(lower(raw), 'image') THEN 'figure'
 WHEN contains(lower(raw), 'equation') THEN 'equation' WHEN contains(lower(raw), 'title') THEN 'heading' WHEN contains(lower(raw), 'list') THEN 'list_item' ELSE 'paragraph' END AS kind FROM l),
u AS (SELECT doc_id, page, 0 AS last, printf('%09d', pos) AS key, kind FROM k WHERE kind <> 'table' AND (trim(line) <> '' OR kind = 'figure') UNION ALL SELECT doc_id, page, 1, 't' || page, 'table' FROM (SELECT DISTINCT doc_id, page FROM k WHERE kind = 'table'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, last, key) AS ord, kind, page FROM u""")
def parsed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as items; the tables of a page become one."""
    items = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("ord"), F.col("raw").alias("type"), F.col("line").alias("text"), (F.floor(F.col("pos") / 5) + 1).alias("page"))
    merged = items.where(L.parsed_kind(F.col("type")) == "table").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    tables = merged.select("doc_id", F.concat(F.lit("t"), F.col("page").cast("string")).alias("table_id"), F.col("page").alias("page_start"), F.lit("x").alias("text"))
    return L.parsed_blocks(items, tables, doc="doc_id").drop("text")


@query("table_detect", """SELECT p_partkey, p_partkey % 4 <> 3 AS is_table, CASE p_partkey % 4 WHEN 2 THEN p_name ELSE p_type END AS text FROM part""")
def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    none = F.lit(None).cast("string")
    kind, caption, body = F.when(k == 0, "Simple_Table").otherwise("text"), F.when(k == 1, F.col("p_name")), F.when(k == 2, F.col("p_name")).otherwise("  ")
    found = L.is_table(kind, caption, F.col("p_type"), [body, none])
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("is_table"), L.first_text(body, none, F.col("p_type")).alias("text"))
