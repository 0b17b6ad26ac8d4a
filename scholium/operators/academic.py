"""Records of external indexes: adapters, projection, safety of links, union without doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_markup, shortened

S2 = "struct<data:array<struct<paperId:string,title:string,abstract:string,year:int,authors:array<struct<name:string>>,venue:string,url:string,externalIds:struct<DOI:string>,citationCount:int,publicationDate:string,openAccessPdf:struct<url:string>>>>"
OPENALEX = "struct<results:array<struct<id:string,display_name:string,title:string,doi:string,publication_date:string,publication_year:int,is_retracted:boolean,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>,landing_page_url:string,pdf_url:string>,cited_by_count:int>>>"
DATE_PARTS = "struct<`date-parts`:array<array<int>>>"
CROSSREF = f"struct<message:struct<items:array<struct<DOI:string,title:array<string>,abstract:string,author:array<struct<given:string,family:string>>,`published-print`:{DATE_PARTS},`published-online`:{DATE_PARTS},published:{DATE_PARTS},issued:{DATE_PARTS},`container-title`:array<string>,URL:string,`is-referenced-by-count`:int>>>>"

RAW = ["provider", "external_id", "title", "abstract", "authors", "publication_year", "venue", "doi", "url", "citation_count"]


def safe_url(url: Column) -> Column:
    """An http(s) link with a host and without credentials, else ''."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    return F.when(raw.rlike(r"(?i)^https?://[^/?#@\s]+(?:[/?#].*)?$"), raw).otherwise("")


def normal_doi(doi: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(doi, F.lit(""))), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(F.contains(bare, F.lit(" ")), F.lit("")).otherwise(bare)


def attributed(url: Column) -> Column:
    """Links to the index that asks for it name their source."""
    safe = safe_url(url)
    asked = F.lower(safe).rlike(r"^https?://[^/?#]*semanticscholar\.org") & ~F.contains(safe, F.lit("utm_source="))
    return F.when(asked, F.concat(safe, F.when(F.contains(safe, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_source=api"))).otherwise(safe)


def cleaned(text: Column, most: int) -> Column:
    """Character references resolved, tags as spaces, white space squashed, cut to `most` characters."""
    return shortened(clean_markup(text), most)


def rebuild_abstract(index: Column) -> Column:
    """Words by their positions 0 to 99,999; words at one position in the order of the index."""
    placed = lambda e, i: F.transform(F.filter(e["value"], lambda p: p.between(0, 99_999)), lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))
    pairs = F.flatten(F.transform(F.map_entries(index), placed))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def semantic_scholar(replies: DataFrame, *, body: str) -> DataFrame:
    rows = replies.select(F.explode(F.from_json(body, S2)["data"]).alias("d")).select("d.*")
    link = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.nullif("paperId", F.lit(""))))
    return rows.select(F.lit("semantic_scholar").alias("provider"), F.col("paperId").alias("external_id"), "title", "abstract", F.transform("authors", lambda a: a["name"]).alias("authors"), F.col("year").alias("publication_year"), "venue", F.col("externalIds.DOI").alias("doi"), attributed(link).alias("url"), F.col("citationCount").alias("citation_count"))


def openalex(replies: DataFrame, *, body: str) -> DataFrame:
    rows = replies.select(F.explode(F.from_json(body, OPENALEX)["results"]).alias("d")).select("d.*").where(~F.coalesce("is_retracted", F.lit(False)))
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return rows.select(
        F.lit("openalex").alias("provider"), F.col("id").alias("external_id"), first("display_name", "title").alias("title"), rebuild_abstract(F.col("abstract_inverted_index")).alias("abstract"), F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        "publication_year", F.col("primary_location.source.display_name").alias("venue"), "doi", first("primary_location.landing_page_url", "doi", "id").alias("url"), F.col("cited_by_count").alias("citation_count"),
        F.coalesce("primary_location.pdf_url", F.lit("")).alias("open_access_pdf_url"), F.coalesce("publication_date", F.lit("")).alias("publication_date"),
    )


def crossref(replies: DataFrame, *, body: str) -> DataFrame:
    rows = replies.select(F.explode(F.from_json(body, CROSSREF)["message"]["items"]).alias("d")).select("d.*")
    year = F.coalesce(*[F.get(F.get(F.col(f"`{f}`.`date-parts`"), F.lit(0)), F.lit(0)) for f in ("published-print", "published-online", "published", "issued")])
    names = F.filter(F.transform("author", lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))), lambda n: n != "")
    return rows.select(
        F.lit("crossref").alias("provider"), F.col("DOI").alias("external_id"), F.get("title", F.lit(0)).alias("title"), "abstract", names.alias("authors"), year.alias("publication_year"), F.get("`container-title`", F.lit(0)).alias("venue"),
        F.col("DOI").alias("doi"), F.coalesce(F.nullif("URL", F.lit("")), F.concat(F.lit("https://doi.org/"), F.nullif("DOI", F.lit("")))).alias("url"), F.col("`is-referenced-by-count`").alias("citation_count"),
    )


def papers(raw: DataFrame, *, abstract_chars: int = 5000) -> DataFrame:
    """raw (columns RAW) cleaned and cut, with evidence_id and page_content; records without title or abstract go."""
    names = F.slice(F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: cleaned(a, 120)), lambda a: a != ""), 1, 20)
    rows = raw.select("provider", cleaned(F.col("external_id"), 200).alias("external_id"), cleaned(F.col("title"), 500).alias("title"), cleaned(F.col("abstract"), abstract_chars).alias("abstract"), names.alias("authors"), "publication_year", cleaned(F.col("venue"), 240).alias("venue"), normal_doi(F.col("doi")).alias("doi"), safe_url(F.col("url")).alias("url"), "citation_count")
    rows = rows.where("title <> '' AND abstract <> ''")
    own = F.coalesce(F.nullif(F.lower("doi"), F.lit("")), F.nullif("external_id", F.lit("")), F.lower("title"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("论文题名："), "title"), F.when(F.size("authors") > 0, F.concat(F.lit("作者："), F.array_join("authors", ", "))), F.concat(F.lit("年份："), F.nullif("publication_year", F.lit(0)).cast("string")),
        F.concat(F.lit("期刊/会议："), F.nullif("venue", F.lit(""))), F.concat(F.lit("摘要："), "abstract"),
    )
    return rows.withColumn("evidence_id", F.concat_ws(":", F.lit("academic"), "provider", own)).withColumn("page_content", head)


def union_distinct(lists: list[DataFrame]) -> DataFrame:
    """The first of each DOI, evidence id or title over the providers in order; lists: columns of papers and pos."""
    rows = reduce(DataFrame.unionByName, [x.withColumn("provider_ord", F.lit(i)) for i, x in enumerate(lists)])
    key = F.lower(F.coalesce(F.nullif("doi", F.lit("")), F.nullif("evidence_id", F.lit("")), F.nullif("title", F.lit(""))))
    keyed = rows.withColumn("_key", key).where(F.col("_key").isNotNull())
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("provider_ord", "pos"))).where("_n = 1").drop("_n", "_key")


def usable_evidence(rows: DataFrame, *, query: str, rank: str, top_k: int) -> DataFrame:
    """Of the first top_k of each query those of external origin and a known level, with text. The cut comes first."""
    return rows.where(F.col(rank) <= top_k).where((F.col("evidence_origin") == "academic_search") & F.col("evidence_level").isin("abstract", "search_snippet", "full_text") & (F.trim(F.coalesce("page_content", F.lit(""))) != ""))
