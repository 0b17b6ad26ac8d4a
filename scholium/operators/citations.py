"""Citations: labels, numbers, targets, look-ups, reference lists, rendering."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ESCAPED, escape_markdown, squash

#: The forms of targets, links and the references below an answer.
TARGET = r"^g(\d+)-d(\d+)-p(\d+)-r(\d+)$"
LINK = r'\[\[(\d+)\]\]\((?:\?open_citation=[^)\s"]+|https?://[^)\s"]+|#参考来源)(?:\s+"(?:\\.|[^"\\])*")?\)'
FULL_LABEL = r"\[文献(\d+)《([^\]\r\n]+?)》，([^\]\r\n]+)\]"
LEGACY_LINK = r"(?i)(?<!\[)\[(\d+)\](?=\((?:\?open_citation=|https?://[^)\s]*[?&]open_citation=))"
FRAGMENT = r"(?i)\[\s*片段\s*(\d+)(?:\s*\|[^\]\r\n]*)?\s*\]"
BARE = r"(?<!\[)\[(\d+)\](?!\]|\()"
REFERENCES = r"\n{2,}---\s*\n{2,}### 参考来源\s*(?:\n|$)"
#: The comment that older answers carry before the heading, whatever its first word.
COMMENT = r"<!-- \w+-reference-list -->\n?"


def positive(value: Column) -> Column:
    """An integer above 0, or null."""
    number = value.try_cast("long")
    return F.when(number > 0, number)


def title_of(title: Column, filename: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce(F.nullif(filename, F.lit("")), F.lit("未知论文")), "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.translate(squash(F.coalesce(F.nullif(title, F.lit("")), stem)), "[]", "（）")


def pages_text(page: Column, page_end: Column) -> Column:
    a, b = positive(page), positive(page_end)
    return F.when(a.isNull(), F.lit("页码未知")).when(b > a, F.concat(F.lit("第"), a.cast("string"), F.lit("–"), b.cast("string"), F.lit("页"))).otherwise(F.concat(F.lit("第"), a.cast("string"), F.lit("页")))


def location(*, page: Column, page_end: Column, section: Column, paragraph: Column, title: Column) -> Column:
    plain = F.trim(F.coalesce(section, F.lit("")))
    named = F.when((plain != "") & (plain != "正文") & (F.lower(plain) != F.lower(title)), F.concat(F.lit("§"), squash(plain)))
    number = positive(paragraph)
    return F.concat_ws("，", pages_text(page, page_end), named, F.concat(F.lit("段落"), number.cast("string")))


def paper_number(*, library_index: Column, doc_id: Column, position: Column) -> Column:
    """A paper's place in its library, else its id, else its place in the evidence."""
    return F.coalesce(positive(library_index).cast("string"), F.concat(F.lit("ID"), positive(doc_id).cast("string")), F.concat(F.lit("?"), F.greatest(F.lit(1), position).cast("string")))


def label(*, library_index: Column, doc_id: Column, position: Column, title: Column, filename: Column, page: Column, page_end: Column, section: Column, paragraph: Column) -> Column:
    name = title_of(title, filename)
    number = paper_number(library_index=library_index, doc_id=doc_id, position=position)
    return F.concat(F.lit("[文献"), number, F.lit("《"), name, F.lit("》，"), location(page=page, page_end=page_end, section=section, paragraph=paragraph, title=name), F.lit("]"))


def external_label(*, position: Column, title: Column, year: Column, provider: Column, level: Column) -> Column:
    kind = F.lower(F.trim(F.coalesce(F.nullif(level, F.lit("")), F.lit("abstract"))))
    name = F.when(kind == "abstract", "摘要").when(kind == "search_snippet", "检索片段").when(kind == "full_text", "开放全文").otherwise("外部检索内容")
    when = F.coalesce(positive(year).cast("string"), F.lit("年份未知"))
    source = squash(F.coalesce(F.nullif(provider, F.lit("")), F.lit("开放学术索引")))
    return F.concat(F.lit("[GS文献"), F.greatest(F.lit(1), position).cast("string"), F.lit("《"), title_of(title, F.lit(None).cast("string")), F.lit("》，"), F.concat_ws("，", when, source, name), F.lit("]"))


def paper_key(*, origin: Column, doi: Column, evidence_id: Column, title: Column, doc_id: Column, group_id: Column, library_index: Column, filename: Column, position: Column) -> Column:
    low = lambda c: F.nullif(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    return (
        F.when(F.lower(F.coalesce(origin, F.lit(""))) == "academic_search", F.concat(F.lit("academic:"), F.coalesce(low(doi), low(evidence_id), F.lower(title_of(title, filename)))))
        .when(positive(doc_id).isNotNull(), F.concat(F.lit("doc_id:"), positive(doc_id).cast("string")))
        .when(positive(library_index).isNotNull(), F.concat_ws(":", F.lit("library"), F.coalesce(positive(group_id), F.lit(0)).cast("string"), positive(library_index).cast("string")))
        .otherwise(F.concat(F.lit("source:"), F.coalesce(low(filename), F.concat(F.lit("position:"), position.cast("string")))))
    )


def external_reference(*, title: Column, authors: Column, venue: Column, doi: Column) -> Column:
    names = F.filter(F.transform(F.split(F.coalesce(authors, F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    people = F.when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, 3), "、"), F.when(F.size(names) > 3, F.lit(" 等")).otherwise(F.lit(""))))
    place, number = F.nullif(squash(F.coalesce(venue, F.lit(""))), F.lit("")), F.nullif(squash(F.coalesce(doi, F.lit(""))), F.lit(""))
    return F.concat_ws("｜", F.concat(F.lit("外部论文《"), title_of(title, F.lit(None).cast("string")), F.lit("》")), people, place, F.concat(F.lit("DOI: "), number))


def encode_target(group_id: Column, doc_id: Column, page: Column, paragraph: Column) -> Column:
    at_least_0 = lambda c: F.greatest(F.lit(0), F.coalesce(c.cast("long"), F.lit(0))).cast("string")
    return F.concat(F.lit("g"), at_least_0(group_id), F.lit("-d"), at_least_0(doc_id), F.lit("-p"), at_least_0(page), F.lit("-r"), at_least_0(paragraph))


def decode_target(token: Column) -> Column:
    """struct of group_id, doc_id, page, paragraph; null for what is no target."""
    parts = [F.regexp_extract(F.trim(token), TARGET, k).try_cast("long") for k in (1, 2, 3, 4)]
    value = F.struct(*[p.alias(n) for p, n in zip(parts, ("group_id", "doc_id", "page", "paragraph"), strict=True)])
    return F.when((parts[0] > 0) & (parts[1] > 0), value)


def enrich(chunks: DataFrame, papers: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """chunks with the current fields of their papers, where those are not null."""
    own = papers.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    met = chunks.join(own, F.col(key) == F.col("_k"), "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in chunks.columns])


def number_papers(evidence: DataFrame, *, answer: str, position: str, key: str) -> DataFrame:
    """evidence of known papers with paper_no, counted by first appearance in each answer. What is partitioned by answer is not shuffled;
    an answer's evidence is short."""
    first = evidence.where(F.col(answer).isNotNull() & F.col(key).isNotNull()).withColumn("_first", F.min(position).over(Window.partitionBy(answer, key)))
    return first.withColumn("paper_no", F.dense_rank().over(Window.partitionBy(answer).orderBy("_first", key))).drop("_first")


def paper_reference(*, library_index: Column, doc_id: Column, position: Column, title: Column, filename: Column) -> Column:
    """How the list of references names a paper of a library."""
    return F.concat(F.lit("文献"), paper_number(library_index=library_index, doc_id=doc_id, position=position), F.lit("《"), title_of(title, filename), F.lit("》"))


def link(number: Column, href: Column, label: Column) -> Column:
    """A number in visible brackets that leads to its evidence and shows its label."""
    shown = F.replace(F.replace(F.regexp_replace(label, r"(?U)\s+", " "), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit("[["), number.cast("string"), F.lit("]]("), href, F.lit(' "'), shown, F.lit('")'))


def reference_list(numbered: DataFrame, *, answer: str, position: str, label: str, href: str, reference: str, location: str) -> DataFrame:
    """answer, paper_no, reference: each paper once, with a link to its first place and all its different places in order
    of appearance."""
    each = numbered.groupBy(answer, "paper_no", location).agg(F.min(position).alias("_at"), F.min(F.struct(position, label, href, reference)).alias("_one"))
    places = F.transform(F.array_sort(F.collect_list(F.struct("_at", location))), lambda x: escape_markdown(x[location]))
    out = each.groupBy(answer, "paper_no").agg(F.min_by("_one", F.struct("_at", location)).alias("_one"), places.alias("_where"))
    one = lambda c: F.col("_one")[c]
    then = F.when(F.size("_where") == 1, "，").otherwise("：")
    line = F.concat(F.lit("- "), link(F.col("paper_no"), one(href), one(label)), F.lit(" "), escape_markdown(one(reference)), then, F.array_join("_where", "；"))
    return out.select(answer, "paper_no", line.alias("reference"))


def look_up(targets: DataFrame, chunks: DataFrame, *, target: str) -> DataFrame:
    """target, chunk_index: the exact paragraph, else the first chunk of the page, else of the paper.

    targets: target, doc_id, page, paragraph; chunks: doc_id, page, paragraph, chunk_index."""
    c = chunks.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("paragraph").alias("_r"), "chunk_index")
    met = targets.join(c, F.col("doc_id") == F.col("_d"))
    priority = F.when((F.col("paragraph") > 0) & (F.col("paragraph") == F.col("_r")), 0).when((F.col("page") > 0) & (F.col("page") == F.col("_p")), 1).otherwise(2)
    return met.groupBy(target).agg(F.min(F.struct(priority.alias("priority"), F.col("chunk_index").alias("chunk_index"))).alias("m")).select(target, "m.priority", "m.chunk_index")


def visible_brackets(text: Column) -> Column:
    """Links of the older form [2](…) as [[2]](…), where a number in brackets is what is seen."""
    return F.regexp_replace(text, LEGACY_LINK, "[[$1]]")


def without_comment(text: Column) -> Column:
    """Without the comment that marked the list of references."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT, "")


def has_references(text: Column) -> Column:
    return text.rlike(REFERENCES)


def strip_rendering(answer: Column) -> Column:
    """The text with plain numbers for links, without the references."""
    body = F.regexp_replace(without_comment(visible_brackets(answer)), f"(?s){REFERENCES}.*", "")
    return F.regexp_replace(F.regexp_replace(body, r"(?U)\s+$", ""), f"(?i){LINK}", "[$1]")


def expand_fragments(text: Column, labels: Column) -> Column:
    """The text with the label of that place (from 1) for each fragment's mark; marks of other places stay."""
    marks = F.regexp_extract_all(text, F.lit(FRAGMENT), F.lit(0))
    label = lambda m: F.coalesce(F.get(labels, F.regexp_extract(m, r"(\d+)", 1).cast("int") - 1), m)
    pieces = F.zip_with(F.split(text, FRAGMENT), F.transform(marks, label), lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.when(F.size(marks) > 0, F.array_join(pieces, "")).otherwise(text)


def stored_labels(answers: DataFrame, papers: DataFrame, *, answer: str, text: str) -> DataFrame:
    """answer, pos, label, library_index, title, paper, page, page_end, section, paragraph, valid: the different labels in
    saved answers, in order. A label is valid if what is read from it makes the same label again; its paper may be gone
    (paper is null then). papers: library_index, doc_id."""
    found = answers.select(answer, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({FULL_LABEL})"), F.lit(1))).alias("pos", "label"))
    once = found.groupBy(answer, "label").agg(F.min("pos").alias("pos"))
    part = lambda pattern, k: F.nullif(F.regexp_extract(F.regexp_extract("label", FULL_LABEL, 3), pattern, k), F.lit(""))
    read = once.select(
        answer, "pos", "label", F.regexp_extract("label", FULL_LABEL, 1).cast("int").alias("library_index"), F.regexp_extract("label", FULL_LABEL, 2).alias("title"), part(r"第(\d+)(?:–(\d+))?页", 1).cast("int").alias("page"),
        part(r"第(\d+)(?:–(\d+))?页", 2).cast("int").alias("page_end"), F.coalesce(part(r"(?:^|，)§([^，]+)", 1), F.lit("正文")).alias("section"), part(r"段落(\d+)", 1).cast("int").alias("paragraph"),
    )
    own = papers.select(F.col("library_index").alias("_i"), F.col("doc_id").cast("long").alias("paper")).groupBy("_i").agg(F.max("paper").alias("paper"))
    met = read.join(own, F.col("library_index") == F.col("_i"), "left").drop("_i")
    again = label(library_index=F.col("library_index"), doc_id=F.col("paper"), position=F.lit(1), title=F.col("title"), filename=F.lit(""), page=F.col("page"), page_end=F.col("page_end"), section=F.col("section"), paragraph=F.col("paragraph"))
    return met.withColumn("valid", again == F.col("label"))


def finalize_saved(answers: DataFrame, papers: DataFrame, *, answer: str, text: str, group: int) -> DataFrame:
    """answer, text: saved answers with links for their valid labels and the references below; those that have references
    already, or no valid label, only get visible brackets and lose the older comment."""
    body = answers.select(answer, without_comment(visible_brackets(F.col(text))).alias("_body"))
    labels = stored_labels(body.where(~has_references(F.col("_body"))), papers, answer=answer, text="_body").where("valid")
    title, where = title_of(F.col("title"), F.lit("")), {"page": F.col("page"), "page_end": F.col("page_end"), "section": F.col("section"), "paragraph": F.col("paragraph")}
    href = F.when(F.col("paper").isNotNull(), F.concat(F.lit("?open_citation="), encode_target(F.lit(group), F.col("paper"), F.col("page"), F.col("paragraph")))).otherwise("#参考来源")
    key = F.coalesce(F.concat(F.lit("doc_id:"), F.col("paper").cast("string")), F.concat(F.lit("library:"), F.col("library_index").cast("string")))
    named = paper_reference(library_index=F.col("library_index"), doc_id=F.col("paper"), position=F.lit(1), title=F.col("title"), filename=F.lit(""))
    one = F.struct("pos", "label", key.alias("key"), named.alias("reference"), location(**where, title=title).alias("location"), href.alias("href"))
    listed = labels.groupBy(answer).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("pos")).alias("_es"))
    met = body.join(listed, answer, "left")
    return met.select(answer, F.when(F.col("_es").isNull(), F.col("_body")).otherwise(render_answers("_body", "_es")).alias("text"))


def _linked(number: int, e: dict) -> str:
    title = re.sub(r"\s+", " ", e["label"]).replace("\\", "\\\\").replace('"', '\\"')
    return f'[[{number}]]({e["href"]} "{title}")'


def render(text: str, evidence: list[dict]) -> str:
    """text with its labels, marks of fragments and bare numbers as links, numbered by paper in the order of their first
    use, and the references below: each paper's line links to its first place and names all. Evidence that no label
    uses is left out of the references, but all is listed where none is used. A text that has references stays.

    evidence: label, key, reference, location, href in the order of their positions. Rendering twice changes nothing."""
    label_at = lambda m: evidence[k - 1]["label"] if 1 <= (k := int(m[1])) <= len(evidence) else m[0]
    body = re.sub(FRAGMENT, label_at, text)
    body = re.sub(COMMENT, "", re.sub(LEGACY_LINK, r"[[\1]]", body)).strip()
    if not body or not evidence or re.search(REFERENCES, body):
        return body
    body = re.sub(BARE, label_at, body)
    known = {e["label"]: e for e in reversed(evidence)}  # of equal labels the first
    papers: dict[str, dict[str, dict]] = {}  # the evidence used, by paper and label, in the order of use
    numbers: dict[str, int] = {}

    def use(e: dict) -> str:
        papers.setdefault(e["key"], {}).setdefault(e["label"], e)
        return _linked(numbers.setdefault(e["key"], len(numbers) + 1), e)

    body = re.sub("|".join(re.escape(x) for x in sorted(known, key=len, reverse=True)), lambda m: use(known[m[0]]), body)
    if not papers:
        for e in evidence:
            use(e)
    escaped = lambda x: re.sub(ESCAPED, r"\\\1", x)
    lines = []
    for key, used in papers.items():
        first, *_ = used.values()
        places = [escaped(p) for p in dict.fromkeys(e["location"] for e in used.values())]
        lines.append(f"- {_linked(numbers[key], first)} {escaped(first['reference'])}{'，' if len(places) == 1 else '：'}{'；'.join(places)}")
    return f"{body}\n\n---\n\n### 参考来源\n\n" + "\n".join(lines)


@F.pandas_udf(T.StringType())
def render_answers(texts: pd.Series, evidence: pd.Series) -> pd.Series:
    """render on columns; evidence: array<struct<label, key, reference, location, href>>."""
    return pd.Series([render(t or "", [dict(e) if isinstance(e, dict) else e.asDict() for e in (es if es is not None else [])]) for t, es in zip(texts, evidence, strict=True)])
