"""Questions to answers, for a whole batch of questions in one plan; services are injected functions.

The driver only puts the plan together: recall by keywords and vectors, fusion, union over a question's queries,
reranking, compression, review of the evidence, generation, review of the answer, citations."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS, Settings
from ..functions.text import canonical_query, once, sentences, tokens
from ..functions.vector import cosine, dot, top_k
from ..operators import citations as C
from ..operators import compress
from ..operators import retrieval as R
from ..operators import review as V

#: Fixed value: the reply without evidence.
INSUFFICIENT = "已检索历史文档，暂未找到相关内容，无法回答"
DIMENSIONS = 64


def hashing_embedding(text: Column) -> Column:
    """A stand-in for an embedding service: the counts of the tokens' hashes, of unit length; zeros without tokens."""
    numbers = F.transform(F.coalesce(tokens(text), F.array().cast("array<string>")), lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int") % DIMENSIONS).cast("double"))
    marks = F.array(*[F.lit(k + 0.5) for k in range(DIMENSIONS)])
    # between two marks of the sorted numbers lie those of one dimension
    ends = lambda sorted_: F.transform(marks, lambda m: F.array_position(sorted_, m))
    counts = lambda at: F.transform(at, lambda p, i: (p - F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1)) - 1).cast("double"))
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    unit = lambda v: once(norm(v), lambda n: F.transform(v, lambda x: x / n))
    return once(once(once(F.array_sort(F.concat(numbers, marks)), ends), counts), unit)


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], *, text: str, out: str = "embedding", batch: int = DEFAULTS.embedding_batch) -> DataFrame:
    """rows with vectors of an injected model, called with `batch` texts; a wrong number of vectors is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pd.Series) -> pd.Series:
        found: list[list[float]] = []
        for k in range(0, len(texts), batch):
            part = texts.iloc[k : k + batch].fillna("").tolist()
            got = model(part)
            if len(got) != len(part):
                raise ValueError("the model gave another number of vectors than texts")
            found += got
        return pd.Series(found, index=texts.index)

    return rows.withColumn(out, vectors(text))


@dataclass
class Services:
    """What a run asks, each optional; a service that fails leaves what it should have bettered as it is.

    plan: question -> further queries. review_evidence: (question, shown documents, 1 or 2 for the second opinion) -> a
    reply in JSON. write: (question, texts) -> draft. review_answer: (question, shown documents, draft, 1 or 2) -> a
    reply in JSON. baseline: (question, texts) -> answer, where the writer fails. Without a writer sentences are quoted,
    without reviewers everything is kept."""

    plan: Callable[[str], Sequence[str]] | None = None
    review_evidence: Callable[[str, list[str], int], str] | None = None
    write: Callable[[str, list[str]], str] | None = None
    review_answer: Callable[[str, list[str], str, int], str] | None = None
    baseline: Callable[[str, list[str]], str] | None = None
    settings: Settings = field(default_factory=lambda: DEFAULTS)


def _planned(plan: Callable[[str], Sequence[str]]) -> Callable[[Column], Column]:
    """The planner as an Arrow function, null where it fails. Not deterministic, so that a question is planned once."""

    def run(questions: pd.Series) -> pd.Series:
        def one(question: str) -> list[str] | None:
            try:
                return [str(x) for x in plan(question)]
            except Exception:  # noqa: BLE001 - without a plan the question alone is asked
                return None

        return questions.map(one)

    return F.pandas_udf(run, T.ArrayType(T.StringType())).asNondeterministic()


def queries_of(questions: DataFrame, services: Services) -> DataFrame:
    """question_id, qpos, query: the question itself first, then what the planner adds, without doubles, up to the
    limit; and whether planning failed. Equal questions are planned once."""
    anchored = questions.select("question_id", canonical_query(F.col("question")).alias("q"))
    if services.plan is None or services.settings.max_subqueries == 1:
        return anchored.select("question_id", F.lit(0).alias("qpos"), F.col("q").alias("query"), F.lit(False).alias("plan_failed"))
    planned = anchored.groupBy(F.lower("q").alias("_key")).agg(F.min("q").alias("_q")).select("_key", _planned(services.plan)(F.col("_q")).alias("more"))
    met = anchored.join(planned, F.lower("q") == F.col("_key"))
    listed = F.concat(F.array("q"), F.coalesce("more", F.array().cast("array<string>")))
    every = met.select("question_id", F.col("more").isNull().alias("plan_failed"), F.posexplode(listed).alias("qpos", "raw"))
    shaped = every.select("question_id", "plan_failed", "qpos", canonical_query(F.col("raw")).alias("query")).where("query <> ''")
    first = R.first_of_each(shaped.withColumn("key", F.lower("query")), within=["question_id"], key=["key"], order=[F.col("qpos")])
    return first.where(F.col("rank") <= services.settings.max_subqueries).select("question_id", (F.col("rank") - 1).alias("qpos"), "query", "plan_failed")


def recall(queries: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """question_id, chunk_id, rank: both recalls for each query, fused, then united over a question's queries.

    chunks: chunk_id (long), text, embedding."""
    asked = queries.withColumn("query_id", F.xxhash64("question_id", "qpos"))
    words = R.bm25(asked, chunks, settings.recall_k, question_id="query_id", question="query", doc_id="chunk_id", text="text", settings=settings)
    near = top_k(asked.withColumn("embedding", hashing_embedding(F.col("query"))), chunks, settings.recall_k, query_id="query_id", vector_id="chunk_id", metric="l2")
    fused = R.fuse([words.select(F.col("question_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), "rank"), near.select("query_id", F.col("vector_id").alias("chunk_id"), "rank")], key="chunk_id", query="query_id", constant=settings.rrf_constant)
    named = fused.join(asked.select("query_id", "question_id", "qpos"), "query_id")
    return R.first_of_each(named.select("question_id", "chunk_id", "qpos", "rank"), within=["question_id"], key=["chunk_id"], order=[F.col("qpos"), F.col("rank")]).select("question_id", "chunk_id", "rank")


def context(questions: DataFrame, chunks: DataFrame, services: Services, queries: DataFrame | None = None) -> DataFrame:
    """question_id, rank, chunk_id, text, and the chunks' further columns: reranked, compressed, within the budget."""
    settings = services.settings
    found = recall(queries_of(questions, services) if queries is None else queries, chunks, settings)
    asked = questions.select("question_id", hashing_embedding(F.col("question")).alias("asked"))
    pairs = R.with_rows(found.withColumnRenamed("rank", "recalled"), chunks, key="chunk_id", settings=settings).join(asked, "question_id")
    best = R.rerank(pairs, F.round(cosine(F.col("asked"), F.col("embedding")), 6), query="question_id", tie=[F.col("chunk_id")], top_n=settings.rerank_top_n)
    like = lambda s: dot(hashing_embedding(s), F.col("asked"))  # both of unit length
    return compress.compress(best.drop("recalled"), like, group="question_id", order="rank", key="chunk_id", text="text", embedding="embedding", settings=settings)


def quote(question: str, text: str) -> str:
    """A stand-in for a writer: the sentence that shares most words with the question, the first of equals."""
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    parts = [p.strip() for p in re.split(r"(?<=[.!?。！？])\s+|\n+", text) if p.strip()]
    return max(parts, key=lambda p: len(words(p) & words(question)), default="")


def cited_evidence(rows: DataFrame) -> DataFrame:
    """question_id, evidence: what is left for a question, numbered, with labels, keys, references and links."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    title = C.title_of(F.col("paper_title"), F.col("filename"))
    at = {"page": F.col("page"), "page_end": F.col("page_end"), "section": F.col("section"), "paragraph": F.col("paragraph_index")}
    label = C.label(library_index=F.col("library_index"), doc_id=F.col("doc_id"), position=F.col("n"), title=F.col("paper_title"), filename=F.col("filename"), **at)
    named = C.paper_reference(library_index=F.col("library_index"), doc_id=F.col("doc_id"), position=F.col("n"), title=F.col("paper_title"), filename=F.col("filename"))
    href = F.concat(F.lit("?open_citation="), C.encode_target(F.lit(1), F.col("doc_id"), F.col("page"), F.col("paragraph_index")))
    one = F.struct("n", "text", label.alias("label"), F.concat(F.lit("doc_id:"), F.col("doc_id").cast("string")).alias("key"), named.alias("reference"), C.location(title=title, **at).alias("location"), href.alias("href"))
    return rows.withColumn("n", place).groupBy("question_id").agg(F.array_sort(F.collect_list(one)).alias("evidence"))  # at most rerank_top_n


def answer(questions: DataFrame, chunks: DataFrame, services: Services | None = None) -> DataFrame:
    """question_id, answer, refused, degraded, rejection_stage, warnings, queries, n_evidence: cited answers, or a refusal
    where no evidence is left. A refusal carries no evidence and is no degradation; a review or writer that fails is.

    questions: question_id, question. chunks: chunk_id, text, embedding, doc_id, library_index, paper_title, filename,
    page, page_end, section, paragraph_index."""
    services = services or Services()
    queries = queries_of(questions, services)
    asked = queries.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("qpos", "query"))), lambda x: x["query"]).alias("queries"), F.max("plan_failed").alias("plan_failed"))
    rows = questions.select("question_id", "question").join(asked, "question_id").join(cited_evidence(context(questions, chunks, services, queries)), "question_id", "left")

    def run(questions_: pd.Series, evidence_: pd.Series, plan_failed: pd.Series) -> pd.DataFrame:
        out = [_run(services, q, [dict(e) for e in (es if es is not None else [])], bool(failed)) for q, es, failed in zip(questions_, evidence_, plan_failed, strict=True)]
        return pd.DataFrame(out, columns=RESULT.names)

    done = rows.withColumn("r", F.pandas_udf(run, RESULT)("question", "evidence", "plan_failed"))
    return done.select("question_id", "r.answer", "r.refused", (F.size("r.warnings") > 0).alias("degraded"), "r.rejection_stage", "r.warnings", "queries", "r.n_evidence")


RESULT = T.StructType([T.StructField("answer", T.StringType()), T.StructField("refused", T.BooleanType()), T.StructField("rejection_stage", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("n_evidence", T.IntegerType())])


def _run(services: Services, question: str, evidence: list[dict], plan_failed: bool) -> tuple:
    """RESULT of one question: its evidence is reviewed, an answer written, and that reviewed."""
    warnings, stage, text = ["planning failed"] * plan_failed, None, None

    def shown() -> list[str]:
        return [f"[{k}] {e['label']}\n{e['text'][: V.SHOWN_CHARS]}" for k, e in enumerate(evidence[: V.SHOWN], 1)]

    def note(what: str, state: str) -> None:
        warnings.extend([f"{what} review failed"] * (state == "failed") + [f"{what} confirmed by a second opinion"] * (state == "confirmed"))

    if evidence and services.review_evidence is not None:
        state, keep = V.second_opinion(lambda n: services.review_evidence(question, shown(), n), lambda reply: V.judge_evidence(reply, len(shown())))
        note("evidence", state)
        stage = "evidence_review" if state == "refused" else None
        evidence = [] if stage else evidence if keep is None else [evidence[k - 1] for k in keep]
    if evidence:
        texts = [e["text"] for e in evidence]
        try:
            text = services.write(question, texts) if services.write is not None else " ".join(f"{quote(question, t)} [{k}]" for k, t in enumerate(texts, 1))
        except Exception:  # noqa: BLE001 - the baseline answers instead
            warnings.append("writer failed")
            text = services.baseline(question, texts) if services.baseline is not None else None
    if text and services.review_answer is not None:
        draft = text
        state, mended = V.second_opinion(lambda n: services.review_answer(question, shown(), draft, n), V.judge_answer)
        note("answer", state)
        stage = "answer_review" if state == "refused" else None
        text = None if stage else draft if mended is None else mended
    refused = not text or text == INSUFFICIENT
    return (INSUFFICIENT if refused else C.render(text, evidence)), refused, stage, warnings, 0 if refused else len(evidence)


def summary(chunks: DataFrame, *, doc: str, most_chunks: int = 5, most_chars: int = 6000) -> DataFrame:
    """doc, text: what a summary is made of, the first chunks of a document up to so many characters."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"])
    first = chunks.where(F.col("chunk_index") < most_chunks).groupBy(doc).agg(F.array_join(listed, "\n\n").alias("text"))
    return first.withColumn("text", F.substring("text", 1, most_chars))


def quoted(text: Column, n: int = 3) -> Column:
    """A stand-in for a summary: the first sentences."""
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def rewritten(questions: DataFrame, rewrite: Callable[[str], str] | None, *, most: int = 240, fallback: int = 500) -> DataFrame:
    """questions with search_query: the rewriter's words up to `most` characters, else the question up to `fallback`."""
    plain = F.substring(canonical_query(F.col("question")), 1, fallback)
    if rewrite is None:
        return questions.withColumn("search_query", plain)

    @F.pandas_udf(T.StringType())
    def ask(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return " ".join(rewrite(text).split())[:most] or None
            except Exception:  # noqa: BLE001 - the question itself is searched instead
                return None

        return texts.map(one)

    return questions.withColumn("search_query", F.coalesce(ask("question"), plain))


def translation_context(texts: DataFrame, chunks: DataFrame, *, key: str, text: str, most_chars: int = 600, hits: int = 4, settings: Settings = DEFAULTS) -> DataFrame:
    """key, context: for each text the best chunks for its first characters, as terms for its translator."""
    asked = texts.select(F.col(key).alias("question_id"), F.lit(0).alias("qpos"), F.substring(text, 1, most_chars).alias("query"))
    best = recall(asked, chunks, settings).where(F.col("rank") <= hits).join(chunks.select("chunk_id", "text"), "chunk_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"])
    return best.groupBy(F.col("question_id").alias(key)).agg(F.array_join(listed, "\n\n").alias("context"))
