"""Quality of retrieval and answers. Results are vector searches; vectors of one label are one paper's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clamp01, is_refusal
from ..operators import evaluate as E
from ..operators import ordered as O
from ..operators.review import judged
from ..session import table
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


def results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(results, evidence): a vector is the page vec_id / 10 of the paper of its label; every 7th has no page."""
    rows = table(spark, sf_dir, "embeddings")
    page = F.when(F.col("vec_id") % 7 != 0, F.floor(F.col("vec_id") / 10).cast("int"))
    named = rows.select(F.col("vec_id").alias("vector_id"), F.concat(F.lit("Dir/Paper"), F.col("label").cast("string"), F.lit(".PDF")).alias("filename"), page.alias("page"), "label")
    found = vectors(spark, sf_dir, "cosine").join(named, "vector_id").select("query_id", "rank", "filename", "page")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    truth = rows.withColumn("n", place).where("n <= 4").select("label", F.concat(F.lit("paper"), F.col("label").cast("string"), F.lit(".pdf")).alias("filename"), F.floor(F.col("vec_id") / 10).cast("int").alias("page")).distinct()
    evidence = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(truth, "label").select("query_id", "filename", "page")
    return found, evidence


RESULTS = f"""WITH {VECTORS}, lab AS (SELECT vec_id, label FROM embeddings),
r AS (SELECT query_id, rank, label AS name, CASE WHEN vector_id % 7 <> 0 THEN vector_id // 10 END AS page FROM alike JOIN lab ON vector_id = vec_id),
truth AS (SELECT DISTINCT label, vec_id // 10 AS page FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 4),
e AS (SELECT vec_id AS query_id, truth.label AS name, page FROM lab JOIN truth USING (label) WHERE vec_id % 50 = 0),
m AS (SELECT r.query_id, r.rank, r.page AS rp, e.page AS ep, e.query_id IS NOT NULL AS rel FROM r LEFT JOIN e ON r.query_id = e.query_id AND r.name = e.name AND (r.page IS NULL OR abs(r.page - e.page) <= 1)),
f AS (SELECT query_id, rank, bool_or(rel) AS relevant FROM m GROUP BY ALL),
t AS (SELECT query_id, count(*) AS total FROM e GROUP BY 1),
first AS (SELECT query_id, min(rank) FILTER (relevant) AS first FROM f GROUP BY 1),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
found AS (SELECT query_id, k, count(DISTINCT ep) FILTER (rp IS NOT NULL AND ep IS NOT NULL) AS found FROM m, ks WHERE rank <= k GROUP BY ALL),
dcg AS (SELECT query_id, k, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM f, ks WHERE rank <= k GROUP BY ALL),
card AS (SELECT t.query_id, ks.k, round(coalesce(found, 0) / total, 6) AS recall, round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(total, ks.k) + 1)]), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr
 FROM t, ks LEFT JOIN found ON found.query_id = t.query_id AND found.k = ks.k LEFT JOIN dcg ON dcg.query_id = t.query_id AND dcg.k = ks.k LEFT JOIN first ON first.query_id = t.query_id)"""


@query("scorecard", RESULTS + " SELECT query_id, k::INT AS k, recall, ndcg, mrr FROM card")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scorecard(*results(spark, sf_dir), question="query_id", tolerance=1)


@query("scorecard_means", RESULTS + " SELECT k::INT AS k, round(avg(recall), 4) AS recall, round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr, count(*) AS n FROM card GROUP BY k")
def scorecard_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = E.scorecard(*results(spark, sf_dir), question="query_id", tolerance=1)
    return card.groupBy("k").agg(*[E.mean4(c).alias(c) for c in ("recall", "ndcg", "mrr")], F.count(F.lit(1)).alias("n"))


@query("latency_percentiles", """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] AS p95, v[round_even(0.99 * (len(v) - 1), 0)::INT + 1] AS p99 FROM s""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.percentiles(table(spark, sf_dir, "events"), group="event_type", value="value")


ITEMS = """i AS (SELECT e.event_id, e.event_id % 5 = 0 AS expect_refusal, (e.event_id % 5 = 0) <> (e.event_id % 11 = 0) AS refused, CASE WHEN e.event_id % 5 <> 0 THEN value / 100 END AS recall, CASE WHEN e.event_id % 3 <> 0 THEN value / 200 END AS mrr, value AS latency FROM events e)"""


@query("eval_report", f"""WITH {ITEMS} SELECT count(*) AS n, count(*) FILTER (expect_refusal) AS n_refusal, round(avg(recall) FILTER (NOT expect_refusal), 4) AS recall, round(avg(mrr) FILTER (NOT expect_refusal), 4) AS mrr,
 round(avg(refused::INT) FILTER (expect_refusal), 4) AS refusal_accuracy, round(avg(latency), 3) AS latency FROM i""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    refuse = i % 5 == 0
    items = table(spark, sf_dir, "events").select(refuse.alias("expect_refusal"), (refuse != (i % 11 == 0)).alias("refused"), F.when(~refuse, F.col("value") / 100).alias("recall"), F.when(i % 3 != 0, F.col("value") / 200).alias("mrr"), F.col("value").alias("latency"))
    return E.report(items)


@query("refusal_rate", """SELECT role, count(*) AS n, count(*) FILTER (a = '' OR regexp_matches(a, '无法回答|未找到相关|暂未找到')) AS refused FROM
 (SELECT role, CASE WHEN conv_id % 9 = 0 THEN '' WHEN conv_id % 7 = 0 THEN '抱歉，未找到相关文献。' ELSE text END AS a FROM conversations) GROUP BY role""")
def refusal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("conv_id") % 9 == 0, "").when(F.col("conv_id") % 7 == 0, "抱歉，未找到相关文献。").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_refusal(answer)).alias("refused"))


@query("judge_ratios", """SELECT source, round(avg(CASE WHEN total > 0 THEN greatest(0, least(1, good / total)) END), 4) AS faithfulness, count(*) AS n FROM
 (SELECT source, d.doc_id, sum(quality)::DOUBLE AS good, count(quality)::DOUBLE AS total FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY source""")
def judge_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported of all statements, null where a judge gave none, within 0 to 1."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source", "doc_id").agg(F.sum("quality").alias("good"), F.count("quality").alias("total"))
    ratio = F.when(F.col("total") > 0, clamp01(F.col("good") / F.col("total")))
    return joined.withColumn("r", ratio).groupBy("source").agg(E.mean4("r").alias("faithfulness"), F.count(F.lit(1)).alias("n"))


@query("judge_scores", "SELECT conv_id, turn, round(least(1, (length(text) % 13) / 10.0), 4) AS faithfulness, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE 0.5 END::DOUBLE AS answer_relevance, NULL::DOUBLE AS context_precision, CASE WHEN role = 'user' THEN 0.25 ELSE 0 END::DOUBLE AS context_recall FROM conversations")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that scores too high, fails, answers without JSON, in a fence, or below zero."""

    def judge(metric: str, row: dict) -> str:
        n = len(row["text"])
        if metric == "faithfulness":
            return f'Well: {{"faithfulness": {n % 13 / 10}}}'
        if metric == "answer_relevance":
            return '{"answer_relevance": "0.5"}' if n % 5 else str(1 / 0)
        return "no score" if metric == "context_precision" else '```json\n{"context_recall": 0.25}\n```' if row["role"] == "user" else '{"context_recall": -3}'

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return judged(rows, judge, inputs=["text", "role"]).drop("role", "text").withColumn("faithfulness", F.round("faithfulness", 4))
