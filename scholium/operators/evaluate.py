"""Retrieval quality, answers and latency."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name


def relevance(results: DataFrame, evidence: DataFrame, *, question: str, tolerance: int = 0) -> DataFrame:
    """results with hits (the evidence pages each meets, a set) and relevant.

    Names are compared as lower-case base names, pages within the tolerance. A result without a page is relevant by
    its name alone, but meets no page."""
    e = evidence.select(F.col(question).alias("_q"), base_name(F.col("filename")).alias("_name"), F.col("page").alias("_page"))
    near = (F.col(question) == F.col("_q")) & (base_name(F.col("filename")) == F.col("_name")) & (F.col("page").isNull() | (F.abs(F.col("page") - F.col("_page")) <= tolerance))
    met = results.join(e, near, "left")
    hits = F.collect_set(F.when(F.col("page").isNotNull() & F.col("_page").isNotNull(), F.struct("_name", "_page")))
    return met.groupBy(*[F.col(c) for c in results.columns]).agg(hits.alias("hits"), F.max(F.col("_q").isNotNull()).alias("relevant"))


def scorecard(results: DataFrame, evidence: DataFrame, *, question: str, ks: tuple[int, ...] = (1, 3, 5, 10), tolerance: int = 0, digits: int = 6) -> DataFrame:
    """question, k, recall, ndcg, mrr for each question with evidence. results: question, rank, filename, page.

    The gains count every relevant result, the ideal only the evidence, so ndcg can exceed 1; mrr is over all ranks."""
    flagged = relevance(results, evidence, question=question, tolerance=tolerance)
    total = evidence.select(question, base_name(F.col("filename")).alias("n"), "page").distinct().groupBy(question).agg(F.count(F.lit(1)).alias("total"))
    gain = F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    first = F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first")
    # one pass: each result counts for every k that it is within, and for 0, which is all ranks
    spread = flagged.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, (0, *ks))), lambda k: (k == 0) | (F.col("rank") <= k))))
    sums = spread.groupBy(question, "k").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("found"), F.sum(gain).alias("dcg"), first)
    every = total.join(F.broadcast(reduce(DataFrame.unionByName, [total.sparkSession.range(1).select(F.lit(k).alias("k")) for k in ks])))  # one row for each k
    whole = sums.where("k = 0").select(question, "first")
    card = every.join(sums.drop("first"), [question, "k"], "left").join(whole, question, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return card.select(question, "k", F.round(F.coalesce(F.col("found"), F.lit(0)) / F.col("total"), digits).alias("recall"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, digits).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), digits).alias("mrr"))


def mean4(column: str) -> Column:
    return F.round(F.avg(column), 4)


def report(items: DataFrame) -> DataFrame:
    """One row: counts, means of the metrics over answerable items, accuracy of refusals, mean latency.

    items: expect_refusal, refused, recall, mrr, latency (null where it does not apply)."""
    asked = ~F.col("expect_refusal")
    return items.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("expect_refusal").alias("n_refusal"), F.round(F.avg(F.when(asked, F.col("recall"))), 4).alias("recall"), F.round(F.avg(F.when(asked, F.col("mrr"))), 4).alias("mrr"),
        F.round(F.avg(F.when(F.col("expect_refusal"), F.col("refused").cast("int"))), 4).alias("refusal_accuracy"), F.round(F.avg("latency"), 3).alias("latency"),
    )


def markdown(row: dict) -> str:
    """A report's row as a Markdown table; null as N/A."""
    lines = [f"| {k} | {'N/A' if v is None else f'{v:.4f}' if isinstance(v, float) else v} |" for k, v in row.items()]
    return "\n".join(["| metric | value |", "|---|---|", *lines]) + "\n"


def write_report(spark: SparkSession, row: dict, where: str) -> None:
    """A report below a folder, as report.json and report.md, in any store that Spark writes."""
    for name, text in (("json", json.dumps(row, ensure_ascii=False, default=str)), ("md", markdown(row))):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/report.{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
