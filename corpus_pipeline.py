"""From raw documents to token ids: the stages in order, each written as Parquet and read again by the next.

quality: documents that fail the quality rules go, the others lose their failing lines; short ones of MIN_WORDS words or
more are kept, as many clean documents are short. near_duplicates: one document of each group of near copies (SimHash of
five-word shingles, similarity 0.8 or more) stays. decontamination: passages of the benchmark go, and documents made of
them mostly. pii: personal data gets surrogates. tokens: byte-level BPE ids, with digests of the ids and of the decoded
bytes.

Defined cases: documents without words fail the quality rules, in every stage behind it they would stay (near_duplicates
keeps one). A null doc_id is kept like any other. Repeated rows are copies. Further columns stay, and keep their values
also where they are named like what a stage computes. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import bpe, decontaminate, pii, quality, simhash
from scholium.session import fresh_dir, table


#: Documents of fewer words go.
MIN_WORDS = 5


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, without their failing lines."""
    return _measured(quality.clean(docs, min_words=MIN_WORDS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash of five-word shingles, linked at a similarity of 0.8."""
    return simhash.one_of_each(docs, simhash.near_copies(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the benchmark's passages, and without documents that are mostly such."""
    return _measured(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates for personal data, by the session's key."""
    return _measured(pii.pseudonymise(docs, key=pii.key_of(spark)).select(*[F.col(f"`{c}`") for c in docs.columns]))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids, their number, and digests of the ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("tokens", token_stage),
]

#: SQL cannot express the fingerprints, the surrogates and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    root = fresh_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
QUERY_SQL: dict[str, str] = {}
