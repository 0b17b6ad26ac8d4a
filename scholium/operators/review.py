"""Review of evidence and answers: what reviewers see, which replies hold, outside context, judges' scores."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clamp01, first_json

#: The coverages of a reply, the judges' metrics, the form of outside context.
COVERAGES = ("direct", "scoped", "insufficient")
METRICS = ("faithfulness", "answer_relevance", "context_precision", "context_recall")
OUTSIDE = "[外部来源: %s]\n%s"
#: Documents that a reviewer sees, and characters of each.
SHOWN, SHOWN_CHARS = 12, 2000


def shown_documents(evidence: DataFrame, *, question: str, position: str, label: str, text: str, most: int = SHOWN, most_chars: int = SHOWN_CHARS) -> DataFrame:
    """question, shown: the first documents of each question, numbered from 1, each cut, with their labels."""
    n = F.row_number().over(Window.partitionBy(question).orderBy(position))
    first = evidence.withColumn("_n", n).where(F.col("_n") <= most)
    block = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), label, F.lit("\n"), F.substring(text, 1, most_chars))
    return first.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("shown"))


def _holding(reply: str | None) -> tuple[str, dict]:
    """("yes" or "no", the reply's object): whether an answer is possible; "invalid" unless that is said by a boolean and
    the coverage is known and agrees with it."""
    text = first_json(reply)
    found = json.loads(text) if text else None
    answerable, coverage = (found.get("answerable"), found.get("coverage")) if isinstance(found, dict) else (None, None)
    if not isinstance(answerable, bool) or coverage not in COVERAGES or answerable == (coverage == "insufficient"):
        return "invalid", {}
    return ("yes" if answerable else "no"), found


def judge_evidence(reply: str | None, shown: int) -> tuple[str, list[int]]:
    """(kept, refused or invalid; the numbers from 1 of shown documents, in order). Only integers in range are numbers,
    and keeping none is invalid."""
    says, found = _holding(reply)
    if says != "yes":
        return ("refused" if says == "no" else "invalid"), []
    listed = found.get("keep") if isinstance(found.get("keep"), list) else []
    keep = sorted({k for k in listed if type(k) is int and 1 <= k <= shown})
    return ("kept", keep) if keep else ("invalid", [])


def judge_answer(reply: str | None) -> tuple[str, str | None]:
    """(kept, refused or invalid; the answer as reviewed, which must not be blank)."""
    says, found = _holding(reply)
    if says != "yes":
        return ("refused" if says == "no" else "invalid"), None
    text = found.get("answer")
    return ("kept", text.strip()) if isinstance(text, str) and text.strip() else ("invalid", None)


@F.pandas_udf(T.StructType([T.StructField("state", T.StringType()), T.StructField("keep", T.ArrayType(T.LongType()))]))
def evidence_verdict(replies: pd.Series, shown: pd.Series) -> pd.DataFrame:
    """judge_evidence on columns."""
    return pd.DataFrame([judge_evidence(r, int(n)) for r, n in zip(replies, shown, strict=True)], columns=["state", "keep"])


@F.pandas_udf(T.StructType([T.StructField("state", T.StringType()), T.StructField("answer", T.StringType())]))
def answer_verdict(replies: pd.Series) -> pd.DataFrame:
    """judge_answer on columns."""
    return pd.DataFrame([judge_answer(r) for r in replies], columns=["state", "answer"])


def outcome(first: Column, second: Column) -> Column:
    """What two verdicts come to: kept (the first's), confirmed (the second's, after a refusal), refused (by both), or
    failed: a review that does not hold changes nothing. The second is only asked for where the first refuses."""
    after = F.when(second == "kept", "confirmed").when(second == "refused", "refused").otherwise("failed")
    return F.when(first == "kept", "kept").when(first == "refused", after).otherwise("failed")


def second_opinion(ask: Callable[[int], str], judge: Callable[[str | None], tuple[str, object]]) -> tuple[str, object]:
    """(outcome, what is kept) of a reviewer that is asked again before it may refuse; one that is down has failed."""
    try:
        state, found = judge(ask(1))
        if state == "refused":
            state, found = judge(ask(2))
            state = "confirmed" if state == "kept" else state
    except Exception:  # noqa: BLE001 - a review that fails takes nothing away
        return "failed", None
    return ("failed", None) if state == "invalid" else (state, found)


def reviewed_evidence(evidence: DataFrame, replies: DataFrame, *, question: str, position: str, first: str = "first", second: str = "second", most: int = SHOWN) -> DataFrame:
    """The rows of evidence that its review leaves: all where it failed or was not made, else those that it keeps.

    replies: question and two replies, the second null where it was not asked for. The first `most` documents of a
    question are shown to the reviewer."""
    numbered = evidence.withColumn("_n", F.row_number().over(Window.partitionBy(question).orderBy(position)))
    shown = evidence.groupBy(F.col(question).alias("_q")).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("_shown"))
    asked = replies.join(shown, F.col(question) == F.col("_q")).select("_q", evidence_verdict(F.col(first), F.col("_shown")).alias("a"), evidence_verdict(F.col(second), F.col("_shown")).alias("b"))
    state = outcome(F.col("a.state"), F.col("b.state"))
    keep = F.when(state == "kept", F.col("a.keep")).when(state == "confirmed", F.col("b.keep")).when(state == "refused", F.array().cast("array<bigint>"))
    met = numbered.join(asked.select("_q", keep.alias("_keep")), F.col(question) == F.col("_q"), "left")
    return met.where(F.col("_keep").isNull() | F.array_contains("_keep", F.col("_n").cast("bigint"))).drop("_q", "_keep", "_n")


def outside_context(items: DataFrame, *, question: str, position: str, source: str, content: str, allowed: str, most_chars: int = 8000) -> DataFrame:
    """question, context: the allowed, non-empty items of each question, each cut, in order."""
    rows = items.where(F.col(allowed) & (F.coalesce(content, F.lit("")) != ""))
    block = F.format_string(OUTSIDE, F.col(source), F.substring(content, 1, most_chars))
    return rows.groupBy(question).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def judged(answers: DataFrame, judge: Callable[[str, dict], str], *, inputs: list[str]) -> DataFrame:
    """answers with the four metrics within 0 to 1; null where the judge failed or gave no number.

    judge(metric, the inputs by name) gives a reply with a JSON object that has the metric."""

    def ask(metric: str, row: dict) -> str | None:
        try:
            found = re.search(r"(?s)\{.*\}", judge(metric, row))
            value = json.loads(found[0]).get(metric) if found else None
            return None if value is None or isinstance(value, bool) else str(value)
        except Exception:  # noqa: BLE001 - a judge that fails gives no score
            return None

    def run(*columns: pd.Series) -> pd.DataFrame:
        rows = [dict(zip(inputs, values, strict=True)) for values in zip(*columns, strict=True)]
        return pd.DataFrame([{m: ask(m, r) for m in METRICS} for r in rows], columns=list(METRICS), dtype=object)

    shape = T.StructType([T.StructField(m, T.StringType()) for m in METRICS])
    scored = answers.withColumn("_j", F.pandas_udf(run, shape)(*inputs))
    number = lambda m: F.col(f"_j.{m}").try_cast("double")
    return scored.withColumns({m: F.when(number(m).isNotNull(), clamp01(number(m))) for m in METRICS}).drop("_j")
