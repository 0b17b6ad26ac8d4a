"""Searches of external indexes as one call: cleaned, checked, sent to the providers, read, and told what went wrong."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import academic as A
from .readers import replies

#: Providers with the readers of their replies, in the order in which their papers count.
PROVIDERS = {"semantic_scholar": A.semantic_scholar, "crossref": A.crossref, "openalex": A.openalex}
#: Those that are asked together; one that needs a key only if there is one.
TOGETHER, NEEDS_KEY = ("semantic_scholar", "crossref", "openalex"), ("openalex",)
QUERY_CHARS, MOST, DEFAULT_LIMIT = 500, 100, 20


@dataclass
class Search:
    """papers: the columns of operators.academic.papers, or None where the search could not be made."""

    query: str
    provider: str
    papers: DataFrame | None = None
    providers: tuple[str, ...] = ()
    warnings: tuple[str, ...] = field(default_factory=tuple)
    failed: bool = False


def search_papers(spark: SparkSession, query: str | None, transport: Callable[[str, str, int], str], *, provider: str = "auto", limit: int | None = None, keys: dict[str, str] | None = None, enabled: bool = True) -> Search:
    """Papers with a usable abstract for a query, without doubles, in the order of the providers.

    transport: (provider, query, limit) -> the body of its reply; it runs in a task of its own for each provider. One
    that fails is a warning; the search has failed if all do, or if it cannot be made."""
    clean = " ".join((query or "").split())[:QUERY_CHARS]
    chosen = provider.strip().lower()
    most = max(1, min(MOST, limit or DEFAULT_LIMIT))
    refused = "the search is switched off" if not enabled else "the query is empty" if not clean else f"there is no provider {chosen}" if chosen != "auto" and chosen not in PROVIDERS else ""
    lacking = [p for p in NEEDS_KEY if not (keys or {}).get(p)]
    if not refused and chosen in lacking:
        refused = f"{chosen} needs a key"
    if refused:
        return Search(clean, chosen, warnings=(refused,), failed=True)
    asked = [p for p in TOGETHER if p not in lacking] if chosen == "auto" else [chosen]
    got = replies(spark, [(p, clean) for p in asked], lambda p, q: transport(p, q, most)).persist()
    errors = {r["provider"]: r["error"] for r in got.where("error is not null").select("provider", "error").collect()}
    lists = [A.papers(PROVIDERS[p](got.where((F.col("provider") == p) & F.col("error").isNull()), body="body")).withColumn("pos", F.monotonically_increasing_id()) for p in asked]
    papers = A.union_distinct(lists).orderBy("provider_ord", "pos").limit(most * len(asked))
    found = tuple(r[0] for r in papers.groupBy("provider").agg(F.min("provider_ord").alias("o")).orderBy("o").collect())
    warnings = [f"{p}: {errors[p]}" for p in asked if p in errors]
    if not found and len(errors) < len(asked):
        warnings.append("no paper has a usable abstract")
    return Search(clean, chosen, papers, found, tuple(warnings), len(errors) == len(asked))
