"""Words of texts that are written without spaces: a dictionary counted from the corpus, and the most probable cut.

The dictionary has the sequences of two to four ideographs that are frequent and hold together: they stand there more
often than their best two parts would by chance. A run of ideographs is then a graph, whose edges are the dictionary's
words, found through a trie, and single characters; the cheapest path from its end back to its start is found by dynamic
programming. A word costs the negative logarithm of its share, in whole millionths, so that equal is equal anywhere."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import HAN, ascii_lower, folded, once

#: Characters of a word at most, how often it must be there, and how much oftener than by chance.
LONGEST, LEAST_COUNT, COHESION = 4, 5, 8.0
#: Words of a dictionary at most, the most frequent ones: about 40 bytes each go to every task.
MOST_WORDS = 500_000
MILLION = 1_000_000


def _plain(text: Column) -> Column:
    return once(folded(text), ascii_lower)


def count_words(docs: DataFrame, *, text: str, longest: int = LONGEST, least_count: int = LEAST_COUNT, cohesion: float = COHESION, most_words: int = MOST_WORDS) -> DataFrame:
    """word, n: single ideographs, and the sequences of up to `longest` that are words. Equal runs are counted once."""
    runs = docs.select(F.explode(F.regexp_extract_all(_plain(F.col(text)), F.lit(f"[{HAN}]+"), F.lit(0))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    places = lambda n: F.when(F.length("run") >= n, F.sequence(F.lit(1), F.length("run") - n + 1)).otherwise(F.array().cast("array<int>"))
    of_length = lambda n: F.transform(places(n), lambda i: F.substring("run", i, F.lit(n)))
    cuts = F.concat(*map(of_length, range(1, longest + 1)))
    counts = runs.select(F.explode(cuts).alias("word"), "times").groupBy("word").agg(F.sum("times").alias("n"))
    singles = counts.where(F.length("word") == 1)
    total = singles.agg(F.sum("n").alias("total"))  # one row
    longer = counts.where((F.length("word") > 1) & (F.col("n") >= least_count))
    # the best two parts: each cut of a word, with the counts of its parts
    parts = longer.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    split = parts.select("word", "n", F.substring("word", F.lit(1), F.col("at")).alias("head"), F.substring("word", F.col("at") + 1, F.length("word")).alias("tail"))
    part = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    by_chance = split.join(part("head"), "head").join(part("tail"), "tail").groupBy("word", "n").agg(F.max(F.col("n_head") * F.col("n_tail")).alias("pairs"))
    held = by_chance.join(F.broadcast(total)).where(F.col("n") * F.col("total") >= cohesion * F.col("pairs")).select("word", "n")
    return singles.unionByName(held.orderBy(F.desc("n"), "word").limit(most_words))


@dataclass(frozen=True)
class Dictionary:
    """The costs of words in millionths; what a character costs that is none of them."""

    costs: dict[str, int]
    unknown: int

    @classmethod
    def of(cls, words: DataFrame) -> Dictionary:
        """words: word, n; MOST_WORDS and the single characters at most."""
        rows = words.select("word", "n").collect()
        total = sum(r["n"] for r in rows)
        cost = lambda n: round(-math.log(n / total) * MILLION)
        return cls({r["word"]: cost(r["n"]) for r in rows}, cost(1) if total else 0)


def trie_of(costs: dict[str, int]) -> dict:
    """Characters to the next level; "" holds the cost of the word that ends there."""
    root: dict = {}
    for word, cost in costs.items():
        level = root
        for c in word:
            level = level.setdefault(c, {})
        level[""] = cost
    return root


def cut_run(run: str, trie: dict, unknown: int) -> list[str]:
    """The words of the cheapest path through a run; of equally cheap ones that with the longest first word."""
    n = len(run)
    cheapest, step = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        level, best = trie.get(run[i], {}), (level_cost(trie, run[i], unknown) + cheapest[i + 1], -1)
        k = i + 1
        while k < n and (level := level.get(run[k])) is not None:
            k += 1
            if "" in level:
                best = min(best, (level[""] + cheapest[k], i - k))
        cheapest[i], step[i] = best[0], -best[1]
    words, i = [], 0
    while i < n:
        words.append(run[i : i + step[i]])
        i += step[i]
    return words


def level_cost(trie: dict, character: str, unknown: int) -> int:
    return trie.get(character, {}).get("", unknown)


def tokenizer(dictionary: Dictionary) -> Callable[[Column], Column]:
    """A function of a text column, as functions.text.tokens but with words of the dictionary for runs of ideographs."""
    pattern = re.compile(rf"[a-z0-9]+|[{HAN}]+|[^\s\W{HAN}]")
    costs, unknown = dictionary.costs, dictionary.unknown
    kept: dict[str, object] = {}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(texts: pd.Series) -> pd.Series:
        if not kept:
            kept["trie"] = trie_of(costs)
        trie = kept["trie"]
        pieces = lambda t: [w for p in pattern.findall(t) for w in (cut_run(p, trie, unknown) if HAN[0] <= p[0] <= HAN[-1] else [p])]
        return pd.Series([None if t is None else pieces(t) for t in texts])

    return lambda text: words(_plain(text))
