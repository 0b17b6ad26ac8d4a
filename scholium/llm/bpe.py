"""Byte-level BPE encoding and decoding by a given table of ranks.

A text is cut by the pattern; each match is encoded by itself: its bytes are merged, always the adjacent pair
of the lowest rank, the leftmost of equals, until no pair has a rank. Decoding joins the ids' bytes.

Two forms give the same ids:
- encode_words_native: Spark higher-order functions fold the merges over the byte arrays of distinct words,
  with the rank map as a literal (an array of short lists by hash). See the README for its measured cost,
  which keeps it off the main path.
- with_tokens: an Arrow function that merges each distinct word once in a while, keeping a bounded cache.

Defined cases: null and empty texts have no ids. Repeated rows each give a row. Columns that carry an output's
name are replaced, all others are kept. Words of any length are merged in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow_columns

#: Words in each of two generations whose ids a task remembers; 200 bytes each are 100 MB for both.
CACHE_WORDS = 250_000
#: Above this many bytes a word is merged with a heap.
LONG_WORD = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines) if piece}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    scores = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while scores and (best := min(scores)) < NONE:
        at = scores.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at < len(scores):
            scores[at] = ranks.get(parts[at] + parts[at + 1], NONE)
        if at:
            scores[at - 1] = ranks.get(parts[at - 1] + parts[at], NONE)
    return [ranks[p] for p in parts]


#: Stands for a pair without a rank.
NONE = 1 << 40


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def score(i: int) -> int:
        j = after[i]
        return ranks.get(word[i : ends[j]], NONE) if j < n else NONE

    heap = [(s, i, i + 2) for i in range(n - 1) if (s := score(i)) < NONE]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or ends[j] != end:
            continue  # one of the two has changed since
        ends[i], alive[j], after[i] = ends[j], False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (s := score(k)) < NONE:
                heapq.heappush(heap, (s, k, ends[after[k]]))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def _pack(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class Encoder:
    """Encodes texts, and remembers words in two generations of at most cache_words words: when the younger is full
    it takes the place of the older, and words met again come back into the younger."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = CACHE_WORDS):
        self.ranks, self.split, self.limit = ranks, regex.compile(pattern).findall, cache_words
        self.pieces = {i: piece for piece, i in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        known, out = self.known, []
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                ids = self.older.get(word)
                if ids is None:
                    ids = _pack(merge(word.encode(), self.ranks))
                if len(word) <= LONG_WORD:
                    if len(known) >= self.limit:
                        self.older = known
                        known = self.known = {}
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple, Encoder] = {}


def _encoder(ranks: Broadcast, pattern: str, cache_words: int) -> Encoder:
    """One for each worker process and table."""
    key = (ranks._jbroadcast.id() if ranks._jbroadcast is not None else id(ranks.value), pattern, cache_words)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value, pattern, cache_words)
    return _encoders[key]


def _lists(ids: list[bytes]) -> pa.Array:
    """array<int> from packed ids."""
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _tokens(ranks: Broadcast, pattern: str, cache_words: int) -> Callable[[pa.Array], dict]:
    encoder = _encoder(ranks, pattern, cache_words)
    return lambda texts: {"token_ids": _lists([encoder.encode(t or "") for t in texts.to_pylist()])}


def _round_trips(ranks: Broadcast, pattern: str, cache_words: int, with_ids: bool) -> Callable[[pa.Array], dict]:
    encoder = _encoder(ranks, pattern, cache_words)

    def run(texts: pa.Array) -> dict:
        coded = [encoder.encode(t or "") for t in texts.to_pylist()]
        out = {"n_tokens": [len(ids) // 4 for ids in coded], "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids in coded], "decoded_sha256": [hashlib.sha256(encoder.decode(ids)).hexdigest() for ids in coded]}
        return out | ({"token_ids": _lists(coded)} if with_ids else {})

    return run


def _decoded(ranks: Broadcast, pattern: str, cache_words: int) -> Callable[[pa.Array], dict]:
    encoder = _encoder(ranks, pattern, cache_words)
    return lambda lists: {"decoded": [encoder.decode(np.array(ids or [], "<u4").tobytes()) for ids in lists.to_pylist()]}


def with_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """docs and token_ids array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary file
    return with_arrow_columns(docs, [text], T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType()))]), _tokens, shared, pattern, cache_words)


def with_decoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, ids: str = "token_ids") -> DataFrame:
    """docs and decoded binary, from a column of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return with_arrow_columns(docs, [ids], T.StructType([T.StructField("decoded", T.BinaryType())]), _decoded, shared, pattern, CACHE_WORDS)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", keep: Iterable[str] | None = None, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each text, and with_ids its token_ids, beside the columns of keep."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids
    return with_arrow_columns(docs, [text], T.StructType(fields), _round_trips, shared, pattern, cache_words, with_ids, keep=keep if keep is None else list(keep))


def literal_rank_map(ranks: dict[bytes, int], buckets: int = 65_536) -> Callable[[Column], Column]:
    """The rank of a binary column's value or null: a literal array of short lists, found by hash."""
    lists: list[list[dict]] = [[] for _ in range(buckets)]
    for piece, rank in ranks.items():
        lists[xxhash.xxh64_intdigest(piece, 42) % buckets].append({"piece": base64.b64encode(piece).decode(), "rank": rank})
    array = F.from_json(F.lit(json.dumps(lists)), "array<array<struct<piece:binary,rank:int>>>")  # folded into a literal

    def look_up(piece: Column) -> Column:
        entries = F.get(array, F.xxhash64(piece).bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int"))
        return F.get(F.filter(entries, lambda e: e["piece"] == piece), F.lit(0))["rank"]

    return look_up


def encode_words_native(words: DataFrame, look_up: Callable[[Column], Column], *, word: str = "word") -> DataFrame:
    """word (binary, distinct) and ids array<int>, by higher-order functions alone."""

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(parts: Column, _: Column) -> Column:
        def merged(scores: Column) -> Column:
            best = F.array_min(scores)
            at = F.array_position(scores, best).cast("int")
            joined = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts)))
            return F.when(best.isNull(), parts).otherwise(joined)

        pairs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: look_up(F.concat(F.get(parts, i), F.get(parts, i + 1)))))
        return F.when(F.size(parts) < 2, parts).otherwise(let(pairs, merged))

    size = F.octet_length(F.col(word))
    letters = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col(word), i, F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), size), letters, step)
    return words.select(F.col(word), F.transform(folded, look_up).alias("ids"))
