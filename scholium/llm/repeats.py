"""Removal of long passages that stand more than once in a corpus: every window of so many words whose words also start
anywhere else, in the same document or another.

Super-k-mers: each window has a minimiser, the least hash of the few-word sequences in it. Consecutive windows of one
minimiser travel as one packed string, their words joined by spaces, to the minimiser's bucket. Equal windows have equal
minimisers, so a bucket counts its windows by itself: equal strings first, then the windows of the different strings,
sorted by a hash, where neighbours of equal hash are compared word for word. What a bucket finds goes back to the
documents as spans of words.

The strings of a bucket travel in compressed blocks, and buckets are as many as the corpus needs for BUCKET_BYTES in each.
A bucket over LIMIT_BYTES, as one minimiser may be that of a third of all windows, is not gathered: its windows become
digests of 128 bits, which are counted before they are shuffled and joined back with the most frequent ones by broadcast.
Buckets that hold more than LIMIT_BYTES and more than a MOST_HOT-th of the corpus, which are MOST_HOT at most, do so
where the documents are read, so that no task gets such a bucket; the others where their blocks meet.

A document is known by two hashes of its id and text, so the result does not depend on how files are cut into tasks.

Defined cases: a null text has no words, a text of fewer words than a window keeps all. Repeated rows (and copies under
other ids) repeat each other, so that all their windows go. Words are compared unchanged. Further columns stay where
asked for. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ready
from .common import cut, join_spread, pieces, with_arrow_columns

WINDOW = 35
#: Words of a minimiser.
SEED = 2
#: Of the blocks' compression.
LEVEL = 3
#: Packed bytes of a bucket on average, of one that is still gathered, and of the strings that a task holds at once.
BUCKET_BYTES, LIMIT_BYTES, HELD_BYTES = 4 << 20, 32 << 20, 64 << 20
MOST_HOT = 20_000
#: Bytes of texts that are looked at in one go.
PIECE = 2 << 20
#: Rows of digests that leave a function at once.
DIGESTS = 20_000
#: Bytes of a word that are hashed in one go with those of others.
SHORT = 24

_U = np.uint64
#: Odd multipliers of hashes; any would do.
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _B
    h = (h ^ (h >> _U(27))) * _C
    return h ^ (h >> _U(31))


class Words:
    """The words of several strings, each of words joined by single spaces, as positions and hashes."""

    def __init__(self, strings: Sequence[bytes], n_words: Sequence[int]) -> None:
        self.data = b"\n".join(strings)
        letters = np.frombuffer(self.data, dtype=np.uint8)
        breaks = np.flatnonzero((letters == 32) | (letters == 10))
        self.starts = np.concatenate(([0], breaks + 1)) if strings else np.zeros(0, np.int64)
        self.stops = np.concatenate((breaks, [len(letters)])) if strings else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(strings)), n_words)
        self.first = np.concatenate(([0], np.cumsum(n_words)[:-1])).astype(np.int64) if strings else np.zeros(0, np.int64)
        self.hashes = self._hashes(letters)

    def _hashes(self, letters: np.ndarray) -> np.ndarray:
        size = self.stops - self.starts
        h = size.astype(np.uint64) * _A
        left = np.arange(len(size))
        with np.errstate(over="ignore"):
            for k in range(SHORT):
                left = left[size[left] > k]
                if not len(left):
                    break
                h[left] = (h[left] ^ letters[self.starts[left] + k]) * _C
            for i in np.flatnonzero(size > SHORT):
                h[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.stops[i]], digest_size=8).digest(), "little")
            return _mixed(h)

    def windows(self, window: int) -> np.ndarray:
        """The positions at which a window of one string starts."""
        n = len(self.of) - window + 1
        return np.flatnonzero(self.of[:n] == self.of[window - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def text(self, at: int, window: int) -> bytes:
        return self.data[self.starts[at] : self.stops[at + window - 1]]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    got, had = values, 1
    while 2 * had <= width:
        got, had = np.minimum(got[: len(got) - had], got[had:]), 2 * had
    rest = width - had
    return np.minimum(got[: len(got) - rest], got[rest:]) if rest else got


def super_kmers(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """minimiser, first and last window of each longest run of windows of one string that share a minimiser."""
    starts = words.windows(window)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    with np.errstate(over="ignore"):
        n = len(words.hashes) - seed + 1
        mixed = words.hashes[:n].copy()
        for k in range(1, seed):
            mixed = mixed * _A + words.hashes[k : n + k]
        least = _least(_mixed(mixed), window - seed + 1)[starts]
    new = np.concatenate(([True], (np.diff(starts) > 1) | (np.diff(words.of[starts]) > 0) | (np.diff(least.view(np.int64)) != 0)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return least[first], starts[first], starts[last]


def window_hashes(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """64 bits of each window: a polynomial in the words' hashes, by sums from the front."""
    with np.errstate(over="ignore"):
        power = np.full(len(words.hashes) + 1, _A)
        power[0] = 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hashes * np.cumprod(power)[:-1])))
        inverse = np.full(len(words.hashes) + 1, _U(pow(int(_A), -1, 1 << 64)))
        inverse[0] = 1
        return _mixed((sums[starts + window] - sums[starts]) * np.cumprod(inverse)[starts])


def repeated_windows(strings: list[bytes], times: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """string, first and last window of each run of windows that are repeated, among different strings seen so often."""
    words = Words(strings, [s.count(b" ") + 1 for s in strings])
    starts = words.windows(window)
    hashes = window_hashes(words, starts, window)
    again = times[words.of[starts]] > 1
    order = np.argsort(hashes, kind="stable")
    equal = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    odd = set()
    for a, b in zip(order[equal].tolist(), order[equal + 1].tolist()):
        if words.text(starts[a], window) == words.text(starts[b], window):
            again[a] = again[b] = True
        else:
            odd.add(int(hashes[a]))
    for h in odd:  # one hash of different windows: each by its words
        by_words = defaultdict(list)
        for a in np.flatnonzero(hashes == _U(h)).tolist():
            by_words[words.text(starts[a], window)].append(a)
        for found in by_words.values():
            if len(found) > 1:
                again[found] = True
    at = np.flatnonzero(again)
    if not len(at):
        return []
    place, string = starts[at], words.of[starts[at]]
    new = np.concatenate(([True], (np.diff(place) > 1) | (np.diff(string) > 0)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    offset = words.first[string[first]]
    return list(zip(string[first].tolist(), (place[first] - offset).tolist(), (place[last] - offset).tolist()))


def _cut_texts(batch: pa.RecordBatch, window: int) -> tuple[Words, np.ndarray]:
    """The words of the texts that have a window, and the keys of their documents."""
    texts, counts, rows = [], [], []
    for k, text in enumerate(batch.column(2).to_pylist()):
        words = text.encode().split() if text else ()
        if len(words) >= window:
            texts.append(b" ".join(words))
            counts.append(len(words))
            rows.append(k)
    keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
    return Words(texts, counts), keys[rows]


BLOCK = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("size", T.LongType()), T.StructField("strings", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("places", T.BinaryType())])
SPAN = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("digest", T.BinaryType())])
LOAD = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("bytes", T.LongType())])


def _batch(schema: T.StructType, columns: Sequence) -> pa.RecordBatch:
    types = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, types)], names=types.names)


def _sized(words: Words, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    return words.stops[last + window - 1] - words.starts[first]


def _loads(window: int, seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            words, _ = _cut_texts(batch, window)
            least, first, last = super_kmers(words, window, seed)
            found, where = np.unique(least % _U(buckets), return_inverse=True)
            yield _batch(LOAD, (found.astype(np.int64), np.bincount(where, _sized(words, first, last, window), len(found)).astype(np.int64)))

    return run


def _blocks(window: int, seed: int, buckets: int, hot: frozenset[int]):
    """A row for each bucket that the strings at hand go to, hot ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_bytes = defaultdict(lambda: ([], [], [])), 0

        def flushed() -> pa.RecordBatch:
            rows, packer = [], pa.Codec("zstd", compression_level=LEVEL)
            for bucket, (strings, keys, places) in held.items():
                joined = b"\n".join(strings)
                rows.append((bucket, len(joined), packer.compress(joined, asbytes=True), b"".join(keys), np.array(places, np.int32).tobytes()))
            held.clear()
            return _batch(BLOCK, list(zip(*rows)))

        for batch in pieces(batches, PIECE):
            words, keys = _cut_texts(batch, window)
            least, first, last = super_kmers(words, window, seed)
            of, size = words.of[first], _sized(words, first, last, window)
            begins = words.starts[first]
            rows = zip((least % _U(buckets)).tolist(), begins.tolist(), (begins + size).tolist(), of.tolist(), (first - words.first[of]).tolist())
            doc_keys = [k.tobytes() for k in keys]
            for bucket, a, b, doc, place in rows:
                if bucket not in hot:
                    strings, its_keys, places = held[bucket]
                    strings.append(words.data[a:b])
                    its_keys.append(doc_keys[doc])
                    places.append(place)
            n_bytes += int(size.sum())
            if n_bytes > HELD_BYTES and held:
                yield flushed()
                n_bytes = 0
        if held:
            yield flushed()

    return run


def _digests(strings: Iterator[tuple[bytes, bytes, int]], window: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of the strings, which come with their document's key and their first word's place in it."""
    rows: list[tuple] = []
    for string, key, place in strings:
        k1, k2 = np.frombuffer(key, np.int64).tolist()
        words = string.split(b" ")
        for k in range(len(words) - window + 1):
            digest = hashlib.blake2b(b" ".join(words[k : k + window]), digest_size=16).digest()
            rows.append((k1, k2, place + k, place + k + window, digest))
            if len(rows) >= DIGESTS:
                yield _batch(SPAN, list(zip(*rows)))
                rows = []
    if rows:
        yield _batch(SPAN, list(zip(*rows)))


def _hot_windows(window: int, seed: int, buckets: int, hot: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            words, keys = _cut_texts(batch, window)
            least, first, last = super_kmers(words, window, seed)
            in_hot = np.isin(least % _U(buckets), np.array(sorted(hot), np.uint64))
            first, last = first[in_hot], last[in_hot]
            of, size = words.of[first], _sized(words, first, last, window)
            rows = zip(words.starts[first].tolist(), size.tolist(), of.tolist(), (first - words.first[of]).tolist())
            yield from _digests(((words.data[a : a + n], keys[doc].tobytes(), place) for a, n, doc, place in rows), window)

    return run


def _opened(block: tuple) -> Iterator[tuple[bytes, bytes, int]]:
    _, size, strings, keys, places = block
    texts = pa.decompress(strings, decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")
    return zip(texts, (keys[i : i + 16] for i in range(0, len(keys), 16)), np.frombuffer(places, np.int32).tolist())


def _counted(blocks: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """The spans of one bucket's repeated windows."""
    if not blocks:
        return
    index: dict[bytes, int] = {}
    seen = [(index.setdefault(string, len(index)), key, place) for block in blocks for string, key, place in _opened(block)]
    times = np.bincount([s for s, _, _ in seen], minlength=len(index))
    spans = defaultdict(list)
    for string, a, b in repeated_windows(list(index), times, window):
        spans[string].append((a, b + window))
    rows = [(key, place + a, place + b) for string, key, place in seen for a, b in spans.get(string, ())]
    if rows:
        keys = np.frombuffer(b"".join(r[0] for r in rows), np.int64).reshape(-1, 2)
        yield _batch(SPAN, (keys[:, 0], keys[:, 1], [r[1] for r in rows], [r[2] for r in rows], [None] * len(rows)))


def _buckets(window: int, limit: int):
    """Spans of the repeated windows of each bucket, whose blocks come together; digests of those of a large bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n_bytes = None, [], 0
        for batch in batches:
            for block in zip(*(column.to_pylist() for column in batch.columns)):
                if block[0] != now:
                    yield from _counted(held, window)
                    now, held, n_bytes = block[0], [], 0
                held.append(block)
                n_bytes += block[1]
                if n_bytes > limit:
                    for one in held:
                        yield from _digests(_opened(one), window)
                    held = []
        yield from _counted(held, window)

    return run


def _keys(row_id: str, text: str) -> list[Column]:
    own, said = F.col(f"`{row_id}`").cast("string"), F.col(f"`{text}`")
    return [F.xxhash64(own, said), F.xxhash64(F.lit(1), said, own)]


def repeated_spans(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, limit_bytes: int = LIMIT_BYTES, most_hot: int = MOST_HOT) -> DataFrame:
    """k1, k2, spans array<struct<first, stop>>: of each document, by the hashes of its id and text, the words from first
    up to stop that windows cover whose words also start elsewhere. Spans may overlap."""
    spark = ready(docs.sparkSession)
    keyed = docs.select(*[k.alias(f"k{i + 1}") for i, k in enumerate(_keys(row_id, text))], F.col(f"`{text}`").alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0
    buckets = max(1, 3 * n_bytes // bucket_bytes)
    loads = cut(keyed.mapInArrow(_loads(window, seed, buckets), LOAD).groupBy("bucket").agg(F.sum("bytes").alias("bytes")))
    packed = loads.agg(F.sum("bytes")).first()[0] or 0
    hot = frozenset(r[0] for r in loads.where(F.col("bytes") > max(limit_bytes, packed // most_hot)).select("bucket").collect())  # most_hot at most
    dealt = keyed.mapInArrow(_blocks(window, seed, buckets, hot), BLOCK).repartition("bucket").sortWithinPartitions("bucket")
    found = cut(dealt.mapInArrow(_buckets(window, limit_bytes), SPAN))
    spans, open_ones = found.where("digest is null"), found.where("digest is not null")
    if hot:
        open_ones = cut(open_ones.unionByName(keyed.mapInArrow(_hot_windows(window, seed, buckets, hot), SPAN)))
    if hot or not open_ones.isEmpty():
        times = open_ones.groupBy("digest").agg(F.count(F.lit(1)).alias("times"))
        again = cut(times.where("times > 1").withColumn("again", F.lit(True)))
        met = join_spread(open_ones, again, "digest", "times", keys=again.count())
        spans = spans.unionByName(met.select(*found.columns))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))


def _removal():
    def run(texts: pa.Array, spans: pa.Array) -> dict:
        kept, n_words, n_removed = [], [], []
        for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
            words = text.encode().split() if text else []
            stays = bytearray(b"\1") * len(words)
            for cut_out in cuts or ():
                stays[cut_out["first"] : cut_out["stop"]] = bytes(cut_out["stop"] - cut_out["first"])
            left = list(compress(words, stays)) if cuts else words
            kept.append(b" ".join(left).decode())
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
        return {"kept_text": kept, "n_words": n_words, "n_removed": n_removed}

    return run


RESULT = T.StructType([T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


def without_repeats(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None, **options) -> DataFrame:
    """The keep columns (all by default) with kept_text, the words that stay joined by spaces, n_words and n_removed."""
    kept = docs.columns if keep is None else list(keep)
    spans = repeated_spans(docs, row_id=row_id, text=text, **options)
    k1, k2 = _keys(row_id, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"), k1.alias("r1"), k2.alias("r2"))
    met = rows.join(spans, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")), "left").select("row", "text", "spans")
    done = with_arrow_columns(met, ["text", "spans"], RESULT, _removal, keep=["row"])
    return done.select(*[F.col("row")[c].alias(c) for c in kept if c not in RESULT.names], *RESULT.names)
