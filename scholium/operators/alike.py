"""A similarity join of texts by the ratio of their matching blocks; only pairs that can reach it are compared by it.

Two texts of a and b characters with a ratio of t have m = t (a + b) / 2 characters in matching blocks at least, and what
is between the blocks is a + b - 2 m at most. So the blocks are few, as each but one has something between it and the
next, and the texts share most of their grams of q characters: m - (q - 1) (a + b - 2 m + 1) at least. This leaves open
six tenths of their grams, so even the rarest of these make nearly all pairs meet. So texts lie in chunks by their length, of which each two of near
lengths meet in one task, where how many grams two texts share is counted for tiles of them at once. Matching blocks keep
their order, so a gram lies at most half of a + b - 2 m characters nearer to or farther from its text's middle in one than
in the other: only grams of neighbouring zones are shared (the second same one of a zone is another than the first). Rare
grams add one to each pair that has them, frequent ones are a product of matrices. Only the pairs that the bound leaves go
on: seconds grow with the square of the texts, shuffle and memory do not."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_text, similarity_ratio
from ..session import ready, shared_dir

#: What the ratio is taken of: letters and digits, in lower case.
_BARE = r"(?U)[\W_]+"
LEAST = 0.9
#: Characters of the texts in a chunk, at least and at most, and what a text counts beside its own.
LEAST_CHUNK, MOST_CHUNK, ROW = 1 << 18, 1 << 25, 200
#: Texts and characters of a tile, at most; a gram is frequent if more than one in so many pairs of a tile share it.
TILE, TILE_SIZE, SPARSE = 1024, 1 << 21, 400
#: The characters of a gram, of texts up to so many; fewer where the bound would leave less than a share of the grams.
GRAMS, LEAST_SHARE = ((40, 3), (80, 4), (160, 5), (math.inf, 6)), 0.1
#: Slots that grams are dealt to, at most, as a power of two, and zones of a text.
MOST_SLOTS, MOST_ZONES = 22, 64
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _BARE, ""))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as it counts, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _grams(texts: list[str], q: int, width: float, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slot and the owner of each gram, by slot, and where each slot starts. Slots of a gram's neighbouring zones, which
    are width half characters wide, are neighbours; grams that fall together count as one."""
    n = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner, last = np.repeat(np.arange(len(texts)), n), np.repeat(np.cumsum(n), n)
    grams = np.zeros(len(points), np.uint64)
    for k in range(q):
        grams[: len(points) - k] = grams[: len(points) - k] * _MIX[0] ^ points[k:] * _MIX[1]
        grams ^= grams >> np.uint64(29)
    place = np.arange(len(points))
    whole = place + q <= last
    middle = np.cumsum(n) * 2 - n
    zone = np.floor((2 * place - middle[owner]) / width).astype(np.int64) + MOST_ZONES
    high, low = np.uint64(32), np.uint64(16)
    both = np.sort((grams[whole] * _MIX[2] >> high << high) | (zone[whole] << 16 | owner[whole]).astype(np.uint64))
    fresh = np.flatnonzero(np.r_[True, both[1:] != both[:-1]][: len(both)])
    nth = np.arange(len(both)) - np.repeat(fresh, np.diff(np.r_[fresh, len(both)]))
    slot = ((both >> high) + nth.astype(np.uint64) * _MIX[0]) * _MIX[1] >> np.uint64(64 - slots)
    both = np.sort(slot + (both >> low & np.uint64(0xFFFF)) << low | both & np.uint64(0xFFFF))
    slot = (both >> low).astype(np.int32)
    starts = np.r_[0, np.cumsum(np.bincount(slot, minlength=(1 << slots) + 2 * MOST_ZONES + 2))].astype(np.int32)
    return slot, (both & np.uint64(0xFFFF)).astype(np.int32), starts


def _shared(left: tuple, right: tuple, n_left: int, n_right: int, at_once: int = 1 << 19) -> np.ndarray:
    """(n_left, n_right): how many grams two texts share, at least as many as they do."""
    (slot, own, starts_1), (_, others, starts_2) = left, right
    start = starts_2[slot - 1]
    count = starts_2[slot + 2] - start
    frequent = (starts_1[slot + 1] - starts_1[slot]).astype(np.int64) * count * SPARSE > n_left * n_right
    shared = np.zeros((n_left, n_right), np.float32)
    if frequent.any():
        often, nth = np.unique(slot[frequent], return_inverse=True)
        owner = own[frequent].astype(np.int64)
        for k in range(0, len(often), TILE):
            w = often[k : k + TILE]
            some = (nth >= k) & (nth < k + len(w))
            one = np.bincount(owner[some] * len(w) + nth[some] - k, minlength=n_left * len(w))
            n = starts_2[w + 2] - starts_2[w - 1]
            two = np.bincount(others[_ranges(starts_2[w - 1], n)] * len(w) + np.repeat(np.arange(len(w)), n), minlength=n_right * len(w))
            shared += one.reshape(n_left, len(w)).astype(np.float32) @ two.reshape(n_right, len(w)).astype(np.float32).T
    rare = np.flatnonzero(~frequent & (count > 0))
    own, start, count = own[rare] * n_right, start[rare], count[rare]
    ends, k = np.cumsum(count, dtype=np.int64), 0
    found = np.zeros(n_left * n_right, np.int64)
    while k < len(own):
        z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + max(at_once, 2 * len(found)), side="right")))
        n = count[k:z]
        found += np.bincount(np.repeat(own[k:z], n) + others[_ranges(start[k:z], n)], minlength=len(found))
        k = z
    return shared + found.reshape(n_left, n_right)


def _least_shared(both: np.ndarray, t: float, q: int) -> np.ndarray:
    """How many grams two texts of so many characters in all share if their ratio is t or more."""
    m = np.ceil(t * both / 2)
    return np.maximum(0, m - (q - 1) * (both - 2 * m + 1))


def _counts(texts: list[str], of: int = 64) -> np.ndarray:
    """(texts, of): how often each text has characters of so many kinds."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(owner * of + points % of, minlength=len(texts) * of).reshape(len(texts), of)


def _tiles(ids: list, texts: list[str], *how) -> Iterator[tuple[list, np.ndarray, tuple]]:
    """Ids, lengths and grams of tiles of the texts: by length, and of some tiles' texts those with the same characters
    side by side, as texts of two languages or scripts share few frequent grams."""
    longer, order = sorted(range(len(texts)), key=lambda k: len(texts[k])), []
    for k in range(0, len(longer), 4 * TILE):
        some = longer[k : k + 4 * TILE]
        counts = np.concatenate([_counts([texts[i] for i in some[z : z + TILE]]) for z in range(0, len(some), TILE)])
        shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
        order += [some[i] for i in np.argsort(shares @ np.linalg.eigh(np.cov(shares.T, ddof=0))[1][:, -1], kind="stable")]
    first, size = 0, 0
    for z, k in enumerate(order, 1):
        size += len(texts[k])
        if z == len(order) or z - first == TILE or size + len(texts[order[z]]) > TILE_SIZE:
            of = order[first:z]
            yield [ids[i] for i in of], np.array([len(texts[i]) for i in of], np.int64), _grams([texts[i] for i in of], *how)
            first, size = z, 0


def _met(left: tuple[list, list[str]], right: tuple[list, list[str]] | None, t: float) -> Iterator[tuple]:
    """Pairs of the ids of two lists of ids and texts, or of one, that can have the ratio t."""
    longest = max((len(x) for side in (left, right) if side for x in side[1]), default=0)
    q = min(next(q for most, q in GRAMS if longest <= most), 1 + int((t - LEAST_SHARE) / (2 - 2 * t)) if t < 1 else 5)
    slots = min(MOST_SLOTS, math.ceil(math.log2(4 * TILE * (longest + 1))))
    how = q, max(2 * (1 - t) * longest, 2 * longest / MOST_ZONES) + 1, slots
    tiles = list(_tiles(*left, *how))
    for k, (ids_2, n_2, grams_2) in enumerate(tiles if right is None else _tiles(*right, *how)):
        for ids_1, n_1, grams_1 in tiles[: k + 1] if right is None else tiles:
            if n_2.min() * t > n_1.max() * (2 - t) + 1e-6 or n_1.min() * t > n_2.max() * (2 - t) + 1e-6:
                continue
            both = n_1[:, None] + n_2
            least = _least_shared(np.arange(both.max() + 1), t, q).astype(np.float32)
            i, j = np.nonzero(_shared(grams_1, grams_2, len(n_1), len(n_2)) >= least[both])
            can = np.minimum(n_1[i], n_2[j]) >= t * (n_1[i] + n_2[j]) / 2 - 1e-6
            if right is None and ids_1 is ids_2:
                can &= i < j
            for x, y in zip(i[can].tolist(), j[can].tolist(), strict=True):
                yield ids_1[x], ids_2[y]


def candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b): the pairs of keys whose texts can have the ratio. texts: key, bare, each different."""
    if threshold < LEAST:
        raise ValueError(f"the bound needs a threshold of {LEAST} or more")
    t = threshold - 1e-6  # ratios are rounded
    shared_dir(ready(texts.sparkSession))
    # by the texts as the ratio takes them, in steps of length that alike ones lie in one of or two neighbouring ones
    step = math.log((2 - t) / t) + 1e-6
    n = F.length("bare")
    rows = texts.select("key", bare_text("bare").alias("bare")).where(n > 0).select("key", "bare", F.floor(F.log(n) / step).cast("int").alias("step")).checkpoint(eager=True)
    sizes = {r["step"]: r["size"] for r in rows.groupBy("step").agg(F.sum(n + ROW).alias("size")).collect()}  # a few hundred at most
    if not sizes:
        return texts.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    chunk = min(MOST_CHUNK, max(LEAST_CHUNK, sum(sizes.values()) // 16))
    parts = {s: -(-size // chunk) for s, size in sizes.items()}
    meetings = sum(m * (m + 1) // 2 + m * parts.get(s + 1, 0) for s, m in parts.items())
    of = F.create_map(*[F.lit(x) for s, m in parts.items() for x in (s, m)])
    s, part = F.col("step"), F.col("part")
    meeting = lambda s1, p1, s2, p2, side: F.struct(s1.alias("s1"), p1.cast("int").alias("p1"), s2.alias("s2"), p2.cast("int").alias("p2"), side.cast("int").alias("side"))
    all_of = lambda step: F.when(F.coalesce(F.try_element_at(of, step), F.lit(0)) > 0, F.sequence(F.lit(0), F.try_element_at(of, step).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(all_of(s), lambda p: meeting(s, F.least(p, part), s, F.greatest(p, part), p < part))
    longer = F.transform(all_of(s + 1), lambda p: meeting(s, part, s + 1, p, F.lit(0)))
    shorter = F.transform(all_of(s - 1), lambda p: meeting(s - 1, p, s, part, F.lit(1)))
    placed = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.element_at(of, s)).cast("int"))
    going = placed.select("key", "bare", F.explode(F.concat(own, longer, shorter)).alias("m")).select("m.*", "key", "bare")

    def meet(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        lists = [(got.column("key").to_pylist(), got.column("bare").to_pylist()) for got in (group.filter(pa.array(side == k)) for k in (0, 1))]
        one = group.slice(0, 1).to_pylist()[0]
        own = (one["s1"], one["p1"]) == (one["s2"], one["p2"])
        pairs = [(min(x), max(x)) for x in _met(lists[0], None if own else lists[1], t)] if own or all(len(x[0]) for x in lists) else []
        return pa.table({"a": pa.array([x[0] for x in pairs], pa.string()), "b": pa.array([x[1] for x in pairs], pa.string())})

    by = ["s1", "p1", "s2", "p2"]
    return going.repartition(min(4096, max(8, meetings)), *by).groupBy(*by).applyInArrow(meet, "a string, b string")


def alike(rows: DataFrame, *, row_id: str, text: str, threshold: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """Rows whose texts are alike: (row_id and the key of its text, from the bare text; a, b, ratio of alike keys).

    Rows of one bare text have one key and are alike; links between different texts are pairs of keys, so that many equal
    rows make no pairs. Null is like an empty text."""
    shared_dir(ready(rows.sparkSession))
    keyed = rows.select(F.col(f"`{row_id}`").alias(row_id), bare(F.col(f"`{text}`")).alias("bare")).withColumn("key", F.sha2("bare", 256))
    texts = keyed.select("key", "bare").distinct().checkpoint(eager=True)
    pairs = candidates(texts, threshold)
    of = lambda k: texts.select(F.col("key").alias(k), F.col("bare").alias(f"text_{k}"))
    # few bytes, but much work each
    met = pairs.join(of("a"), "a").join(of("b"), "b").repartition(max(32, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    scored = met.select("a", "b", F.round(similarity_ratio("text_a", "text_b"), 6).alias("ratio"))
    return keyed.select(row_id, "key"), scored.where(F.col("ratio") >= threshold)
