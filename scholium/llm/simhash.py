"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of equal value form one class. The bits are dealt into parts, correlated bits together, and each part gets
a threshold: a class indexes its own value of the part, and probes every other value within the threshold, so that two
classes meet at a place if they differ in at most that many bits of the part. What meets there is verified by all bits.
A threshold of -1 leaves a part out. The thresholds are those of the least estimated work, found by dynamic programming
over estimates of candidate counts from the bits' statistics over all classes. There are two rules for what they must
reach:

- exact (`near_duplicates`): fingerprints of one word of 64 bits, and thresholds with sum(t + 1) > distance over parts
  that share no bit, so that two fingerprints within the distance meet by the pigeonhole principle.
- by similarity (`near_copies`): 0.8 is about 10 of 64 bits, which no pigeonhole over 64 bits finds without comparing a
  large share of all pairs. Fingerprints have several words, and the parts are dealt anew in rounds, as many as it takes
  for two texts of the similarity to meet with probability `recall`. Those within `limit` bits, which such texts keep to
  with probability 0.95, are linked.

At a place with many classes only links that join different components are given out: a breadth-first search over the
classes there, in numpy, gives a spanning forest. Above `place_limit` rows the place is not gathered. In the exact rule
its links are found through midpoints, values within half the distance of both ends, with one aggregate for each
midpoint, which loses none. By similarity, its rows are dealt into chunks, and each two chunks are compared whole in a
task of their own, which loses none either: work in the square of such a place, in bounded memory.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other. The component of a row is
the smallest non-null doc_id in it, or null. Repeated rows are ordinary copies. Further columns are ignored by
near_duplicates and near_copies and kept by one_of_each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_spread, with_arrow_columns
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: For near copies: words in a shingle, similarity (Jaccard, of shingles), words of 64 bits in a fingerprint, the
#: probability that two texts of the similarity meet, and that they keep to the limit of bits.
COPY_SHINGLE, SIMILARITY, WORDS, RECALL, WITHIN = 5, 0.8, 4, 0.98, 0.95
PLACE_LIMIT = 32_768
#: No limit for a place, where chunks bound it.
ALL_ROWS = 1 << 62
#: Rows that are broadcast at most; 200 bytes each are 100 MB.
MAX_BROADCAST = 500_000
#: Costs of sending a value and of comparing a pair, in microseconds; only their ratio matters.
SEND_COST, PAIR_COST = 1.0, 0.02

Parts = list[tuple[list[int], int]]
_MIX = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


# fingerprints ---------------------------------------------------------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """Signed 64-bit words. A bit is set if it is in over half of the shingles' hashes; further words are of further
    hashes, mixed from the first."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(words, np.int64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    size = min(shingle, len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - size + 1].tolist()
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros((words, 64), np.int64), len(starts)
    spans = list(zip(starts, ends[size - 1 :].tolist(), strict=True))
    for k in range(0, n, 16_384):  # bounds the memory that a long text takes
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans[k : k + 16_384]], np.uint64)
        for w in range(words):
            own = hashes if w == 0 else (hashes ^ (hashes >> np.uint64(32))) * _MIX[w]
            own = own if w == 0 else own ^ (own >> np.uint64(29))
            counts[w] += np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1).view(">i8").ravel().astype(np.int64)


def names(words: int) -> list[str]:
    """The columns of a fingerprint."""
    return ["fp"] if words == 1 else [f"fp{k}" for k in range(words)]


def _fingerprinter(shingle: int, words: int) -> Callable[[pa.Array], dict]:
    def run(texts: pa.Array) -> dict:
        found = np.array([fingerprint(t, shingle, words) for t in texts.cast(pa.binary()).to_pylist()], np.int64).reshape(-1, words)
        return {name: found[:, k] for k, name in enumerate(names(words))}

    return run


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, tag (a hash that tells texts under one id apart) and the fingerprint's columns, in a few files."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    fields = T.StructType([T.StructField(c, T.LongType()) for c in names(words)])
    found = with_arrow_columns(plain, ["text"], fields, _fingerprinter, shingle, words, keep=["doc_id", "tag"])
    few = max(2 * docs.sparkSession.sparkContext.defaultParallelism, found.rdd.getNumPartitions() // 8)
    return cut(found.repartition(few))  # numbers only, so that every split's texts are read by a task of its own


# parts and thresholds -------------------------------------------------------------------------------------------------


def bit_statistics(classes: DataFrame, words: int = 1) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, of those that have both."""
    size = 64 * words
    upper = np.triu_indices(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((size, size)), 0
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(">i8") for c in batch.columns], axis=1)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, size // 8), axis=1).astype(np.float32)
            both += (bits.T @ bits).astype(np.float64)
            n += len(values)
        cells = np.append(both[upper], n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "n"])

    rows = classes.select(*names(words)).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a number for each two bits
    cells = np.zeros(len(upper[0]) + 1)
    for cell, n in rows:
        cells[cell] = n
    both = np.zeros((size, size))
    both[upper] = cells[:-1]
    return int(cells[-1]), np.maximum(both, both.T)


def group_bits(n: int, both: np.ndarray, parts: int, deal: int = 0) -> list[list[int]]:
    """The bits in groups of about equal size, each begun by a bit and filled with what correlates most with it.

    Another `deal` gives other groups: it adds its own noise to the correlations."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    if deal:
        noise = np.random.default_rng(deal).random(tied.shape)
        tied = tied + (noise + noise.T) / 4
    np.fill_diagonal(tied, 0)
    free, groups = np.ones(len(both), bool), []
    for k in range(parts):
        room = int(free.sum()) // (parts - k)
        first = int(np.where(free, tied[:, free].sum(axis=1), -1).argmax())
        group, pull = [first], tied[first].copy()
        free[first] = False
        while len(group) < room:
            group.append(int(np.where(free, pull, -1).argmax()))
            free[group[-1]] = False
            pull += tied[group[-1]]
        groups.append(sorted(group))
    return groups


def near_shares(bits: list[int], p: np.ndarray, most: int) -> list[float]:
    """Estimated share of all pairs that differ in at most 0, 1, ... most of these bits."""
    chances = np.zeros(len(bits) + 1)
    chances[0] = 1.0
    for b in bits:
        d = 2 * p[b] * (1 - p[b])
        chances[1:] = chances[1:] * (1 - d) + chances[:-1] * d
        chances[0] *= 1 - d
    return np.cumsum(chances)[: most + 1].tolist()


def costs(bits: list[int], n: int, p: np.ndarray, most: int) -> list[float]:
    """Of searching a part with threshold 0, 1, ... most: its rows, and the pairs that meet (each once)."""
    near = near_shares(bits, p, most)
    return [n * sum(math.comb(len(bits), j) for j in range(t + 1)) * SEND_COST + n * n / 2 * near[t] * PAIR_COST for t in range(len(near))]


def allocate(options: list[list[tuple[float, int]]], target: int) -> tuple[float, list[int]]:
    """The thresholds of least cost whose weights reach the target together, by dynamic programming over the parts.

    options: for each part the (cost, weight) of thresholds 0, 1, ...; -1 costs and weighs nothing."""
    best, steps = np.full(target + 1, np.inf), []
    best[0] = 0.0
    for own in options:
        after, choice, before = best.copy(), np.full(target + 1, -1), np.arange(target + 1)
        for t, (cost, weight) in enumerate(own):
            weight = min(weight, target)
            moved = np.append(np.full(weight, np.inf), best[: target + 1 - weight] + cost)
            came = np.arange(target + 1) - weight
            came[target] = target - weight + int(best[target - weight :].argmin())  # what goes past the target counts as it
            moved[target] = best[came[target]] + cost
            better = moved < after
            after[better], choice[better], before[better] = moved[better], t, came[better]
        steps.append((choice, before))
        best = after
    at, chosen = target, []
    for choice, before in reversed(steps):
        chosen.append(int(choice[at]))
        at = int(before[at])
    return float(best[target]), chosen[::-1]


def plan_exact(n: int, both: np.ndarray, distance: int) -> Parts:
    """(bits, threshold) of the parts that are searched: two classes within the distance meet."""
    n = max(n, 1)  # else every threshold would cost nothing
    p, choices = np.diag(both) / n, []
    for m in range(min(2, distance + 1), distance + 2):
        groups = group_bits(n, both, m)
        options = [[(c, t + 1) for t, c in enumerate(costs(g, n, p, distance))] for g in groups]
        cost, thresholds = allocate(options, distance + 1)
        choices.append((cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(choices, key=lambda x: x[0])[1]


def share_of_bits(similarity: float) -> float:
    """Expected share of differing bits of two texts of a Jaccard similarity: the angle between their shingle sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def within(bits: int, share: float, most: int) -> float:
    """The probability that at most so many of the bits differ."""
    return sum(math.comb(bits, j) * share**j * (1 - share) ** (bits - j) for j in range(most + 1))


def limit_of(similarity: float, words: int, probability: float = WITHIN) -> int:
    """The number of bits that two texts of the similarity keep to with the probability."""
    return next(d for d in range(64 * words + 1) if within(64 * words, share_of_bits(similarity), d) >= probability)


def plan_recall(n: int, both: np.ndarray, similarity: float, recall: float) -> Parts:
    """(bits, threshold) of the parts that are searched: two texts of the similarity meet with probability recall."""
    n, share, scale = max(n, 1), share_of_bits(similarity), 2000
    p, choices = np.diag(both) / n, []
    for width in range(8, 41, 2):
        m = len(both) // width
        weigh = lambda g, t: int(scale * math.log1p(-min(within(len(g), share, t), 1 - 1e-9)) / math.log1p(-recall))  # noqa: B023, E731
        each = weigh(range(width), 0) * m
        rounds = -(-scale // each) + 1 if each else 0
        if not 0 < rounds * m <= 1000:
            continue
        groups = [g for deal in range(rounds) for g in group_bits(n, both, m, deal)]
        options = [[(c, weigh(g, t)) for t, c in enumerate(costs(g, n, p, 1))] for g in groups]
        cost, thresholds = allocate(options, scale)
        if cost < np.inf:
            choices.append((cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(choices, key=lambda x: x[0])[1]


# places ---------------------------------------------------------------------------------------------------------------


def _masks(bits: list[int], words: int) -> list[int]:
    """A signed mask of the bits (numbered from the highest of the first word) for each word."""
    out = [sum(1 << (63 - b % 64) for b in bits if b // 64 == w) for w in range(words)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def flips(bits: list[int], most: int, words: int = 1) -> list[list[int]]:
    """The masks that flip up to `most` of the bits, none first."""
    sets, layer = [()], [()]
    for _ in range(most):
        layer = [(*s, b) for s in layer for b in bits if not s or b > s[-1]]
        sets += layer
    return [_masks(list(s), words) for s in sets]


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _place(k: int, bits: list[int], words: int, mask: Column | None = None, salt: Column | None = None) -> Column:
    values = []
    for w, (name, own) in enumerate(zip(names(words), _masks(bits, words), strict=True)):
        if own:
            value = F.col(name).bitwiseAND(_long(own))
            values.append(value if mask is None else value.bitwiseXOR(mask[w]))
    return F.xxhash64(*([] if salt is None else [salt]), F.lit(k), *values)


def _signatures(classes: DataFrame, parts: Parts, words: int) -> DataFrame:
    """place, probe and the fingerprint: each class at its own value of each part, and at those that it probes."""
    own = F.array(*[_place(k, bits, words) for k, (bits, _) in enumerate(parts)])
    out = classes.select(F.explode(own).alias("place"), F.lit(False).alias("probe"), *names(words))
    for k, (bits, threshold) in enumerate(parts):
        if threshold > 0:
            masks = F.array(*[F.array(*map(_long, m)) for m in flips(bits, threshold, words)[1:]])
            spread = classes.select(*names(words), F.explode(masks).alias("mask"))
            out = out.unionByName(spread.select(_place(k, bits, words, F.col("mask")).alias("place"), F.lit(True).alias("probe"), *names(words)))
    return out


def _apart(a: list[Column], b: list[Column]) -> Column:
    """Differing bits."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))


def _forest(values: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever the pairs within the distance connect; two probes are no pair."""
    left, flags, out = values, probe, []
    while len(left):
        queue, left, flags = [(left[0], flags[0])], left[1:], flags[1:]
        while queue and len(left):
            at, probing = queue.pop()
            near = np.bitwise_count(left ^ at).sum(axis=1) <= distance
            if probing:
                near &= ~flags
            if near.any():
                met = left[near]
                out.append((np.repeat(at[None], len(met), axis=0), met))
                queue.extend(zip(met, flags[near], strict=True))
                left, flags = left[~near], flags[~near]
    return out


def _schema(words: int) -> str:
    return ", ".join(f"{side}{k} long" for side in "ab" for k in range(words))


def _verifier(distance: int, place_limit: int, words: int):
    sides = [f"{side}{k}" for side in "ab" for k in range(words)]

    def batch_of(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(a[:, k]).view(np.int64)) for k in range(words)]
        columns += [pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.ascontiguousarray(b[:, k]).view(np.int64)) for k in range(words)]
        return pa.RecordBatch.from_arrays(columns, names=sides)

    def settle(places: np.ndarray, probe: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All rows of some places: small ones by lags, others one by one; (place, null) where there are too many."""
        starts = np.concatenate(([0], np.flatnonzero(np.diff(places)) + 1)) if len(places) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(places)))
        big, out = sizes > 48, []
        for s, n in zip(starts[big].tolist(), sizes[big].tolist(), strict=True):
            if n > place_limit:
                yield batch_of(np.repeat(places[s : s + 1].view(np.uint64)[:, None], words, axis=1), None)
            else:
                out += _forest(values[s : s + n], probe[s : s + n], distance)
        few = np.repeat(~big, sizes)
        p, q, f = places[few], probe[few], values[few]
        for lag in range(1, int(sizes[~big].max()) if (~big).any() else 0):
            met = np.flatnonzero((p[:-lag] == p[lag:]) & ~(q[:-lag] & q[lag:]))
            apart = np.bitwise_count(f[met] ^ f[met + lag]).sum(axis=1)
            met = met[(apart <= distance) & (apart > 0)]
            if len(met):
                out.append((f[met], f[met + lag]))
        if out:
            yield batch_of(np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by place."""
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (
                batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False),
                np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1).view(np.uint64),
            )
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from settle(*[x[:last] for x in rows])
            held = tuple(x[last : last + place_limit + 49].copy() for x in rows)  # more would only be counted
        if held is not None:
            yield from settle(*held)

    return run


def _named(rows: DataFrame, words: int) -> DataFrame:
    """a, b: links by the classes' numbers."""
    of = lambda side: F.col(f"{side}0") if words == 1 else F.xxhash64(*[f"{side}{k}" for k in range(words)])
    return rows.select(of("a").alias("a"), of("b").alias("b"))


def number(words: int) -> Column:
    """A class's number: its fingerprint, or a hash of the longer ones."""
    return F.col("fp") if words == 1 else F.xxhash64(*names(words))


def _met(sent: DataFrame, distance: int, place_limit: int, words: int) -> tuple[DataFrame, DataFrame]:
    """(links, crowded places)."""
    dealt = sent.repartition("place").sortWithinPartitions("place")
    found = cut(dealt.mapInArrow(_verifier(distance, place_limit, words), _schema(words)).distinct())
    return found.where("b0 is not null"), found.where("b0 is null").select(F.col("a0").alias("place"))


def _members(sent: DataFrame, crowded: DataFrame) -> DataFrame:
    few = crowded.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return sent.join(F.broadcast(crowded) if few else crowded, "place", "left_semi")


def links(classes: DataFrame, *, distance: int = DISTANCE, place_limit: int = PLACE_LIMIT) -> DataFrame:
    """a, b: links between fingerprints of the column fp (distinct) that connect what the distance connects. Even distances only."""
    if distance % 2:
        raise ValueError("midpoints need an even distance")
    sent = _signatures(classes, plan_exact(*bit_statistics(classes), distance), 1)
    near, crowded = _met(sent, distance, place_limit, 1)
    if crowded.isEmpty():
        return _named(near, 1)
    masks = F.array(*[_long(m[0]) for m in flips(list(range(64)), distance // 2)])
    members = _members(sent, crowded).select("fp").distinct()
    through = members.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("middle"))
    leads = through.groupBy("middle").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").select("middle", "b")
    return _named(near, 1).unionByName(through.join(leads, "middle").select(F.col("fp").alias("a"), "b").where("a <> b").distinct())


def copy_links(classes: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL, words: int = WORDS, limit: int | None = None, place_limit: int = PLACE_LIMIT) -> DataFrame:
    """a, b: links between the numbers of fingerprints (distinct) that differ in at most limit bits; see the module's text."""
    limit = limit_of(similarity, words) if limit is None else limit
    parts, own = plan_recall(*bit_statistics(classes, words), similarity, recall), names(words)
    sent = _signatures(classes, parts, words)
    near, crowded = _met(sent, limit, place_limit, words)
    out = _named(near, words)
    if crowded.isEmpty():
        return out
    # chunks of a crowded place, of a quarter of place_limit rows or about that; a task compares two of them
    members = cut(_members(sent, crowded).select("place", "probe", *own))
    chunks = members.groupBy(F.col("place").alias("_place")).agg(F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) * 4 / place_limit)).cast("int").alias("m"))
    few = crowded.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    dealt = members.join(F.broadcast(chunks) if few else chunks, F.col("place") == F.col("_place")).withColumn("c", F.pmod(F.xxhash64(F.lit("chunk"), *own), F.col("m")))
    others = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).where("o <> c")  # two of one chunk meet with any other
    paired = others.select(F.xxhash64("place", F.least("c", "o"), F.greatest("c", "o")).alias("place"), "probe", *own)
    return out.unionByName(_named(_met(paired, limit, ALL_ROWS, words)[0], words))


# components -----------------------------------------------------------------------------------------------------------


def _rooted(prints: DataFrame, words: int, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, tag, the fingerprint and component_id of each row of prints; find: classes to links."""
    own = names(words)
    classes = cut(prints.groupBy(*own).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).withColumn("class", number(words)))
    roots = components(find(classes))
    rooted = classes.select("class", "first_id", "n").join(roots.withColumnRenamed("node", "class"), "class", "left")
    joined = rooted.where("root is not null")
    firsts = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    alone = rooted.where("root is null").select("class", F.col("first_id").alias("component_id"), "n", F.col("class").alias("root"))
    homes = cut(alone.unionByName(joined.join(firsts, "root").select("class", "component_id", "n", "root")))
    return join_spread(prints.withColumn("class", number(words)), homes, "class", "n", keys=homes.count()).select("doc_id", "tag", *own, "root", "component_id")


def near_duplicates(docs: DataFrame, *, distance: int = DISTANCE, shingle: int = SHINGLE, place_limit: int = PLACE_LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tag, fp, root, component_id for each row of docs: components of fingerprints within the distance."""
    prints = fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle)
    return _rooted(prints, 1, lambda classes: links(classes, distance=distance, place_limit=place_limit))


def near_copies(docs: DataFrame, *, similarity: float = SIMILARITY, shingle: int = COPY_SHINGLE, words: int = WORDS, recall: float = RECALL, place_limit: int = PLACE_LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tag, fp0 to fp3, root, component_id for each row of docs: components of texts of about the similarity or more."""
    prints = fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, words=words)
    return _rooted(prints, words, lambda classes: copy_links(classes, similarity=similarity, recall=recall, words=words, place_limit=place_limit))


def one_of_each(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of docs but one of each component: that of the smallest doc_id, then of the least text hash.

    found: what near_duplicates or near_copies give for docs. The texts are shuffled only where the list of the rows
    that go, or of those that are repeated, is too long to be broadcast."""
    found = cut(found.select("doc_id", "tag", "root"))
    named = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    kept = found.groupBy("root").agg(first.alias("best")).select(named(F.col("best.doc_id")).alias("id"), F.col("best.tag").alias("tag"), F.lit(True).alias("stays"))
    each = found.groupBy(named(F.col("doc_id")).alias("id"), "tag").agg(F.count(F.lit(1)).alias("n"))
    marked = cut(each.join(kept, ["id", "tag"], "left").where("stays is null or n > 1").select("id", "tag", F.coalesce("stays", F.lit(False)).alias("stays")))
    few = marked.limit(max_broadcast + 1).count() <= max_broadcast
    side = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    rows = docs.select(named(F.col(doc_id)).alias("id"), F.xxhash64(text).alias("tag"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(side(marked.select("id", "tag")), ["id", "tag"], "left_anti").select("row.*")
    repeated = marked.where("stays").select("id", "tag")
    if repeated.isEmpty():
        return out
    once = rows.join(side(repeated), ["id", "tag"], "left_semi").groupBy("id", "tag").agg(F.first("row").alias("row"))
    return out.unionByName(once.select("row.*"))
