"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words go into windows that overlap, those of more than WORD_BYTES bytes in overlapping parts, so that a text
without spaces is read whole; all windows are scored and the text's score comes from its highest window. A word's input has a word part (an embedding of the sample's frequent words, and their log-odds of standing in
toxic documents) and a character part (the mean of embeddings of its character 3- to 6-grams, with the mean and the
highest of their log-odds). Two gated recurrent units read a window in both directions; attention over their states
gives its logit.

The sample: at most `sample` labelled documents of either label, the first by a hash of their id, of at most
SAMPLE_CHARS characters. Half of it gives the vocabulary and the log-odds, of the other half most trains the network
(on each document's two windows of the most evidence, and two others of those that are not toxic), and the rest
calibrates the score: a logistic curve over the highest window's logit and the number of windows, moved to the share
of toxic documents among all labels that may be used. Everything is seeded, so equal samples give equal networks.

Defined cases: null, empty and wordless texts get the score of a window without words. Repeated rows each give a row;
repeated labels count once (the highest). Null labels and labels without a document teach nothing; without both
labels in the sample every score is that label's share. Columns that carry an output's name are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ready
from .common import with_arrow_columns

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
FIXED = 3
DIM = FIXED + WORD_DIM + CHAR_DIM
BUCKETS = 1 << 16
#: Bytes of an input, a word's two marks included; longer words are cut into parts, which share OVERLAP bytes so that
#: every gram is in one of them. GRAMS is how many grams an input has at most.
WORD_BYTES, OVERLAP = 22, 5
GRAMS = sum(WORD_BYTES - k + 1 for k in (3, 4, 5, 6))
VOCABULARY = 20_000
SAMPLE, SAMPLE_CHARS = 3000, 20_000
STEPS, BATCH, RATE = 500, 128, 0.02
#: Words whose projections a task remembers; 350 bytes each are 90 MB.
CACHE_WORDS = 250_000
CHUNK = 2048

_words = re.compile(r"\w+").findall


def _coded(word: str) -> bytes:
    """The bytes of an input: ^word$, or a part of that."""
    return word[1:].encode("latin-1") if word[:1] == "\0" else f"^{word}$".encode("utf-8", "surrogatepass")


def parts_of(word: str) -> list[str]:
    """The word, or the parts of a long one: their bytes as characters after a zero, which no word has."""
    coded = _coded(word)
    if len(coded) <= WORD_BYTES:
        return [word]
    return ["\0" + coded[k : k + WORD_BYTES].decode("latin-1") for k in range(0, len(coded) - OVERLAP, WORD_BYTES - OVERLAP)]


def words_of(text: str | None) -> list[str]:
    """The words of a text, long ones in parts."""
    words = _words(text.lower()) if text else []
    most, sure = WORD_BYTES - 2, (WORD_BYTES - 2) // 4
    if not words or max(map(len, words)) <= (most if text.isascii() else sure):
        return words
    out = []
    for w in words:
        if len(w) <= sure or (len(w) <= most and w.isascii()):
            out.append(w)
        else:
            out += parts_of(w)
    return out


_POWERS = np.array([1, 0x01000193, 0x5BD1E995, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)


def _buckets(data: np.ndarray, k: int) -> np.ndarray:
    """Of the k-grams along the last axis of bytes, from 1."""
    n = data.shape[-1] - k + 1
    total = sum(data[..., j : j + n] * _POWERS[j] for j in range(k)) + np.uint64(k)
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((total >> np.uint64(32)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def grams_of(words: list[str]) -> np.ndarray:
    """(words, GRAMS): buckets of the character 3- to 6-grams of ^word$ or of a part of it, 0 for none."""
    coded = [_coded(w) for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    out = np.zeros((len(words), GRAMS), np.int64)
    data = np.frombuffer(b"".join([c.ljust(WORD_BYTES, b"\0") for c in coded]), np.uint8).reshape(len(words), WORD_BYTES).astype(np.uint64)
    at = 0
    for k in (3, 4, 5, 6):
        n = WORD_BYTES - k + 1
        out[:, at : at + n] = _buckets(data, k) * (np.arange(n) + k <= sizes[:, None])
        at += n
    return out


def windows_of(n: int) -> list[tuple[int, int]]:
    return [(a, min(a + WINDOW, n)) for a in range(0, max(n - WINDOW + STRIDE, 1), STRIDE)] if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Tables and weights; see the module's text."""

    def __init__(self, vocabulary: dict[str, int], word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        self.vocabulary, self.word_odds, self.gram_odds = vocabulary, word_odds.astype(np.float32), gram_odds.astype(np.float32)
        self.tables = {"words": init(len(vocabulary) + 1, WORD_DIM, s=0.1), "grams": init(BUCKETS, CHAR_DIM, s=0.1)}
        self.tables["words"][0] = 0
        self.weights = {"v": init(2 * HIDDEN), "w": init(2 * HIDDEN), "b": np.full(1, -1, np.float32)}
        for d in "fb":
            self.weights |= {f"W{d}": init(DIM, 3 * HIDDEN), f"U{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.curve = (1.0, 0.0, 0.0)  # of the highest logit, of the log of the number of windows, and added

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of words, their rows in the vocabulary, and their gram buckets (padded by 0)."""
        rows, grams = np.array([self.vocabulary.get(w, 0) for w in words], np.int64), grams_of(words)
        return self.vectors(rows, grams), rows, grams

    def vectors(self, rows: np.ndarray, grams: np.ndarray) -> np.ndarray:
        some = grams > 0
        n = np.maximum(some.sum(axis=1), 1)[:, None].astype(np.float32)
        odds = self.gram_odds[grams]
        fixed = np.stack([self.word_odds[rows], np.where(some, odds, -3).max(axis=1), odds.sum(axis=1) / n[:, 0]], axis=1)
        return np.concatenate([fixed, self.tables["words"][rows], (self.tables["grams"][grams] * some[:, :, None]).sum(axis=1) / n], axis=1).astype(np.float32)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """(words, 6 * HIDDEN): what both directions' gates get from the words."""
        return np.concatenate([vectors @ self.weights[f"W{d}"] + self.weights[f"c{d}"] for d in "fb"], axis=1)

    def logits(self, projections: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Of windows given as rows of projections, -1 where a window is over."""
        n, length = index.shape
        over = index < 0
        attention, value = np.zeros((n, length), np.float32), np.zeros((n, length), np.float32)
        for k, d in enumerate("fb"):
            u, half = self.weights[f"U{d}"], slice(k * HIDDEN, (k + 1) * HIDDEN)
            v, w = self.weights["v"][half], self.weights["w"][half]
            x_all = projections[:, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                x, y = x_all[index[:, t]], h @ u
                gates = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])))
                z = gates[:, :HIDDEN]
                new = 2 / (1 + np.exp(-2 * (x[:, 2 * HIDDEN :] + gates[:, HIDDEN:] * y[:, 2 * HIDDEN :]))) - 1
                new += z * (h - new)
                gone = over[:, t]
                h = np.where(gone[:, None], h, new) if gone.any() else new
                attention[:, t] += h @ v
                value[:, t] += h @ w
        attention[over] = -1e4
        attention = np.exp(attention - attention.max(axis=1, keepdims=True))
        return (attention * value).sum(axis=1) / attention.sum(axis=1) * ~over[:, 0] + self.weights["b"][0]

    def gradient(self, x: np.ndarray, over: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss and gradients by the weights and by the inputs x (windows, words, DIM)."""
        n, length, _ = x.shape
        kept, states = {}, {}
        for d in "fb":
            u = self.weights[f"U{d}"]
            xs = x @ self.weights[f"W{d}"] + self.weights[f"c{d}"]
            h, trail, out = np.zeros((n, HIDDEN), np.float32), [], np.zeros((n, length, HIDDEN), np.float32)
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                y = h @ u
                gates = _sigmoid(xs[:, t, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(xs[:, t, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
                after = np.where(over[:, t, None], h, (1 - z) * new + z * h)
                trail.append((t, h, z, r, new, y[:, 2 * HIDDEN :]))
                h = out[:, t] = after
            kept[d], states[d] = trail, out
        both = np.concatenate([states["f"], states["b"]], axis=2)
        a = np.where(over, -1e4, both @ self.weights["v"])
        a = np.exp(a - a.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        value = both @ self.weights["w"]
        pooled = (a * value).sum(axis=1)
        p = _sigmoid(pooled + self.weights["b"][0])
        loss = -np.mean(labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))
        d_out = ((p - labels) / n).astype(np.float32)
        d_value, d_att = a * d_out[:, None], a * (value - pooled[:, None]) * d_out[:, None]
        grads = {"b": np.array([d_out.sum()]), "v": np.einsum("nt,nth->h", d_att, both), "w": np.einsum("nt,nth->h", d_value, both)}
        d_both = d_att[:, :, None] * self.weights["v"] + d_value[:, :, None] * self.weights["w"]
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, weight = self.weights[f"U{d}"], self.weights[f"W{d}"]
            d_u, d_w, d_c, d_h = np.zeros_like(u), np.zeros_like(weight), np.zeros(3 * HIDDEN, np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, new, un in reversed(kept[d]):
                d_h = d_h + d_both[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                live = ~over[:, t, None]
                g = d_h * live
                d_n = g * (1 - z) * (1 - new * new)
                d_z = g * (h - new) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_n], axis=1)
                d_y = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_u += h.T @ d_y
                d_w += x[:, t].T @ d_gate
                d_c += d_gate.sum(axis=0)
                d_x[:, t] += d_gate @ weight.T
                d_h = np.where(live, g * z + d_y @ u.T, d_h)
            grads |= {f"U{d}": d_u, f"W{d}": d_w, f"c{d}": d_c}
        return float(loss), grads, d_x

    def train(self, windows: list[list[str]], labels: np.ndarray, *, steps: int = STEPS, seed: int = 11) -> None:
        """Adam for the weights, Adagrad for the tables' rows that a batch has."""
        rng = np.random.default_rng(seed)
        distinct = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for ws in windows for w in ws))}
        _, rows, grams = self.inputs(["", *distinct])
        index = np.zeros((len(windows), WINDOW), np.int64)
        for k, ws in enumerate(windows):
            index[k, : len(ws)] = [distinct[w] for w in ws]
        moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in self.weights.items()}
        squares = {k: np.full(len(t), 1e-4, np.float32) for k, t in self.tables.items()}
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(windows), BATCH)
            used, back = np.unique(index[chosen], return_inverse=True)
            vectors = self.vectors(rows[used], grams[used])
            back = back.reshape(BATCH, WINDOW)
            _, grads, d_x = self.gradient(vectors[back], index[chosen] == 0, labels[chosen])
            rate = RATE * (1 - step / (steps + 1))
            for name, g in grads.items():
                m, s = moments[name]
                m[:] = 0.9 * m + 0.1 * g
                s[:] = 0.99 * s + 0.01 * g * g
                self.weights[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            d_word = np.zeros((len(used), DIM), np.float32)
            np.add.at(d_word, back.ravel(), d_x.reshape(-1, DIM))
            own, some = grams[used], grams[used] > 0
            share = d_word[:, None, FIXED + WORD_DIM :] * (some / np.maximum(some.sum(axis=1), 1)[:, None])[:, :, None]
            for name, at, g in (("words", rows[used], d_word[:, FIXED : FIXED + WORD_DIM]), ("grams", own[some], share[some])):
                each, inverse = np.unique(at, return_inverse=True)
                total = np.zeros((len(each), g.shape[1]), np.float32)
                np.add.at(total, inverse, g)
                squares[name][each] += (total * total).sum(axis=1)
                self.tables[name][each] -= (0.05 * total / np.sqrt(squares[name][each])[:, None]).astype(np.float32)
            self.tables["words"][0] = 0


class Scorer:
    """Scores texts, and remembers at most CACHE_WORDS words."""

    def __init__(self, network: Network):
        self.network, self.known = network, {}
        self.rows = np.zeros((0, 6 * HIDDEN), np.float32)

    def _index(self, words: list[str]) -> list[int]:
        get = self.known.get
        index = [get(w, -1) for w in words]
        if -1 in index:
            fresh = [w for w in dict.fromkeys(words) if w not in self.known]
            if len(self.known) + len(fresh) > CACHE_WORDS:
                self.known, self.rows, fresh = {}, self.rows[:0], list(dict.fromkeys(words))
            parts = [self.network.projected(self.network.inputs(fresh[k : k + 4096])[0]) for k in range(0, len(fresh), 4096)]
            base = len(self.known)
            self.known.update((w, base + k) for k, w in enumerate(fresh))
            self.rows = np.concatenate([self.rows, *parts])
            index = [self.known[w] for w in words]
        return index

    def best(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window's logit and the number of windows of each text, given as words."""
        flat = [w for ws in texts for w in ws]
        sizes = np.array([len(ws) for ws in texts], np.int64)
        best, counts = np.full(len(texts), self.network.weights["b"][0], np.float64), np.zeros(len(texts), np.int64)
        if not flat:
            return best, counts
        index = np.array(self._index(flat), np.int64)
        counts = np.where(sizes > 0, np.maximum(-(-(sizes - WINDOW + STRIDE) // STRIDE), 1), 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        order = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (np.cumsum(sizes) - sizes)[owner] + order * STRIDE
        ends = np.minimum(starts + WINDOW, np.cumsum(sizes)[owner])
        logits = np.empty(len(owner))
        for k in range(0, len(owner), CHUNK):
            at = starts[k : k + CHUNK, None] + np.arange(WINDOW)
            past = at >= ends[k : k + CHUNK, None]
            rows = np.where(past, -1, index[np.minimum(at, len(index) - 1)])
            logits[k : k + CHUNK] = self.network.logits(self.rows, rows)
        some = counts > 0
        best[some] = np.maximum.reduceat(logits, (np.cumsum(counts) - counts)[some])
        return best, counts

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        # about a million words at a time; a longer text goes by itself
        group, size, first = [], 0, 0
        for k, t in enumerate([*texts, None]):
            if group and (k == len(texts) or size > 300_000):
                best, counts = self.best(group)
                a, c, b = self.network.curve
                out[first:k] = _sigmoid(a * best + c * np.log(np.maximum(counts, 1)) + b)
                group, size, first = [], 0, k
            if k < len(texts):
                group.append(words_of(t))
                size += len(group[-1])
        return out


def _odds(counts: list[Counter], totals: list[int], least: int) -> dict:
    """Log-odds by item of counts[1] against counts[0], shrunk, of what is in `least` documents or more."""
    out = {}
    for item in counts[0].keys() | counts[1].keys():
        p, n = counts[1][item], counts[0][item]
        if p + n >= least:
            out[item] = float(np.clip(np.log((p + 0.5) / (totals[1] + 1)) - np.log((n + 0.5) / (totals[0] + 1)), -3, 3))
    return out


def train(texts: list[str], labels: list[int], share: float, *, steps: int = STEPS) -> Network:
    """share: of toxic documents among all that are labelled."""
    docs = [words_of(t) for t in texts]
    known = [k for k in range(len(docs)) if k % 2 == 0] if len(docs) > 200 else list(range(len(docs)))
    rest = [k for k in range(len(docs)) if k % 2 == 1] if len(docs) > 200 else known
    counts, gram_counts, totals = [Counter(), Counter()], np.zeros((2, BUCKETS)), [0, 0]
    for k in known:
        distinct = sorted(set(docs[k]))
        counts[labels[k]].update(distinct)
        if distinct:
            gram_counts[labels[k], np.unique(grams_of(distinct))] += 1
        totals[labels[k]] += 1
    odds = _odds(counts, totals, 3)
    frequent = sorted(odds, key=lambda w: (-(counts[0][w] + counts[1][w]), w))[:VOCABULARY]
    odds_of = lambda n, total: np.log((n + 0.5) / (total + 1))
    gram_odds = np.clip(odds_of(gram_counts[1], totals[1]) - odds_of(gram_counts[0], totals[0]), -3, 3)
    gram_odds[(gram_counts.sum(axis=0) < 4) | (np.arange(BUCKETS) == 0)] = 0
    network = Network({w: k + 1 for k, w in enumerate(frequent)}, np.array([0.0, *[odds[w] for w in frequent]]), gram_odds)
    if min(totals) == 0 or not {labels[k] for k in rest} == {0, 1}:
        network.curve = (0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 20.0 * (1 if share else -1))
        return network
    fitted, held = (rest, rest) if len(rest) < 100 else ([k for j, k in enumerate(rest) if j % 4], [k for j, k in enumerate(rest) if j % 4 == 0])
    rng = np.random.default_rng(3)
    evidence: dict[str, float] = {}
    chosen, marks = [], []
    for k in fitted:
        fresh = sorted(set(docs[k]) - evidence.keys())
        if fresh:
            tops = gram_odds[grams_of(fresh)].max(axis=1).tolist()
            evidence.update((w, max(odds.get(w, 0.0), top)) for w, top in zip(fresh, tops, strict=True))
        values = np.array([max(evidence[w] - 1, 0) ** 2 for w in docs[k]])
        spans = windows_of(len(docs[k]))
        by = sorted(range(len(spans)), key=lambda s: -values[spans[s][0] : spans[s][1]].sum())
        picked = by[:2] if not labels[k] else by[:1]
        if not labels[k] and len(by) > 2:
            picked += rng.choice(by[2:], min(2, len(by) - 2), replace=False).tolist()
        for s in picked:
            chosen.append(docs[k][spans[s][0] : spans[s][1]])
            marks.append(labels[k])
    if chosen:
        network.train(chosen, np.array(marks, np.float32), steps=steps)
    _calibrate(network, [docs[k] for k in held], np.array([labels[k] for k in held]), share)
    return network


def _calibrate(network: Network, docs: list[list[str]], labels: np.ndarray, share: float) -> None:
    best, counts = Scorer(network).best(docs)
    x = np.stack([best, np.log(np.maximum(counts, 1)), np.ones(len(docs))], axis=1)
    prior, ridge = np.array([1.0, 0.0, 0.0]), np.diag([0.05, 0.5, 0.01])

    def loss(theta: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(labels == 1, -1, 1) * (x @ theta)).sum() + (theta - prior) @ ridge @ (theta - prior) / 2)

    theta = prior
    for _ in range(50):  # Newton's method, each step halved until it helps
        p = _sigmoid(x @ theta)
        grad = x.T @ (p - labels) + ridge @ (theta - prior)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
        while loss(theta - move) > loss(theta) and np.abs(move).max() > 1e-9:
            move = move / 2
        theta = theta - move
    here = labels.mean()
    shift = np.log(share / (1 - share)) - np.log(here / (1 - here)) if 0 < share < 1 and 0 < here < 1 else 0.0
    network.curve = (float(max(theta[0], 0.05)), float(theta[1]), float(theta[2] + shift))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, steps: int = STEPS) -> Network:
    """A network for the labelled documents for which usable (over the labels' columns) holds."""
    ready(docs.sparkSession)
    rows = labels.where(usable & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    counted = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = F.xxhash64("id", F.lit("toxicity"))
    ids = [rows.where(F.col("label") == k).orderBy(by_hash, "id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # 2 * sample ids at most
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    found = plain.join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    found = sorted(found, key=lambda r: zlib.crc32(str(r["id"]).encode()))
    total = sum(counted.values())
    return train([r["text"] for r in found], [r["label"] for r in found], counted.get(1, 0) / total if total else 0.0, steps=steps)


def _scoring(network: Broadcast) -> Callable[[pa.Array], dict]:
    scorer = Scorer(network.value)
    return lambda texts: {"score": scorer.scores(texts.to_pylist())}


def with_scores(docs: DataFrame, network: Network, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) and score."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # about 3 MB
    return with_arrow_columns(docs, [text], T.StructType([T.StructField("score", T.DoubleType())]), _scoring, shared, keep=keep)
