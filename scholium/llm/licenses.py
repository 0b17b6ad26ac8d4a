"""License notices: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Words are runs of letters and digits in lower case (bytes from 0x80 up count as letters); shingles are five words.
Each template has a level: windows of the smallest power of two of shingles whose half holds 1.25 times the
template's shingles, at strides of half a window. A copy of the template then lies in one window, and with a
containment of 0.8 their Jaccard similarity is 0.8 / 5.2 = 0.15 at least. With 48 bands of one row the chance to
miss such a window is below (1 - 0.15) ** 48 = 0.0004. A level has one table from (band, minimum) to templates, in
which windows look their minima up, those that a row of bits does not rule out; so retrieval costs the same for any
number of templates. A window that meets a template in a band is verified: the share of the template's shingles, compared
as words, that occur in the window must reach the threshold.

Defined cases: null, empty and wordless texts, and those of fewer than five words, have no notice. Repeated rows each
give a row. Templates of fewer than five words are refused; without templates nothing is found. Columns that carry an output's name are replaced, all
others are kept. Long texts are read whole, piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_arrow_columns
from .license_texts import NOTICES, TEXTS

SHINGLE = 5
BANDS = 48
CONTAINMENT = 0.8
#: Shingles in the smallest windows' strides.
STRIDE = 4
PIECE = 1 << 16
#: Bits of a minimum by which windows are ruled out before the table of bands is asked.
LOW_BITS = 18

#: What is looked for where nothing else is given.
TEMPLATES = NOTICES | TEXTS

FIELDS = T.StructType(
    [
        T.StructField("licenses", T.ArrayType(T.StringType())),
        T.StructField("notices", T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())]))),
    ]
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_rng = np.random.default_rng(20240229)
_AT = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_A = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_B = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_BAND_ROWS = np.arange(BANDS, dtype=np.uint32) << np.uint32(LOW_BITS)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words_of(lowered: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words. Equal words have equal hashes."""
    data = np.frombuffer(lowered, np.uint8)
    inside = _IS_WORD[data]
    turns = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    at = np.arange(len(data)) - np.repeat(np.append(starts, len(data)), np.diff(np.concatenate(([0], starts[1:], [len(data)]))).tolist() + [0])
    spread = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _AT[at & 63], np.uint64(0))
    return starts, ends, _stir(np.add.reduceat(spread, starts) + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        total += words[k : k + n] * _MIX[k]
    return _stir(total)


def _minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(groups, bands): the least band value of each group of shingles that begins at starts."""
    out = np.empty((len(starts), BANDS), np.uint32)
    for k in range(BANDS):
        out[:, k] = np.minimum.reduceat(((values * _BAND_A[k] + _BAND_B[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


class Matcher:
    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        self.containment = containment
        self.names = sorted(templates)
        self.shingles: list[set[tuple[bytes, ...]]] = []
        levels: dict[int, list[int]] = {}  # windows' shingles -> templates
        minima = []
        for k, name in enumerate(self.names):
            lowered = templates[name].encode().lower()
            words = _WORD.findall(lowered)
            if len(words) < SHINGLE:
                raise ValueError(f"{name}: a template needs {SHINGLE} words")
            self.shingles.append({tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})
            hashes = shingle_hashes(words_of(lowered)[2])
            minima.append(_minima(hashes, np.array([0]))[0])
            size = 2 * STRIDE
            while size / 2 < 1.25 * len(hashes):
                size *= 2
            levels.setdefault(size, []).append(k)
        self.largest = max(levels, default=0)
        # by level: the templates that have a minimum in a band; and which low bits of minima there are in each band, in
        # one row, so that nearly all windows need no look-up
        self.tables: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.marks: dict[int, np.ndarray] = {}
        for size, own in levels.items():
            table, marks = {}, np.zeros(BANDS << LOW_BITS, bool)
            for k in own:
                for band, value in enumerate(minima[k].tolist()):
                    table.setdefault((band, value), []).append(k)
                    marks[(band << LOW_BITS) + (value & ((1 << LOW_BITS) - 1))] = True
            self.tables[size], self.marks[size] = table, marks

    def find(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(template, first byte, last byte + 1, containment), merged where those of a template overlap."""
        lowered = text.lower()
        starts, ends, words = words_of(lowered)
        hashes = shingle_hashes(words)
        found: dict[int, list[tuple[int, int, float]]] = {}
        step = PIECE - PIECE % max(self.largest, 1)
        for low in range(0, len(hashes) if self.largest else 0, step):  # pieces overlap by a largest window
            part = hashes[low : low + step + self.largest]
            for window, size, template in self._candidates(part):
                hit = self._verify(lowered, starts, ends, low + window, min(size, len(part) - window), template)
                if hit:
                    found.setdefault(template, []).append(hit)
        out = []
        for template, hits in found.items():
            merged: list[tuple[int, int, float]] = []
            for a, b, share in sorted(hits):
                if merged and a < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]), max(share, merged[-1][2]))
                else:
                    merged.append((a, b, share))
            out += [(template, *m) for m in merged]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def _candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first shingle, shingles, template) of the windows that meet a template in a band."""
        if not len(hashes):
            return
        least, size = _minima(hashes, np.arange(0, len(hashes), STRIDE)), 2 * STRIDE
        while size <= self.largest:
            paired = np.minimum(least, np.vstack([least[1:], least[-1:]]))  # windows of two strides
            met = set()
            if size in self.tables:
                rows, bands = np.nonzero(self.marks[size][_BAND_ROWS + (paired & np.uint32((1 << LOW_BITS) - 1))])
                for w, band, value in zip(rows.tolist(), bands.tolist(), paired[rows, bands].tolist(), strict=True):
                    met.update((w, t) for t in self.tables[size].get((band, value), ()))
            for w, template in sorted(met):
                yield w * size // 2, size, template
            least, size = paired[::2], size * 2

    def _verify(self, lowered: bytes, starts: np.ndarray, ends: np.ndarray, first: int, size: int, template: int) -> tuple[int, int, float] | None:
        wanted, last = self.shingles[template], min(first + size + SHINGLE - 1, len(starts))
        words = [lowered[a:b] for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)]
        met = {}
        for i in range(len(words) - SHINGLE + 1):
            s = tuple(words[i : i + SHINGLE])
            if s in wanted:
                met.setdefault(s, i)
        if len(met) < self.containment * len(wanted) - 1e-9:
            return None
        return int(starts[first + min(met.values())]), int(ends[first + max(met.values()) + SHINGLE - 1]), len(met) / len(wanted)


def _scanner(templates: dict[str, str], containment: float) -> Callable[[pa.Array], dict]:
    matcher = Matcher(templates, containment)

    def scan(texts: pa.Array) -> dict:
        licenses, notices = [], []
        for text in texts.cast(pa.binary()).to_pylist():
            found = matcher.find(text) if text else []
            # characters before each byte
            chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))) if found else []
            notices.append([{"license": matcher.names[t], "start": int(chars[a]), "end": int(chars[b]), "containment": share} for t, a, b, share in found])
            licenses.append(sorted({matcher.names[t] for t, *_ in found}))
        return {"licenses": licenses, "notices": notices}

    return scan


def with_licenses(docs: DataFrame, *, text: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep), licenses (sorted names) and notices (spans in characters)."""
    return with_arrow_columns(docs, [text], FIELDS, _scanner, TEMPLATES if templates is None else templates, containment, keep=keep)
