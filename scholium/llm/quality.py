"""Quality rules, line by line first: lines that fail a rule go, then documents that lost too much go.

A line fails if it is navigation (three bars or more), unpunctuated (under eight words and no ending mark, as menus,
buttons and headings are), symbol-laden (over three symbols for ten words), shouted (over half of its characters are
capitals), stuttered (over half of ten words or more equal the word before), boilerplate (a phrase of web pages, in
English, German, French or Spanish) or equal to an earlier line. Lines without words neither fail nor count.

Defined cases: null is as empty; a document without words fails the base rules. Repeated rows each give a row.
Columns that carry an output's name are replaced, all others are kept. Texts of any length are read whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow_columns

MIN_WORDS = 50
#: Documents that lose a larger share of their words are rejected.
MAX_LOST = 0.5
#: Phrases of web pages, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "accept cookies", "subscribe to our newsletter", "sign in to continue",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "newsletter abonnieren", "javascript aktivieren",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "conditions d’utilisation", "accepter les cookies", "inscrivez-vous à notre newsletter", "activer javascript",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "términos de servicio", "aceptar cookies", "suscríbete a nuestro", "activar javascript",
)
#: Lines of fewer words need an ending mark.
UNPUNCTUATED = 8
ENDINGS = ".!?:;,)\"'…。！？：；，）»”’"
SYMBOLS = "#*$%&|<>"

SPACE, SYMBOL, UPPER, BAR = 1, 2, 4, 8
_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """By code point; made once in each process."""
    if not _table:
        table = np.zeros(0x110000, np.uint8)
        for c in [0x20, *range(9, 14)]:
            table[c] |= SPACE
        for c in SYMBOLS:
            table[ord(c)] |= SYMBOL
        table[ord("|")] |= BAR
        for c in range(0x1F000):
            if unicodedata.category(chr(c)) == "Lu":
                table[c] |= UPPER
        _table.append(table)
    return _table[0]


FIELDS = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())]
)


def judge(text: str, max_lost: float = MAX_LOST, min_words: int = MIN_WORDS) -> tuple:
    """The values of FIELDS."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _classes()[codes]
    space = (kinds & SPACE) != 0
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    n, word_chars, n_symbols = len(starts), int((~space).sum()), int(((kinds & SYMBOL) != 0).sum())
    lines = text.split("\n")
    breaks = np.flatnonzero(codes == 10)
    first = np.concatenate(([0], breaks + 1))  # of each line
    line_of = np.searchsorted(breaks, starts)
    line_words = np.bincount(line_of, minlength=len(lines))
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in text.encode("utf-8", "surrogatepass").split()], np.int64)
    per_line = lambda marks: np.diff(np.concatenate(([0], np.cumsum(marks)))[np.append(first, len(codes))])
    symbols, uppers, bars, filled = (per_line(x) for x in ((kinds & SYMBOL) != 0, (kinds & UPPER) != 0, (kinds & BAR) != 0, ~space))
    same = np.zeros(len(lines), np.int64)
    if n > 1:
        again = (ids[1:] == ids[:-1]) & (line_of[1:] == line_of[:-1])
        same = np.bincount(line_of[1:][again], minlength=len(lines))
    bad = (bars >= 3) | (10 * symbols > 3 * line_words) | (2 * uppers > filled) | ((line_words >= 10) & (2 * same > line_words))
    seen: set[str] = set()
    n_dup = 0
    for k in np.flatnonzero(line_words).tolist():
        line = lines[k]
        if line in seen:
            n_dup += 1
            bad[k] = True
        seen.add(line)
        if line_words[k] < UNPUNCTUATED and line.rstrip("\t\n\x0b\f\r ")[-1:] not in ENDINGS:
            bad[k] = True
    if _boilerplate(text):
        for k in range(len(lines)):
            bad[k] |= _boilerplate(lines[k])
    bad &= line_words > 0
    lost = int(line_words[bad].sum())
    repeated = _repeated(ids, len(known))
    failed = n < min_words or 100 * repeated > 50 * n
    kept = not failed and lost <= max_lost * n
    clean = text if not lost else "\n".join(x for x, b in zip(lines, bad.tolist(), strict=True) if not b)
    return n, word_chars, n_symbols, n_dup, repeated, lost, failed, kept, clean


def _boilerplate(text: str) -> bool:
    low = text.lower()
    return any(phrase in low for phrase in BOILERPLATE)


def _repeated(ids: np.ndarray, size: int) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * size + ids[1:]
    if size < 2_000_000:
        keys = pairs[:-1] * size + ids[2:]
    else:  # the product of three would not fit
        keys = np.unique(pairs, return_inverse=True)[1][:-1] * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    equal = np.diff(keys[order]) == 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= twice
    return int(covered.sum())


def _judge_all(max_lost: float, min_words: int) -> Callable[[pa.Array], dict]:
    def run(texts: pa.Array) -> dict:
        rows = [judge(t or "", max_lost, min_words) for t in texts.to_pylist()]
        return {f.name: [r[k] for r in rows] for k, f in enumerate(FIELDS)}

    return run


def with_quality(docs: DataFrame, *, text: str = "text", max_lost: float = MAX_LOST, min_words: int = MIN_WORDS, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) and the columns of FIELDS."""
    return with_arrow_columns(docs, [text], FIELDS, _judge_all, max_lost, min_words, keep=keep)


def clean(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The kept rows of docs with their cleaned texts; the columns of docs stay, also those named like FIELDS."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0)]).alias("row"), F.col(text).alias("text"))
    kept = with_quality(rows, keep=["row"], **options).where("kept")
    return kept.select(*[F.col("clean_text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
