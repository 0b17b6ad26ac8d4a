"""Benchmark decontamination, in DataFrame operations only.

The windows (n-grams) of the benchmark form a hash table that is broadcast; every window of every training
text probes it by a 64-bit hash, and a hit counts only where the words are equal. The table is broadcast
in slices of a checked number of bytes, one scan for each slice, so its size never grows past the bound. It has no
items: a window names its set of items, and the sets are joined to the texts that were hit.

Defined cases: a null or wordless text has no words and no hits. An item without words has no window; an
item of fewer words than the window length is one window of all its words. Items whose id is null make hits
but are not listed. Repeated rows of documents each give a row; repeated items count once. Further columns
of either table are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: Characters of words in lower-cased texts, and pieces (words or what is between) of texts in any case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bytes of windows (their words, and ROW_BYTES for each) in one broadcast table, if no single window has more.
MAX_BROADCAST = 128 << 20
ROW_BYTES = 64


def words_of(text: Column) -> Column:
    found = F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """length, hash, words and items of each distinct window, and item_set, which tells sets of items apart."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    sized = words.select("item", "words", F.least(F.size("words"), F.lit(window)).alias("length"))
    starts = sized.select("item", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("start"))
    rows = starts.select("item", "length", F.slice("words", F.col("start"), F.col("length")).alias("gram")).distinct()
    grams = rows.groupBy("length", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hashed = grams.withColumn("hashes", F.transform("gram", lambda w: F.xxhash64(w)))
    item_set = F.sha2(F.to_json("items"), 256)
    return hashed.select("length", _window_hash("hashes", F.lit(0), F.col("length"), window).alias("hash"), F.concat_ws(" ", "gram").alias("words"), "items", item_set.alias("item_set"))


def _window_hash(hashes: str, at: Column, length: Column, window: int) -> Column:
    """Of length word hashes from position at (0: first). Words past the length count as absent."""
    parts = [F.when(F.lit(j) < length, F.get(hashes, at + j)) for j in range(window)]
    return F.xxhash64(length.cast("int"), *parts)


def _probe(docs: DataFrame, table: DataFrame, lengths: list[int], window: int, all_rows: bool) -> DataFrame:
    """A row for each hit window of each text, and with all_rows one at position -1 for each row of docs."""
    tokens = docs.select("id", "tag", words_of(F.col("text")).alias("words"))
    hashed = tokens.select("id", "tag", "words", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    places = lambda k: F.when(F.col("n") >= k, F.sequence(F.lit(0), F.col("n") - k)).otherwise(F.array().cast("array<int>"))
    # one generator, so that a text's windows meet the table in one loop and never stand beside its words in memory
    if len(lengths) > 1:
        spot = lambda at, k: F.struct(at.alias("at"), k.alias("length"))
        none = F.transform(F.array().cast("array<int>"), lambda at: spot(at, at))
        marks = F.array(spot(F.lit(-1), F.lit(0))) if all_rows else none
        of_length = lambda k: F.transform(places(k), lambda at: spot(at, F.lit(k)))
        spots = F.concat(marks, *map(of_length, lengths))
        spread = hashed.select("id", "tag", "words", "n", "hashes", F.explode(spots).alias("spot")).select("id", "tag", "words", "n", "hashes", "spot.at", "spot.length")
        key = _window_hash("hashes", F.greatest(F.col("at"), F.lit(0)), F.col("length"), window)
    else:
        marks = F.array(F.lit(-1)) if all_rows else F.array().cast("array<int>")
        spread = hashed.select("id", "tag", "words", "n", "hashes", F.explode(F.concat(marks, places(lengths[0]))).alias("at"))
        spread = spread.withColumn("length", F.when(F.col("at") < 0, F.lit(0)).otherwise(F.lit(lengths[0])))
        key = F.xxhash64(F.lit(lengths[0]), *[F.get("hashes", F.col("at") + j) for j in range(lengths[0])])
    probes = spread.select("id", "tag", "words", "n", "at", "length", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(key).alias("hash"))
    if all_rows:
        table = table.unionByName(table.sparkSession.range(1).select(F.lit(0).alias("length"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("words"), F.lit(None).cast("string").alias("item_set")))
    table = table.select(F.col("length").alias("w_length"), F.col("hash").alias("w_hash"), F.col("words").alias("w_words"), "item_set")
    same = (F.col("at") < 0) | (F.col("w_words") == F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.col("length"))))
    met = probes.join(F.broadcast(table), (F.col("hash") == F.col("w_hash")) & (F.col("length") == F.col("w_length")) & same)
    return met.select("id", "tag", "n", "at", "length", "item_set")


def _tag(text: Column) -> Column:
    """Tells texts apart under one id."""
    return F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("m"), F.length(text).alias("n"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST, hits_only: bool = False) -> DataFrame:
    """id, tag, copies, n_words, starts array<struct<at, length>> for each distinct (id, text), and items array<string>.

    copies: how many rows of docs are that row. hits_only: leaves out rows without hits, and the items."""
    table = cut(benchmark_windows(benchmark, window, item_id, item_text))
    lengths = sorted(r[0] for r in table.select("length").distinct().collect())  # at most `window` numbers
    size = table.agg(F.sum(F.octet_length("words") + ROW_BYTES)).first()[0] or 0
    slices = max(1, math.ceil(size / max_broadcast))
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("tag", _tag(F.col("text")))
    grams = table.select("length", "hash", "words", "item_set")
    parts = [_probe(plain, grams.where(F.pmod("hash", F.lit(slices)) == k) if slices > 1 else grams, lengths or [window], window, k == 0 and not hits_only) for k in range(slices)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    hit = F.when(F.col("at") >= 0, F.struct("at", "length"))
    found = rows.groupBy("id", "tag").agg(
        F.sum(F.when(F.col("at") < 0, 1).otherwise(0)).alias("copies"), F.max("n").cast("long").alias("n_words"), F.collect_set(hit).alias("starts"), F.collect_set("item_set").alias("sets")
    )
    return found.drop("sets") if hits_only else _with_items(cut(found), table, max_broadcast)


def _with_items(found: DataFrame, table: DataFrame, max_broadcast: int) -> DataFrame:
    """found with the distinct items of its sets."""
    sets = table.groupBy("item_set").agg(F.first("items").alias("items"))
    size = sets.agg(F.sum(F.octet_length(F.to_json("items")) + ROW_BYTES)).first()[0] or 0
    each = found.where(F.size("sets") > 0).select("id", "tag", F.explode("sets").alias("item_set"))
    met = each.join(F.broadcast(sets) if size <= max_broadcast else sets, "item_set")
    own = met.groupBy(F.col("id").alias("o_id"), F.col("tag").alias("o_tag")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    same = F.col("id").eqNullSafe(F.col("o_id")) & (F.col("tag") == F.col("o_tag"))
    hit = found.where(F.size("sets") > 0).join(own, same).drop("o_id", "o_tag", "sets")
    none = found.where(F.size("sets") == 0).drop("sets").withColumn("items", F.array().cast("array<string>"))
    return none.unionByName(hit)


def covered(starts: Column) -> Column:
    """The distinct word positions in the given windows."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))


def report(found: DataFrame) -> DataFrame:
    """A row for each row of the documents: doc_id, n_words, n_hit, n_items, items, contaminated."""
    rows = found.select("id", "copies", "n_words", F.size(covered(F.col("starts"))).cast("long").alias("n_hit"), "items")
    each = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.5, doc_id: str = "doc_id", text: str = "text", broadcast_words: int = 2_000_000, **options) -> DataFrame:
    """docs without the hit words, and without the documents of which more than max_share of the words is hit.

    A removed word takes the separator after it along. All columns of docs stay; other texts are unchanged."""
    found = contamination(docs, benchmark, doc_id=doc_id, text=text, hits_only=True, **options)
    hits = cut(found.select(F.col("id").alias("hit_id"), F.col("tag").alias("hit_tag"), covered(F.col("starts")).alias("hit_words"), "n_words"))
    small = hits.agg(F.sum(F.size("hit_words") + 20)).first()[0]  # 4 bytes each, and 80 for a row
    small = (small or 0) <= broadcast_words
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (_tag(F.col("text")) == F.col("hit_tag"))
    met = rows.join(F.broadcast(hits) if small else hits, same, "left")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(PIECE), F.lit(0))
    # what lies between hit words: word k is piece 2 k, or 2 k + 1 behind a separator, and the piece after it its separator
    edges = F.concat(F.array(F.lit(-1)), F.array_sort("hit_words"), F.array(F.col("n_words").cast("int")))
    gaps = lambda e: F.filter(F.transform(F.slice(e, 2, F.size(e) - 1), lambda stop, i: F.struct((F.get(e, i) + 1).alias("first"), stop.alias("stop"))), lambda g: g["stop"] > g["first"])
    before = lambda ps: F.when(F.get(ps, F.lit(0)).rlike(f"^(?:{PIECE.split('|')[0]})"), 0).otherwise(1)
    kept_of = lambda x: F.concat(F.slice(x["ps"], F.lit(1), x["b"]), F.flatten(F.transform(gaps(x["e"]), lambda g: F.slice(x["ps"], 2 * g["first"] + x["b"] + 1, 2 * (g["stop"] - g["first"])))))
    with_before = F.transform(F.array(F.struct(pieces.alias("ps"), edges.alias("e"))), lambda x: F.struct(x["ps"].alias("ps"), x["e"].alias("e"), before(x["ps"]).alias("b")))
    kept = F.get(F.transform(with_before, kept_of), F.lit(0))  # the pieces are made once
    clean = F.when(F.col("hit_id").isNull() & F.col("hit_words").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    left = met.where(F.col("hit_words").isNull() | (F.size("hit_words") <= max_share * F.col("n_words")))
    return left.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
