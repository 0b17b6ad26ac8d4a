"""Words of unspaced texts, codes of vectors, and memories kept as a stream's state, against plain versions."""

import datetime
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholium.config import DEFAULTS
from scholium.functions import codes
from scholium.functions.vector import top_k
from scholium.operators import memory, segment
from scholium.streaming import memories
from scholium.streaming.events import drain, stream


def plain_cut(run, costs, unknown):
    """The cheapest of all cuts; of equally cheap ones that with the longest first words."""
    cuts = []
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        ends = [i + 1 for i, m in enumerate(marks) if m] + [len(run)]
        words = [run[a:b] for a, b in zip([0, *ends], ends)]
        if all(len(w) == 1 or w in costs for w in words):
            cuts.append((sum(costs.get(w, unknown) for w in words), [-len(w) for w in words], words))
    return min(cuts)[2]


def test_cuts_are_the_cheapest():
    rng = random.Random(4)
    letters = "线圈交流损耗法"
    costs = {"".join(rng.choices(letters, k=rng.randrange(1, 5))): rng.randrange(1, 9) for _ in range(60)}
    trie = segment.trie_of(costs)
    for _ in range(200):
        run = "".join(rng.choices(letters + "新", k=rng.randrange(1, 9)))
        assert segment.cut_run(run, trie, 7) == plain_cut(run, costs, 7)


def test_words_are_counted_and_cut(spark):
    texts = ["降低线圈交流损耗", "线圈的损耗", "交流线圈", "损耗很低", "降低成本", None, "", "线圈 损耗 ＡＢＣ１２ ok？"]
    docs = spark.createDataFrame([(t,) for t in texts * 4], "t string")
    counts = segment.count_words(docs, text="t", cohesion=2.0)
    found = {r.word for r in counts.collect()}
    assert {"线圈", "损耗", "交流", "降低"} <= found and "圈交" not in found
    cut = segment.tokenizer(segment.Dictionary.of(counts))
    got = {r.t: r.w for r in docs.distinct().select("t", cut(F.col("t")).alias("w")).collect()}
    assert got["降低线圈交流损耗"] == ["降低", "线圈", "交流", "损耗"] and got[None] is None and got[""] == []
    assert got[texts[-1]] == ["线圈", "损耗", "abc12", "ok"]
    asked = spark.createDataFrame([("降低线圈交流损耗的方法有哪些" + end,) for end in ("", "？", "?")], "t string")
    assert len({tuple(r.w) for r in asked.select(cut(F.col("t")).alias("w")).collect()}) == 1  # what ends a question is no token
    none = segment.tokenizer(segment.Dictionary.of(counts.where("false")))
    assert asked.limit(1).select(none(F.lit("线圈 x")).alias("w")).first().w == ["线", "圈", "x"]


def test_codes_find_the_best(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((600, 12)))] + [(700, None), (701, [0.0] * 12), (702, [1.0] * 12), (703, [2.0] * 12)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    codes.encode(vectors, f"file://{tmp_path}/codes", vector_id="id", parts=4, centres=16)
    asked = vectors.where("id % 40 = 0 or id = 702")
    shown = lambda frame: [tuple(r) for r in frame.orderBy("query_id", "rank").select("query_id", "vector_id", F.round("score", 5), "rank").collect()]
    live = vectors.where("id not in (700, 701)")
    want = shown(top_k(asked, live, 5, query_id="id", vector_id="id"))
    got = shown(codes.search_codes(asked, f"file://{tmp_path}/codes", 5, query_id="id"))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-5)
    open_ones = codes.nearest_codes(asked, f"file://{tmp_path}/codes", 5, query_id="id").count()
    assert open_ones < asked.count() * live.count()
    assert codes.search_codes(asked, f"file://{tmp_path}/codes", 5, query_id="id", most=5).count() == 5 * asked.count()


def test_memories_of_batches_are_those_of_updates_in_order(spark, tmp_path):
    """Two runs over one checkpoint; each batch as an update by itself, at the latest time of a user's candidates."""
    rng = random.Random(6)
    start, day = datetime.datetime(2024, 3, 1), datetime.timedelta(days=1)
    texts = ["用户研究线圈", "用户研究线圈。", "用户不再研究线圈", "用户喜欢图表", "用户关注损耗问题"]
    rows = [(u, start + day * (10 * b) + datetime.timedelta(seconds=i), i, rng.choice(texts), rng.choice(["semantic", "episodic"]), rng.choice(["k1", "k2", None]), rng.choice([0.5, 0.7]), 0.6) for b in range(2) for i in range(20) for u in (1, 2)]
    names = "user long, at timestamp, i long, content string, memory_type string, memory_key string, importance double, confidence double"
    state = spark.createDataFrame([], f"user long, {memory.MEMORY}")
    for b in range(2):
        batch = spark.createDataFrame([r for r in rows if (r[1] - start) // (10 * day) == b], names)
        batch.write.mode("append").parquet(f"file://{tmp_path}/in")
        log = drain(memories.remember(stream(spark, f"file://{tmp_path}/in"), user="user", time="at", order="i"), f"file://{tmp_path}/out")
        done = memory.update_in_order(state, batch.withColumnRenamed("i", "ord").drop("at"), user="user", now=start + day * (10 * b) + datetime.timedelta(seconds=19))
        state = spark.createDataFrame(done.drop("inserted", "merged", "superseded").collect(), f"user long, {memory.MEMORY}")
    columns = ["user", "id", "content", "memory_type", "memory_key", "importance", "confidence", "is_active", "superseded_by", "updated_at", "expires_at"]
    now = memories.memories_now(log, user="user")
    shown = lambda frame: sorted(tuple(map(str, r)) for r in frame.withColumn("importance", F.round("importance", 6)).select(*columns).collect())
    assert shown(now) == shown(state)
    assert {"inserted", "merged", "superseded"} <= {r.change for r in log.collect()}


@pytest.mark.parametrize(("kind", "importance", "expires", "days"), [("episodic", 0.5, 3.0, 3.0), ("episodic", 0.5, None, 180.0), ("semantic", 0.2, None, 730.0), ("semantic", 0.99, None, 730.0), ("episodic", 1.0, None, 180.0)])
def test_a_memory_is_stale_when_the_batch_rule_says_so(spark, kind, importance, expires, days):
    at = int(pd.Timestamp("2024-01-01").value // 1000)
    us = lambda d: None if d is None else int(at + d * memories.DAY_US)
    moment = memories.stale_at({"memory_type": kind, "importance": importance, "updated_at": at, "expires_at": us(expires)}, DEFAULTS)
    assert (moment - at) / memories.DAY_US == pytest.approx(days, abs=1e-6)
    for shift, stale in ((-2, False), (2, True)):
        now, age = F.timestamp_micros(F.lit(int(moment) + shift)), (moment + shift - at) / memories.DAY_US
        weight = memory.effective_importance(importance=F.lit(importance), memory_type=F.lit(kind), age=F.lit(age), accesses=F.lit(0))
        rule = memory.is_stale(expires_at=F.timestamp_micros(F.lit(us(expires)).cast("long")), memory_type=F.lit(kind), age=F.lit(age), effective=weight, now=now)
        assert spark.range(1).select(rule.alias("x")).first().x is stale


def test_alike_texts_are_those_of_all_pairs(spark):
    import difflib

    from scholium.operators import alike

    rng = random.Random(3)
    base = ["".join(rng.choices("abcde fgh-日本", k=rng.randrange(2, 60))) for _ in range(60)]
    texts = [*base, *base[:5], None, "", "?!", "a", "B", "b"]
    for t in base[:40]:
        edited = list(t)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(edited))
            edited[k : k + rng.randrange(2)] = rng.choice("xyz")
        texts.append("".join(edited))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("key", F.lit("z"))
    keys, links = alike.alike(rows, row_id="id", text="t")
    of = {r.id: r.key for r in keys.collect()}
    plain = {of[k]: "".join(c for c in (t or "").lower() if c.isalnum()) for k, t in enumerate(texts)}
    assert len(set(plain.values())) == len(plain) and len(of) == len(texts)
    ordered = sorted(plain)
    want = {(a, b): round(r, 6) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (r := difflib.SequenceMatcher(None, plain[a], plain[b]).ratio()) >= 0.92}
    assert {(r.a, r.b): r.ratio for r in links.collect()} == want and len(want) > 10
    different = keys.select("key").distinct().join(spark.createDataFrame(list(plain.items()), "key string, bare string"), "key")
    assert alike.candidates(different, 0.92).count() < len(plain) ** 2 / 20
    with pytest.raises(ValueError, match="threshold"):
        alike.candidates(different, 0.5)
