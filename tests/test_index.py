"""The kept index against scoring all documents, through changes, and its blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholium.operators import index as X
from scholium.operators import retrieval as R

SF = "/root/testdata/sf0.001"
QUESTIONS = "question_id long, question string"


def texts(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(200)], k=rng.randrange(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts(12, 9))] + [(90, "w7 w7 W7 unknown"), (91, None), (92, "?!")], QUESTIONS)


def rows(frame):
    return [tuple(r) for r in frame.orderBy("question_id", "rank").select("question_id", "doc_id", "score", "rank").collect()]


def direct(asked, docs, k):
    return rows(R.bm25(asked, docs, k, question_id="question_id", question="question", doc_id="doc_id", text="text"))


def test_changes_are_seen_by_the_next_question(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SHARD", 60)  # several shards to a segment
    monkeypatch.setattr(X, "QUESTIONS", 5)
    where = f"file://{tmp_path}/index"
    old = spark.createDataFrame(list(enumerate(texts(200))) + [(900, None), (901, ""), (902, "w0 " * 3000)], "doc_id long, text string").withColumn("id", F.lit("z"))
    assert X.current(spark, where).version == -1
    X.put(old, where)
    assert rows(X.search(asked, where, 7)) == direct(asked, old, 7)
    X.delete(spark.createDataFrame([(k,) for k in range(0, 200, 3)] + [(902,), (902,), (12345,)], "id long"), where)
    left = old.where("doc_id % 3 <> 0 and doc_id <> 902 or doc_id between 900 and 901")
    left = old.where("not (doc_id < 200 and doc_id % 3 = 0) and doc_id <> 902")
    assert rows(X.search(asked, where, 7)) == direct(asked, left, 7)
    more = spark.createDataFrame([(k, t) for k, t in zip(range(190, 230), texts(40, 3))], "doc_id long, text string")  # some have an id that is there, or was
    X.put(more, where)
    now = left.join(more, "doc_id", "left_anti").select("doc_id", "text").union(more)
    want = direct(asked, now, 7)
    assert rows(X.search(asked, where, 7)) == want
    seen = X.current(spark, where)
    assert (seen.n, len(seen.segments)) == (now.count(), 2)
    merged = X.merge(spark, where)
    assert len(merged.segments) == 1 and (merged.n, merged.length) == (seen.n, seen.length) and abs(merged.mean_raw - seen.mean_raw) < 1e-12
    assert rows(X.search(asked, where, 7)) == want


def test_a_change_that_fails_is_not_seen(spark, asked, tmp_path, monkeypatch):
    where = f"file://{tmp_path}/index"
    docs = spark.createDataFrame(list(enumerate(texts(30))), "doc_id long, text string")
    X.put(docs, where)
    monkeypatch.setattr(X, "_publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        X.delete(docs.select(F.col("doc_id").alias("id")), where)
    monkeypatch.undo()
    assert rows(X.search(asked, where, 5)) == direct(asked, docs, 5)
    X.delete(docs.where("doc_id > 20").select(F.col("doc_id").alias("id")), where)  # over what the failed one left
    assert rows(X.search(asked, where, 5)) == direct(asked, docs.where("doc_id <= 20"), 5)


def test_an_empty_index_finds_nothing(spark, asked, tmp_path):
    assert X.search(asked, f"file://{tmp_path}/none", 5).count() == 0
    X.put(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/empty")
    assert X.search(asked, f"file://{tmp_path}/empty", 5).count() == 0


def test_under_a_third_of_the_blocks_is_read(spark):
    """One shard of 4,000 documents: the best are those of scoring all, from a small part of the blocks."""
    rng = np.random.default_rng(3)
    n, per = 4000, X.RANGE
    lengths = rng.integers(20, 200, n)
    columns = {c: [] for c in ("token", "ranges", "sizes", "best_sizes", "best_f", "best_dl", "docs", "fs", "ids")}

    def add(token, docs, fs, ids=()):
        ranges, firsts = np.unique(docs // per, return_index=True)
        sizes = np.diff(np.concatenate((firsts, [len(docs)])))
        for c, v in {"token": token, "ranges": ranges, "sizes": sizes, "best_sizes": sizes, "best_f": fs, "best_dl": lengths[docs], "docs": docs, "fs": fs, "ids": list(ids)}.items():
            columns[c].append(v)

    add(X.DOCUMENTS, np.arange(n), lengths, range(n))
    plain, asked = np.zeros(n), []
    shard_of = lambda: X._Shard(pa.table({c: (v if c == "token" else pa.array([list(map(int, x)) for x in v], pa.list_(pa.int64()))) for c, v in columns.items()}), 1.5, 0.75, lengths.mean())
    for k in range(20):
        docs = np.sort(rng.choice(n, int(n / 1.5 / 1.4**k), replace=False))  # from two thirds of the documents down to a few
        fs, weight = rng.integers(1, 6, len(docs)), np.log(n / len(docs)) * (1 if k != 3 else -1)
        add(f"t{k}", docs, fs)
        asked.append((f"t{k}", weight))
        plain[docs] += weight * fs * 2.5 / (fs + 1.5 * (0.25 + 0.75 * lengths[docs] / lengths.mean()))
    ids, scores, read, every = shard_of().best(asked, 10, per)
    best = np.argsort(-plain, kind="stable")[:10]
    assert set(best) <= set(ids.tolist()) and np.allclose(plain[ids], scores) and len(ids) == 10
    assert read < every / 3


def test_ranges_of_several_shards_follow_the_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SHARD", 30)  # in whole ranges: 32
    where, said = f"file://{tmp_path}/index", texts(150, 4)
    X.put(spark.createDataFrame([(1000 - 3 * k, t) for k, t in enumerate(said)], "doc_id long, text string"), where)
    asked = spark.createDataFrame([(1, "w0"), (2, "w3 w40")], QUESTIONS)
    want = {q: sum(len({n // X.RANGE for n, t in enumerate(reversed(said)) if w in t.split()}) for w in words) for q, words in ((1, ["w0"]), (2, ["w3", "w40"]))}
    assert {r.question_id: r.blocks for r in X.search(asked, where, 1, with_blocks=True).collect()} == want
