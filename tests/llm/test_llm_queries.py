"""The queries of the training-data operators against DuckDB where they have a twin, and the pipeline against its parts."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholium.llm import queries

SF = "/root/testdata/sf0.001"


def shown(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERY_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.QUERY_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(map(shown, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(shown, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.QUERY_SQL)))
def test_a_row_for_each_row(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    table = {"op6_chat": "conversations"}.get(name, "documents")
    assert rows.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


ODD = [(1, None), (2, ""), (3, "a b c " * 30_000), (None, "Words without an id, but enough of them to be a text of their own."), (4, "One good line of words that ends as it should, and is kept. " + "Another one follows it here with other words. "), (4, "One good line of words that ends as it should, and is kept. " + "Another one follows it here with other words. ")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit("z") for c in ("id", "tag", "hash", "row", "n_entities", "found", "kept", "score")})


def test_stages_take_odd_tables(spark, odd, tmp_path):
    for name, docs in (("odd", odd), ("empty", odd.where("doc_id = 99"))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(f"file://{tmp_path}/{name}{k}")
            if name == "odd":  # every stage by itself on all odd rows, too
                assert stage(spark, odd, SF).count() <= len(ODD)
            docs = spark.read.parquet(f"file://{tmp_path}/{name}{k}")
        assert docs.count() == (0 if name == "empty" else 2)


def test_run_is_the_stages_in_turn(spark):
    """Against a plain pass: rules line by line, groups, windows of the benchmark, surrogates and tokens."""
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: j[8] for i, t in texts.items() if (j := corpus_pipeline.quality.judge(t or "", min_words=corpus_pipeline.MIN_WORDS))[7]}
    assert set(out) < set(kept)
    assert len({kept[i] for i in out}) == len(out)  # exact copies go
    clean = [i for i in out if kept[i] == texts[i] and not corpus_pipeline.pii.mentions(texts[i])]
    same = sum(out[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i in clean)
    assert same >= 0.9 * len(clean) > 100  # the others had passages of the benchmark
    assert all(r.n_tokens == len(r.token_ids) for r in out.values())
