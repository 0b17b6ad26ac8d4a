"""Exact behaviour on small inputs."""

import datetime
import difflib
import hashlib
import json
import random
import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from scholium.config import Settings
from scholium.functions import text as T
from scholium.functions.vector import cosine, top_k
from scholium.operators import academic as A
from scholium.operators import catalog as K
from scholium.operators import citations as C
from scholium.operators import compress, evaluate, layout, memory, ordered, relational
from scholium.operators import retrieval as R
from scholium.plans import answer as P
from scholium.plans import ingest as I
from scholium.plans.plugins import Plugins
from scholium.sources import readers as S
from scholium.streaming import events as E


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()] or [F.lit(0).alias("_")])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("What is it??", "What is it"), ("  a　b  ？。", "a b"), ("？？", "??"), ("ＡＢ", "AB"), (None, "")])
def test_canonical_query(spark, text, want):
    assert value(spark, T.canonical_query(F.col("x")), x=text) == want


def test_sentences_do_not_cut_decimals(spark):
    assert value(spark, T.sentences(F.col("x")), x="Took 3.2 s. Then more? yes！好。\nend. no") == ["Took 3.2 s.", "Then more?", "yes！", "好。", "end. no"]


def test_text_functions(spark):
    assert value(spark, T.clean_markup(F.col("x")), x="<p>a &amp; b</p>\n c") == "a & b c"
    assert value(spark, T.shortened(F.col("x"), 3), x="ab cd") == "ab…"
    assert value(spark, T.tokens(F.col("x")), x="Ｆast 电机模型 x，é+ ？电。") == ["fast", "电机", "机模", "模型", "x", "é", "+", "电"]
    assert value(spark, T.unescaped(F.col("x")), x="a&amp;b &#8217;&#x4E2D; &eacute;&nosuch; &#xD800; &amp;lt;&") == "a&b ’中 é&nosuch; &#xD800; &lt;&"
    assert value(spark, T.similarity_ratio(F.col("x"), F.col("y")), x="ab-cd", y="abXd") == pytest.approx(difflib.SequenceMatcher(None, "abcd", "abxd").ratio())
    assert value(spark, T.json_object(F.col("x")), x='say ```json\n{"a": {"b": 1}}\n``` ok') == '{"a": {"b": 1}}'
    assert value(spark, T.base_name(F.col("x")), x="a\\b/C.PDF") == "c.pdf"
    assert [value(spark, T.clamp01(F.col("x")), x=x) for x in ("2", "-1", "0.5", "x")] == [1.0, 0.0, 0.5, 0.0]


def test_recursive_split_bounds_and_overlap():
    text = "\n\n".join(f"Paragraph {k} has words. And more words here." for k in range(40))
    parts = T.recursive_split(text, 200, 50)
    assert all(0 < len(p) <= 200 for p in parts) and "".join(parts).replace(" ", "").count("Paragraph") >= 40
    assert T.recursive_split("x" * 450, 200, 0) == ["x" * 200, "x" * 200, "x" * 50]
    assert T.recursive_split("", 10, 2) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<table><tr><th colspan=2>A</th></tr><tr><td>1</td><td> 2 </td></tr></table>", [["A", "A"], ["1", "2"]]),
        ('<TR><TD COLSPAN="3" class=x>a &amp; <b>b</b>\n c</TD></TR><tr><td> </td></tr><tr><td colspan="x">1<td>2</td></tr>', [["a & b c"] * 3, ["1", "2"]]),
        ("| a | b |\n|---|:-:|\n| 1 | |", [["a", "b"], ["1", ""]]),
        ("a\tb\nplain\n-\t:-", [["a", "b"]]),
        ("plain <table>", []),
        (None, []),
    ],
)
def test_table_rows(spark, text, want):
    assert value(spark, T.table_rows(F.col("x").cast("string")), x=text) == want


def test_json_of_replies(spark):
    first = lambda x: value(spark, T.json_first(F.col("x")), x=x)
    assert first('so: {"a": [1, "}"]} and {"b": 2}') == '{"a": [1, "}"]}' and first("```json\n[1, 2]\n```") == "[1, 2]" and first("none") is None and first('{"a"') is None
    whole = lambda x: value(spark, T.json_whole(F.col("x")), x=x)
    assert whole('x ```json\n{"a": 1}\n``` {"b": 2}') == '{"a": 1}' and whole('ok {"a": 1}.') == '{"a": 1}' and whole("[1]") is None and whole('{"a": 1} {"b": 2}') is None
    judge = lambda x: value(spark, T.json_object(F.col("x")), x=x)
    assert judge('```json\n{"a": 1}\n``` {"b": 2}') == '{"a": 1}' and judge('x {"a": 1} {"b": 2}') is None


def test_metadata_is_scalar(spark):
    assert value(spark, T.scalar(F.array(F.lit("é"), F.lit("b")), "array<string>")) == '["é","b"]' and value(spark, T.scalar(F.lit(3), "int")) == 3


def test_reading_order_section_and_packing(spark):
    rows = [("d", 0, "b2", "text", "second", 1, 2.0), ("d", 1, "t", "title", "## 2 Methods", 1, 0.0), ("d", 2, "b1", "text", "first", 1, 1.0), ("d", 3, "tab", "table", "x | y", 2, None), ("d", 4, "p", "text", " ", 3, None)]
    blocks = spark.createDataFrame(rows, "doc string, pos int, block_id string, type string, text string, page int, reading_order double").withColumn("page_end", F.col("page")).withColumn("kind", layout.chunk_kind(F.col("type")))
    packs = {r.chunk: r for r in layout.pack(layout.carry_section(layout.reading_order(blocks, doc="doc"), doc="doc"), doc="doc").collect()}
    assert packs[0].text == "first\n\nsecond" and packs[0].section == "2 Methods" and packs[0].block_ids == ["b1", "b2"]
    assert packs[1].content_type == "table" and packs[1].page == 2 and len(packs) == 2


def test_chunks_prefer_blocks_then_pages_then_markdown(spark):
    schema = f"doc_id long, blocks array<{layout.BLOCK}>, pages array<struct<page:int,text:string>>, markdown string"
    rows = [(1, [("b", "text", "block text", 3, None, None, [1.0, 2.0], "i", "p", "m")], [(1, "ignored")], "ignored"), (2, None, [(4, "# Title\nLegacy paragraph.")], "ignored"), (3, None, None, "only this"), (4, [], [], None)]
    got = {r.doc_id: r for r in layout.chunk_documents(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].text == "block text" and got[1].page == 3 and got[2].page == 4 and got[2].section == "Title" and got[3].text == "only this" and 4 not in got
    assert got[1].chunk_index == 0 and got[1].paragraph_index == 1 and (got[1].bbox, got[1].block_ids, got[1].image_id) == ("[1.0,2.0]", '["b"]', "i") and got[2].bbox is None and got[3].library_index == 0


def test_long_blocks_and_markdown_are_split(spark):
    """Against the plain splitter: layout blocks also behind semicolons, Markdown chunks numbered as pages with the section of those before."""
    long = "; ".join(f"clause {k} of a long sentence" for k in range(120))
    mark = "\n\n".join(f"## Part {k}\n" + " ".join(f"word{k}x{j}" for j in range(90)) + "." for k in range(6))
    schema = f"doc_id long, blocks array<{layout.BLOCK}>, pages array<{layout.PAGE}>, markdown string"
    rows = [(1, [("b", "text", long, 1, None, None, None, None, None, None)], None, ""), (2, None, None, mark)]
    got = layout.chunk_documents(spark.createDataFrame(rows, schema), target=300, most=500, overlap=50).orderBy("doc_id", "chunk_index").collect()
    assert [r.text for r in got if r.doc_id == 1] == T.recursive_split(long, 500, 50, T.BLOCK_SEPARATORS)
    pieces = T.recursive_split(mark, 300, 50)
    section, want = layout.BODY, []
    for k, piece in enumerate(pieces, 1):
        head = piece.strip().splitlines()[0]
        section = head.lstrip("# ") if head.startswith("## ") else head if len(head) <= 40 and head[-1] not in "。.，,；;" else section
        want.append((k, section, piece))
    assert [(r.page, r.section, r.text) for r in got if r.doc_id == 2] == want and len(want) > 10


def test_continued_tables(spark):
    head = ["Model", "Score"]
    rows = [("d", 1, "Table 1 Results", 1, 1, [head, ["a", "1"]], 0.5, 0.9), ("d", 2, "", 2, 2, [head, ["b", "2"]], 0.1, 0.5), ("d", 3, "Table 2", 3, 3, [["x"]], 0.1, 0.2), ("d", 4, "Table 9 (continued)", 5, 5, [["x"]], 0.1, 0.2)]
    tables = spark.createDataFrame(rows, "doc string, ord int, caption string, page_start int, page_end int, rows array<array<string>>, top double, bottom double").withColumn("has_continued", T.is_continued(F.col("caption")))
    got = sorted(layout.merge_continued(tables, doc="doc").collect(), key=lambda r: r.table_id)
    assert [(r.table_id, r.page_start, r.page_end, r.continued) for r in got] == [("table_001", 1, 2, True), ("table_002", 3, 3, False), ("table_003", 5, 5, False)]
    assert [list(x) for x in got[0]["rows"]] == [head, ["a", "1"], ["b", "2"]]


def test_table_text(spark):
    rows = F.from_json(F.lit(json.dumps([["A", ""], ["1", "2"], ["", ""]])), "array<array<string>>")
    assert value(spark, layout.table_text(F.lit("T"), F.lit(2), F.lit(3), rows, F.lit(""))) == "Table: T\nPages: 2-3\nColumns: A; \nRow 1: A=1; column=2\nRow 2: A=1; column=2"
    none = F.from_json(F.lit("[]"), "array<array<string>>")
    assert value(spark, layout.table_text(F.lit("T"), F.lit(2), F.lit(2), none, F.lit("raw"))) == "Table: T\nPages: 2\nContent:\nraw"


@pytest.mark.parametrize(("title", "ok"), [("A Semi-superconducting Motor Design", True), ("Abstract", False), ("doi: 10.1/xyz abc", False), ("12345 -- //// ////  .....", False), ("abc", False), ("3. 结论", False)])
def test_plausible_titles(spark, title, ok):
    assert value(spark, layout.is_plausible_title(F.col("x")), x=title) is ok


def test_bm25_counts_repeated_question_words_and_pads(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat fish"), (3, "bird")], "id long, text string")
    asked = spark.createDataFrame([(7, "dog dog"), (8, "unknown")], "q long, t string")
    got = R.bm25(asked, docs, 2, question_id="q", question="t", doc_id="id", text="text").collect()
    assert [(r.question_id, r.doc_id, r["rank"]) for r in got] == [(7, 1, 1)]
    padded = R.bm25(asked, docs, 2, question_id="q", question="t", doc_id="id", text="text", pad_zero=True)
    assert padded.where("question_id = 8").count() == 2


def test_bm25_shuffles_only_the_best_and_slices_many_questions(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(30) if (k * 7 + j * j) % 5 == 0)) for k in range(300)], "id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 3} w{q + 3} w11") for q in range(12)], "q long, t string")
    ask = lambda settings: R.bm25(asked, docs, 4, question_id="q", question="t", doc_id="id", text="text", settings=settings)
    whole = ask(R.DEFAULTS)
    sent = [line for line in whole._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert sent and all("hashpartitioning(question_id" in line and "doc_id" not in line for line in sent)
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == 48
    monkeypatch.setattr(R, "BLOCK_QUESTIONS", 5)
    monkeypatch.setattr(R, "BLOCK_TERMS", 7)
    assert sorted(map(tuple, ask(replace(R.DEFAULTS, broadcast_rows=10)).collect())) == want


@pytest.mark.parametrize(("block", "query_bytes"), [(4096, 1 << 20), (2, 40)])
def test_top_k_in_blocks(spark, block, query_bytes):
    rows = spark.createDataFrame([(k, [float(k % 3), float(k % 5), 1.0]) for k in range(30)] + [(99, None)], "id long, embedding array<float>")
    got = top_k(rows.where("id < 5"), rows, 3, query_id="id", vector_id="id", metric="l2", exclude_self=True, block=block, query_bytes=query_bytes).collect()
    assert len(got) == 15 and all(r.query_id != r.vector_id for r in got)
    assert [r.vector_id for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 0] == [15, 6, 10]


def test_fusion_prefers_both_lists(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q long, k string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "q long, k string, rank int")
    assert [r.k for r in R.fuse([a, b], key="k", query="q").orderBy("rank").collect()] == ["y", "x", "z"]


def test_keys(spark):
    lit = F.lit
    none = lit(None).cast("string")
    assert value(spark, R.document_key(chunk_id=lit("c"), doc_id=lit(1), version=none, chunk_index=lit(0), source=none, page=none, text=none)) == "chunk_id|c"
    assert value(spark, R.document_key(chunk_id=lit(""), doc_id=lit(-1), version=none, chunk_index=lit(0), source=lit("s"), page=lit(2), text=lit("a  b"))) == "content|s|2|a b"
    assert tuple(value(spark, R.stable_key(doc_id=lit(0), version=none, chunk_index=lit(10), chunk_id=none, filename=none, text=lit(" a\n b")))) == ("", "", "10", "", "", "a b")


def test_dedup_is_greedy_and_budget_cuts(spark):
    rows = spark.createDataFrame([(1, 1, "a", [1.0, 0.0], "x" * 10), (1, 2, "b", [0.99, 0.14], "y" * 10), (1, 3, "c", [0.9, 0.43], "z" * 10)], "q long, rank int, k string, e array<double>, text string")
    kept = compress.greedy_dedup(rows, group="q", order="rank", key="k", embedding="e", threshold=0.92)
    assert sorted(r.k for r in kept.collect()) == ["a", "c"]  # c is like b, which is gone
    assert [len(r.text) for r in compress.char_budget(rows, group="q", order="rank", text="text", budget=14).orderBy("rank").collect()] == [10, 4]
    assert compress.char_budget(rows, group="q", order="rank", text="text", budget=0).count() == 3
    cut = compress.sentence_filter(rows.withColumn("text", F.lit("One b. Two a. Three b.")), lambda s: F.when(F.contains(s, F.lit("b")), 0.9).otherwise(0.1), key=["q", "k"], text="text").first()
    assert (cut.text, cut.compressed, cut.char_count) == ("One b. Three b.", True, 14)
    least = compress.sentence_filter(rows.withColumn("text", F.lit("One b. Two a.")), lambda s: F.lit(0.1), key=["q", "k"], text="text").first()
    assert least.text == "One b."


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "D/a.PDF", 5), (1, 2, "b.pdf", 1), (1, 3, "a.pdf", None), (1, 4, "a.pdf", 9)], "q long, rank int, filename string, page int")
    evidence = spark.createDataFrame([(1, "A.pdf", 6), (1, "a.pdf", 20), (2, "c.pdf", 1)], "q long, filename string, page int")
    card = {(r.q, r.k): r for r in evaluate.scorecard(results, evidence, question="q", ks=(1, 3), tolerance=1).collect()}
    assert card[1, 1].recall == 0.5 and card[1, 1].mrr == 1.0 and card[1, 1].ndcg == 1.0
    assert card[1, 3].recall == 0.5 and card[1, 3].ndcg == pytest.approx(1.5 / (1 + 0.63093), abs=1e-4) and card[2, 1].recall == 0
    assert "| n | N/A |" in evaluate.markdown({"n": None})


def test_golden_set_and_content_list(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"page_tolerance": 1, "items": [{"id": "q1", "question": "x", "evidence": [{"filename": "a.pdf", "page": 2}, {"filename": "a.pdf", "page": 3}]}, {"id": "q2", "question": "y", "evidence": [], "expect_refusal": True}]}))
    got = S.golden_set(spark, f"file://{tmp_path}/g.json").collect()
    assert [(r.id, r.page, r.expect_refusal) for r in got] == [("q1", 2, False), ("q1", 3, False), ("q2", None, True)]
    for body in ('[{"type": "text", "page_idx": 0}, null]', '{"blocks": [{"type": "text", "page_idx": 0}]}'):
        items = value(spark, S.content_list(F.col("x")), x=body)
        assert len(items) == 1 and items[0]["page_idx"] == 0


def test_memory_candidates(spark):
    base = {"message": "我主要研究超导", "content": "用户主要研究超导电机", "memory_type": "semantic", "subtype": "research", "memory_key": "research.topic", "importance": "0.9", "confidence": "0.9", "should_store": True}
    rows = [base, base | {"importance": "0.1"}, base | {"content": "用户的 API Key 是 123"}, base | {"content": "论文说效率高"}, base | {"message": "什么是超导？"}, base | {"memory_key": None}, base | {"memory_type": "episodic", "subtype": "interaction"}]
    got = memory.valid_candidates(spark.createDataFrame(rows, "message string, content string, memory_type string, subtype string, memory_key string, importance string, confidence string, should_store boolean")).collect()
    assert [r.memory_key and r.memory_key.split(".")[0] for r in got] == ["research", "research", None] and len(got[1].memory_key) == len("research.") + 12


def test_memory_updates_in_order(spark):
    now = datetime.datetime(2024, 6, 1)
    state = spark.createDataFrame([(1, 1, "用户喜欢短回答", "semantic", "pref", 0.5, 0.5, True, None)], "u long, id long, content string, memory_type string, memory_key string, importance double, confidence double, is_active boolean, superseded_by long")
    new = [(1, 1, "用户喜欢短回答。", "semantic", "pref", 0.6, 0.7), (1, 2, "用户不再喜欢短回答", "semantic", "pref", 0.6, 0.7), (2, 1, "用户研究电机方向", "semantic", "topic", 0.6, 0.7)]
    got = {(r.u, r.id): r for r in memory.update_in_order(state, spark.createDataFrame(new, "u long, ord int, content string, memory_type string, memory_key string, importance double, confidence double"), user="u", now=now).collect()}
    assert got[1, 1].importance == pytest.approx(0.63) and not got[1, 1].is_active and got[1, 1].superseded_by == 2 and got[1, 2].is_active and got[2, 1].memory_key == "topic"
    assert (got[1, 1].merged, got[1, 1].inserted, got[1, 1].superseded) == (1, 1, 1) and got[1, 2].expires_at is None and got[1, 2].updated_at == now


def test_memory_updates_by_embeddings_expiry_and_time(spark):
    now, day = datetime.datetime(2024, 6, 1), datetime.timedelta(days=1)
    old = [(1, 1, "用户甲", "episodic", "k", 0.5, 0.5, [1.0, 0.0], now - 9 * day, now - 50 * day, True), (1, 2, "用户乙乙", "episodic", "k", 0.5, 0.5, None, None, now - 40 * day, True), (1, 3, "用户丙", "semantic", None, 0.5, 0.5, None, None, now, False)]
    state = spark.createDataFrame(old, "u long, id long, content string, memory_type string, memory_key string, importance double, confidence double, embedding array<double>, expires_at timestamp, updated_at timestamp, is_active boolean")
    new = [(1, 1, "完全不同", "episodic", None, 0.9, 0.9, [0.99, 0.01], 4), (1, 2, "用户第三件", "episodic", "k", 0.6, 0.6, None, 5), (1, 3, "用户丙", "semantic", None, 0.6, 0.6, None, 6)]
    got = {r.id: r for r in memory.update_in_order(state, spark.createDataFrame(new, "u long, ord int, content string, memory_type string, memory_key string, importance double, confidence double, embedding array<double>, session_id long"), user="u", now=now).collect()}
    assert got[1].importance == pytest.approx(0.93) and got[1].session_id == 4 and got[1].expires_at == now + 180 * day and got[1].is_active  # merged by its embedding
    assert not got[2].is_active and got[2].superseded_by == 4 and got[4].session_id == 5  # of the rows of one key that of the latest update goes
    assert got[5].content == "用户丙" and not got[3].is_active and (got[1].inserted, got[1].merged, got[1].superseded) == (2, 1, 1)  # what is inactive is no double


def test_boxes_of_arrays_and_objects(spark):
    said = ['[1, "2", 3.5, 4, 9]', '{"x0": 1, "y0": 2, "x1": 3.5, "y1": "4"}', '{"x0": 1, "y0": 2}', "[1, 2]", "x", "", None, '{"x0": "a", "y0": 2, "x1": 3, "y1": 4}']
    got = [value(spark, layout.box_of(F.col("x")), x=s) for s in said]
    assert got == [[1.0, 2.0, 3.5, 4.0]] * 2 + [[]] * 6


def test_empty_vectors_are_told(spark):
    rows = spark.createDataFrame([(1, []), (2, [])], "id long, e array<double>")
    assert K.valid_batch(rows, key="id", embedding="e").first().least_dim == 0


def test_repeated_questions(spark):
    rows = [(1, "user", "Q？"), (2, "assistant", "no"), (3, "user", "other"), (4, "assistant", "reply"), (5, "user", "q")]
    got = memory.drop_repeats(spark.createDataFrame([(1, *r) for r in rows], "s long, i long, role string, text string"), F.lit("q"), session="s", order="i", role="role", message_key=F.lower(T.canonical_query(F.col("text"))))
    assert sorted(r.i for r in got.collect()) == [3, 4]


def test_catalogue(spark):
    old = spark.createDataFrame([(1, 1, "first.pdf", 1), (1, 2, "second.pdf", 2)], "g long, id long, filename string, library_index long")
    new = spark.createDataFrame([(1, 3, "first.pdf"), (1, 4, "third.pdf"), (1, 5, "third.pdf"), (2, 6, "x.pdf")], "g long, id long, filename string")
    assert {r.id: r.library_index for r in K.assign_index(old, new, group="g", name="filename", order="id").collect()} == {3: 1, 4: 3, 5: 3, 6: 1}
    papers = spark.createDataFrame([(1, 1, "ready"), (3, 2, "ready"), (4, 1, "parsing")], "id long, g long, status string")
    asked = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 1)], "id long, g long")
    assert {r.id: r.outcome for r in K.classify_removal(asked, papers, key="id", group="g", status="status").collect()} == {1: "deleted", 2: "missing", 3: "other library", 4: "busy"}


def test_citation_texts(spark):
    lit = F.lit
    label = C.label(library_index=lit(4), doc_id=lit(7), position=lit(1), title=lit("Semi-superconducting Motor"), filename=lit(""), page=lit(5), page_end=lit(6), section=lit("2 Motor Structure"), paragraph=lit(4))
    assert value(spark, label) == "[文献4《Semi-superconducting Motor》，第5–6页，§2 Motor Structure，段落4]"
    assert value(spark, C.external_label(position=lit(1), title=lit("An HTS Motor Study"), year=lit(2025), provider=lit("Semantic Scholar"), level=lit("abstract"))) == "[GS文献1《An HTS Motor Study》，2025，Semantic Scholar，摘要]"
    assert value(spark, C.encode_target(lit(3), lit(70), lit(1), lit(4))) == "g3-d70-p1-r4"
    assert value(spark, C.decode_target(lit("g0-d1-p1-r1"))) is None and value(spark, C.decode_target(lit("../g3-d70-p1-r4"))) is None


def test_rendering_twice_changes_nothing():
    evidence = [{"label": "[文献1《A》，第1页]", "key": "1", "reference": "A", "location": "第1页，段落4", "href": "?open_citation=a"}, {"label": "[文献1《A》，第6页]", "key": "1", "reference": "A", "location": "第6页", "href": "?open_citation=b"}, {"label": "[文献2《B》，第1页]", "key": "2", "reference": "B", "location": "第1页", "href": "#参考来源"}]
    once = C.render("x [2] y [文献2《B》，第1页] z [1] [9]", evidence)
    assert once.startswith("x [[1]](?open_citation=b") and "[9]" in once
    assert once.endswith('\n\n- [[1]](?open_citation=b "[文献1《A》，第6页]") A：第6页；第1页，段落4\n- [[2]](#参考来源 "[文献2《B》，第1页]") B，第1页')
    assert C.render(once, evidence) == once and C.render(" none ", []) == "none" and C.render("", evidence) == ""


def test_an_answer_without_labels_lists_all_evidence():
    evidence = [{"label": f"[文献{k}《A.b》，第1页]", "key": str(k), "reference": f"文献{k}《A.b》", "location": "第1页，§1.2", "href": "#参考来源"} for k in (1, 2)]
    assert C.render("none", evidence).split("\n") == ["none", "", "---", "", "### 参考来源", "", *[f'- [[{k}]](#参考来源 "[文献{k}《A.b》，第1页]") 文献{k}《A\\.b》，第1页，§1\\.2' for k in (1, 2)]]
    assert C.render("see [片段 2 | x] and [片段9]", evidence).startswith('see [[1]](#参考来源 "[文献2《A.b》，第1页]") and [片段9]\n')


def test_the_comment_of_older_answers_goes(spark):
    older = '结论[[1]](?open_citation=g3-d70-p1-r4 "来源")\n\n---\n\n<!-- any-reference-list -->\n### 参考来源\n\n- [[1]](?open_citation=g3-d70-p1-r4 "来源") 文献7《论文》'
    assert value(spark, C.strip_rendering(F.col("x")), x=older) == "结论[1]"
    assert C.render(older, [{"label": "来源"}]) == older.replace("<!-- any-reference-list -->\n", "")
    assert value(spark, C.strip_rendering(F.col("x")), x="a [[1]](HTTPS://x.org) \n") == "a [1]" and value(spark, C.strip_rendering(F.col("x")), x=None) == ""


@pytest.mark.parametrize(("url", "safe"), [("https://a.org/x", True), ("http://u:p@a.org", False), ("ftp://a.org", False), ("https://", False), ("javascript:alert(1)", False), (" https://a.org ", True), (None, False)])
def test_links(spark, url, safe):
    assert bool(value(spark, A.safe_url(F.col("x")), x=url)) is safe


def test_adapters(spark):
    s2 = {"data": [{"paperId": "p1", "title": "T", "abstract": "Direct evidence.", "year": 2024, "authors": [{"name": "A"}], "url": "https://www.semanticscholar.org/paper/p1", "externalIds": {"DOI": "10.1/X"}}, {"paperId": "p2", "title": "No abstract"}]}
    cr = {"message": {"items": [{"DOI": "10.1/x", "title": ["T2"], "abstract": "<jats:p>Direct <b>evidence</b>.</jats:p>", "author": [{"given": "G", "family": "F"}], "published": {"date-parts": [[2023, 1]]}, "container-title": ["V"]}]}}
    oa = {"results": [{"id": "W1", "display_name": "T3", "is_retracted": False, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "doi": "https://doi.org/10.2/y"}, {"id": "W2", "display_name": "T4", "is_retracted": True}]}
    bodies = {k: spark.createDataFrame([(json.dumps(v),)], "body string") for k, v in (("s2", s2), ("cr", cr), ("oa", oa))}
    first = A.papers(A.semantic_scholar(bodies["s2"], body="body"))
    assert [(r.doi, r.url) for r in first.collect()] == [("10.1/X", "https://www.semanticscholar.org/paper/p1?utm_source=api")]
    second = A.papers(A.crossref(bodies["cr"], body="body"))
    assert second.first().abstract == "Direct evidence ." and second.first().publication_year == 2023
    third = A.papers(A.openalex(bodies["oa"], body="body"))
    assert third.first().abstract == "a b a" and third.first().doi == "10.2/y" and third.count() == 1
    assert A.union_distinct([x.withColumn("pos", F.lit(1)) for x in (first, second, third)]).count() == 2


def test_sources_of_services(spark):
    got = S.replies(spark, [("good", "q"), ("bad", "q")], lambda p, q: json.dumps({"p": p}) if p == "good" else 1 / 0).collect()
    assert {r.provider: (r.body, bool(r.error)) for r in got} == {"good": ('{"p": "good"}', False), "bad": (None, True)}
    calls, waits = [], []

    def flaky(url, params, headers, timeout):
        calls.append(url)
        return (503, b"") if len(calls) < 3 else (200, b'{"ok": 1}')

    assert S.fetch_json(flaky, "u", {}, sleep=waits.append) == {"ok": 1} and waits == [0.4, 0.8]
    with pytest.raises(OSError):
        S.fetch_json(lambda *a: (404, b""), "u", {}, sleep=waits.append)
    pages = {None: ([1], "a"), "a": ([2], None)}
    assert S.pages_of(pages.__getitem__) == [1, 2]
    with pytest.raises(ValueError):
        S.pages_of(lambda c: ([1], "same"))
    good, errors = S.server_configs('[{"name": "a", "command": "x"}, {"name": "a", "command": "x"}, {"name": "b", "transport": "http"}, 3]')
    assert [g["name"] for g in good] == ["a"] and len(errors) == 3


def test_images(spark):
    rows = [(1, 1, "/root/d/a.png", b"abc"), (1, 2, "/root/d/a.png", b"abc"), (1, 3, "/etc/x.png", b"abc"), (1, 4, "/root/d/../x.png", b"a"), (1, 5, "/root/d/b.jpg", b"x" * 100)]
    got = S.data_urls(spark.createDataFrame(rows, "q long, rank int, image_path string, content binary"), root="/root/d", most_bytes=50, group="q", order="rank").collect()
    assert [r.data_url for r in got] == ["data:image/png;base64,YWJj"]


def test_hooks(spark):
    plugins = Plugins()
    plugins.register("one", lambda add: add("after_parse", lambda v: v + 1))
    plugins.register("bad", lambda add: add("after_parse", lambda v: 1 / 0))
    plugins.register("two", lambda add: add("after_parse", lambda v: v * 2))
    plugins.register("watch", lambda add: add("after_parse", lambda v: None))
    out = plugins.run("after_parse", 2)
    assert out.value == 6 and [f[0] for f in out.failures] == ["bad"] and out.ran == ["one", "two", "watch"]
    with pytest.raises(ValueError):
        plugins.register("leaky", lambda add: (add("after_parse", lambda v: 0), add("nowhere", None)))
    assert plugins.run("after_parse", 2).value == 6 and "leaky" not in plugins.names
    frame = spark.range(3)
    plugins.register("drop", lambda add: add("after_retrieve", lambda d: d.select(F.lit(1).alias("x"))))
    assert plugins.run("after_retrieve", frame).value is frame
    plugins.register("tag", lambda add: add("after_retrieve", lambda d: d.withColumn("tag", F.lit("t"))))
    assert plugins.run("after_retrieve", frame).value.columns == ["id", "tag"]


def test_settings(tmp_path):
    found = Settings.from_environment({"SCHOLIUM_CHUNK_SIZE": "500", "SCHOLIUM_PARSE_CONCURRENCY": "99", "SCHOLIUM_RECALL_K": "x"})
    assert (found.chunk_size, found.parse_concurrency, found.recall_k) == (500, 8, 20)
    assert found.saved(str(tmp_path / "env"), recall_k=7).recall_k == 7 and "SCHOLIUM_RECALL_K=7" in (tmp_path / "env").read_text()


def test_breaker(spark):
    calls = [(1, 0, False), (2, 1, True), (3, 2, False), (4, 3, False), (5, 10, True), (6, 70, False), (7, 100, True), (8, 131, True), (9, 132, False)]
    got = E.breaker_states(spark.createDataFrame([("s", i, float(t), ok) for i, t, ok in calls], "service string, i long, at double, ok boolean"), service="service", order="i", at="at", ok="ok")
    assert [(r.state, r.allowed) for r in got.orderBy("i").collect()] == [("closed", True), ("closed", True), ("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("closed", True), ("closed", True)]


def test_incremental_versions(spark, tmp_path):
    src, where = f"file://{tmp_path}/src", f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(r, "id long, v long, text string").coalesce(1)
    rows((1, 1, "a"), (2, 1, "b")).write.parquet(src)
    load = lambda: E.incremental_upsert(E.stream(spark, src), where, key=["id"], checkpoint=f"{where}-c", newest="v")
    load()
    rows((2, 2, "B"), (2, 3, "BB"), (3, 1, "c")).write.mode("append").parquet(src)
    load()
    load()  # nothing new
    assert sorted((r.id, r.text) for r in E.current_version(spark, where).collect()) == [(1, "a"), (2, "BB"), (3, "c")]
    rows((2, 2, "late"), (2, 3, "as new"), (1, 9, "newest")).write.mode("append").parquet(src)
    load()
    assert sorted((r.id, r.text) for r in E.current_version(spark, where).collect()) == [(1, "newest"), (2, "BB"), (3, "c")]


def test_asof_and_range(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, t long, v string")
    assert sorted((r.k, r.t, r.v) for r in relational.asof_join(left, right, by="k", at="t", values=["v"]).collect()) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]


def test_asof_of_a_hot_key(spark):
    left = spark.range(500).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("t"))
    right = spark.range(5).select(F.lit("k").alias("k"), (F.col("id") * 301).alias("t"), F.col("id").cast("string").alias("v"))
    got = relational.asof_join(left.repartition(5), right, by="k", at="t", values=["v"]).collect()
    assert {r.t: r.v for r in got} == {3 * k: str(3 * k // 301) for k in range(500)}


def test_vectors(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert value(spark, cosine(arr(1, 0), arr(0, 0))) == 0.0 and value(spark, cosine(arr(1, 1), arr(2, 2))) == pytest.approx(1)


def test_files_to_answers(spark, tmp_path):
    src, library = tmp_path / "in", f"file://{tmp_path}/lib"
    src.mkdir()
    (src / "motor.pdf").write_text("# Motors\nSuperconducting motors reach high torque density.\n\f2 Results\nThe torque density was 12 units.")
    (src / "bread.pdf").write_text("# Bread\nSourdough bread needs flour, water and salt.")
    (src / "empty.pdf").write_text("\f\f")
    first = I.ingest(spark, f"file://{src}", library, group_id=1)
    assert {r.filename for r in first.collect()} == {"bread.pdf", "motor.pdf"} and {r.library_index for r in first.collect()} == {1, 2}
    before = {r.filename: r.library_index for r in first.collect()}
    (src / "motor.pdf").write_text("# Motors\nSuperconducting motors reach very high torque density in tests.")
    second = {r.filename: (r.library_index, r.version) for r in I.ingest(spark, f"file://{src}", library, group_id=1).collect()}
    assert second == {name: (index, 2) for name, index in before.items()}
    chunks = I.library_chunks(spark, library, 1)
    assert chunks.where("text LIKE '%12 units%'").count() == 0
    asked = spark.createDataFrame([(1, "What torque density do superconducting motors reach?"), (2, "xyzzy?")], "question_id long, question string")
    chosen = chunks.withColumn("page_end", F.col("page_end").cast("int"))
    keeping = lambda q, ts, n: json.dumps({"answerable": True, "coverage": "direct", "keep": [k for k, t in enumerate(ts, 1) if "torque" in t]} if "torque" in q else {"answerable": False, "coverage": "insufficient"})
    got = {r.question_id: r for r in P.answer(asked, chosen, P.Services(plan=lambda q: ["torque density"], review_evidence=keeping)).collect()}
    assert not got[1].refused and "torque" in got[1].answer and "参考来源" in got[1].answer and got[2].refused and got[1].queries == ["What torque density do superconducting motors reach", "torque density"]
    none = P.answer(asked, chosen, P.Services(review_answer=lambda q, ts, d, n: '{"answerable": false, "coverage": "insufficient"}')).collect()
    assert all(r.refused and r.answer == P.INSUFFICIENT and r.n_evidence == 0 and not r.degraded for r in none) and {r.rejection_stage for r in none} == {"answer_review"}


REFUSED, KEPT = '{"coverage": "insufficient", "answerable": false, "keep": []}', '{"coverage": "direct", "answerable": true, "keep": [2]}'


@pytest.mark.parametrize(
    ("evidence", "answers", "want"),
    [
        ([KEPT], [None], ("draft: proof", True, None, ["answer review failed"], 1)),
        ([REFUSED, KEPT], ['{"coverage": "direct", "answerable": true, "answer": " mended "}'], ("mended", True, None, ["evidence confirmed by a second opinion"], 1)),
        ([REFUSED, REFUSED], [], (P.INSUFFICIENT, False, "evidence_review", [], 0)),
        ([REFUSED, "what?"], [REFUSED, REFUSED], (P.INSUFFICIENT, True, "answer_review", ["evidence review failed"], 0)),
        ([None], [REFUSED, '{"coverage": "scoped", "answerable": true, "answer": "less"}'], ("less", True, None, ["evidence review failed", "answer confirmed by a second opinion"], 2)),
    ],
)
def test_reviews_and_second_opinions(spark, evidence, answers, want):
    """None: the reviewer is down."""
    texts = ["noise about motors", "proof about motors"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").withColumns({"embedding": P.hashing_embedding(F.col("text")).cast("array<float>"), "doc_id": F.col("chunk_id") + 1, "library_index": F.lit(1), "paper_title": F.lit("T"), "filename": F.lit("a.pdf"), "page": F.lit(1), "page_end": F.lit(1), "section": F.lit("s"), "paragraph_index": F.lit(1)})

    def say(replies, n):
        if replies[n - 1] is None:
            raise RuntimeError("down")
        return replies[n - 1]

    services = P.Services(
        review_evidence=lambda q, ts, n: say(evidence, n).replace("[2]", str([k for k, t in enumerate(ts, 1) if "proof" in t])), write=lambda q, ts: "draft: " + ts[-1].split()[0], review_answer=lambda q, ts, d, n: say(answers, n)
    )
    row = P.answer(spark.createDataFrame([(1, "motors?")], "question_id long, question string"), chunks, services).first()
    body, _, listed = row.answer.partition("\n\n---\n\n")  # an answer that cites nothing has all its evidence listed
    assert (body, row.degraded, row.rejection_stage, row.warnings, row.n_evidence) == want and listed.count("\n- [[") == row.n_evidence


def test_failing_plans_and_writers(spark):
    chunks = spark.createDataFrame([(1, "motors turn")], "chunk_id long, text string").withColumns({"embedding": P.hashing_embedding(F.col("text")).cast("array<float>"), "doc_id": F.lit(1), "library_index": F.lit(1), "paper_title": F.lit("T"), "filename": F.lit("a.pdf"), "page": F.lit(1), "page_end": F.lit(1), "section": F.lit("s"), "paragraph_index": F.lit(1)})
    asked = spark.createDataFrame([(1, "motors?"), (2, "Motors ？")], "question_id long, question string")
    down = lambda *a: 1 / 0
    rows = P.answer(asked, chunks, P.Services(plan=down, write=down, baseline=lambda q, ts: f"plain {len(ts)}")).collect()
    assert {(r.answer.partition("\n\n---\n\n")[0], r.refused, tuple(r.warnings), tuple(r.queries)) for r in rows} == {("plain 1", False, ("planning failed", "writer failed"), ("motors",)), ("plain 1", False, ("planning failed", "writer failed"), ("Motors",))}
    assert all(r.refused and r.answer == P.INSUFFICIENT for r in P.answer(asked, chunks, P.Services(write=down)).collect())


def test_plugin_changes_and_governance(spark, tmp_path):
    src, library = tmp_path / "in", f"file://{tmp_path}/lib"
    src.mkdir()
    (src / "a.pdf").write_text("Some words of a paper.")
    plugins = Plugins()
    plugins.register("rewrite", lambda add: add("before_ingest", lambda d: d.withColumn("filename", F.lit("evil")).withColumn("tag", F.lit("t"))))
    I.ingest(spark, f"file://{src}", library, group_id=5, plugins=plugins)
    row = I.library_chunks(spark, library, 5).first()
    assert row.filename == "a.pdf" and row.tag == "t"


def test_hashing_embedding(spark):
    got = value(spark, P.hashing_embedding(F.col("x")), x="b a b")
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % P.DIMENSIONS
    assert got[place("b")] == pytest.approx(2 / 5**0.5) and got[place("a")] == pytest.approx(1 / 5**0.5) and sum(x > 0 for x in got) == 2
    assert not any(value(spark, P.hashing_embedding(F.col("x").cast("string")), x=None)) and len(got) == P.DIMENSIONS


def test_embedding_batches(spark):
    sizes = []
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "id long, text string").coalesce(1)
    got = P.embed(rows, lambda ts: [[float(t[1:]), 1.0] for t in ts], text="text", batch=2).orderBy("id").collect()
    assert [r.embedding[0] for r in got] == [0, 1, 2, 3, 4] and not sizes
    with pytest.raises(Exception, match="another number"):
        P.embed(rows, lambda ts: [[0.0]] * (len(ts) + 1), text="text").collect()


def test_judges(spark):
    from scholium.operators.review import judged

    replies = {"faithfulness": 'ok {"faithfulness": 1.7}', "answer_relevance": '{"answer_relevance": "x"}', "context_precision": "none", "context_recall": '{"context_recall": 0.25}'}
    rows = spark.createDataFrame([("q", "a")], "question string, answer string")
    got = judged(rows, lambda metric, row: replies[metric], inputs=["question", "answer"]).first()
    assert (got.faithfulness, got.answer_relevance, got.context_precision, got.context_recall) == (1.0, None, None, 0.25)


def test_summary_text(spark):
    rows = spark.createDataFrame([(1, k, f"Chunk {k}. More.") for k in range(9)], "doc long, chunk_index int, text string")
    got = P.summary(rows, doc="doc", most_chars=40).first().text
    assert got == "\n\n".join(f"Chunk {k}. More." for k in range(5))[:40]
    assert value(spark, P.quoted(F.col("x"), 2), x="One. Two. Three.") == "One. Two."


def test_rewriting_and_translation_context(spark):
    asked = spark.createDataFrame([(1, "Torque of motors??"), (2, "bread")], "question_id long, question string")

    def rewrite(text):
        if text == "bread":
            raise RuntimeError
        return "  motor   torque "

    assert [r.search_query for r in P.rewritten(asked, rewrite).orderBy("question_id").collect()] == ["motor torque", "bread"]
    texts = ["motor torque is high", "bread and flour", "salt water"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").withColumn("embedding", P.hashing_embedding(F.col("text")).cast("array<float>"))
    got = {r.question_id: r.context for r in P.translation_context(asked, chunks, key="question_id", text="question", hits=1).collect()}
    assert got == {1: texts[0], 2: texts[1]}


def test_positions_of_all_documents(spark):
    """Over several partitions, and of none."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.struct(((F.col("id") * 7919) % 3001).alias("k")).alias("key")).repartition(7)
    got = {r.doc_id: r.pos for r in R.positions(rows, "key").collect()}
    assert got == {d: n + 1 for n, d in enumerate(sorted(range(3000), key=lambda d: d * 7919 % 3001))}
    assert R.positions(rows.where("doc_id < 0"), "key").count() == 0


def test_running_sums_and_percentiles_of_a_hot_group(spark):
    """A group that spans all ranges, small ones, and one without a name."""
    rows = spark.range(4000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), "id", ((F.col("id") * 37) % 101).cast("double").alias("v"))
    plain = {}
    for r in rows.orderBy("id").collect():
        n, total = plain.get((r.g, None), (0, 0.0))
        plain[r.g, r.id], plain[r.g, None] = (n + 1, total), (n + 1, total + r.v)
    got = ordered.running(rows.repartition(9), by=["g"], order=[F.col("id")], value=F.col("v"))
    assert {(r.g, r.id): (r._n, r._before) for r in got.collect()} == {k: v for k, v in plain.items() if k[1] is not None}
    for r in ordered.percentiles(rows, group="g", value="v").collect():
        values = sorted(x.v for x in rows.collect() if x.g == r.g)
        assert (r.p50, r.p95, r.p99) == tuple(values[round(p * (len(values) - 1))] for p in (0.5, 0.95, 0.99))


def test_titles_after_implausible_lines(spark):
    pages = [(1, "\n".join(["", "Abstract", "1", "2", "3", "4", "5", "6", "7", "A plausible title of a paper"])), (2, "Other words of a page")]
    rows = spark.createDataFrame([(1, "download_1.pdf", [pages[1], pages[0]]), (2, "a/My file name.pdf", [(1, "Journal of Applied Energy\nA Semi-Superconducting Synchronous Motor Design\nAlice Zhang and Bob Li\nAbstract")]), (3, "a/No title.pdf", None)], f"id long, filename string, pages array<{layout.PAGE}>")
    got = {r.id: r.title for r in layout.paper_titles(rows, doc="id", filename="filename").collect()}
    assert got == {1: "A plausible title of a paper", 2: "A Semi-Superconducting Synchronous Motor Design", 3: "No title"}


def test_titles_of_headings_and_large_lines(spark):
    block = lambda kind, text, order, page=1: ("b", kind, text, page, None, float(order), None, None, None, None)
    headings = [block("heading", "High-Temperature Superconducting Motors for Aviation", 0), block("heading", "1 Introduction", 3)]
    split = [block("title", "High-Temperature Superconducting", 0), block("title", "Motors for Aviation and Ships", 1), block("text", "no heading of any kind", 2)]
    lines = [(20.0, 100.0, "A Title in Large Letters"), (8.0, 50.0, "small words above the title"), (20.0, 700.0, "Large Words Too Far Below")]
    rows = spark.createDataFrame([(1, "a.pdf", headings, None, None), (2, "a.pdf", split, None, None), (3, "a.pdf", None, "Words of its properties", lines), (4, "a.pdf", None, "Words of its properties", None)], f"id long, filename string, blocks array<{layout.BLOCK}>, metadata_title string, lines array<struct<size:double,y:double,text:string>>").withColumn("page_height", F.lit(800.0))
    got = {r.id: r.title for r in layout.paper_titles(rows, doc="id", filename="filename").collect()}
    assert got == {1: "High-Temperature Superconducting Motors for Aviation", 2: "High-Temperature Superconducting Motors for Aviation and Ships", 3: "A Title in Large Letters", 4: "Words of its properties"}


def test_searches_of_services(spark):
    from scholium.sources.services import search_papers

    body = json.dumps({"message": {"items": [{"DOI": "10.1/a", "title": ["A"], "abstract": "x"}]}})
    found = search_papers(spark, " q ", lambda p, q, n: body if p == "crossref" else 1 / 0)
    assert [r.title for r in found.papers.collect()] == ["A"] and found.providers == ("crossref",) and len(found.warnings) == 1 and not found.failed
    assert search_papers(spark, "q", lambda p, q, n: 1 / 0).failed
    none = search_papers(spark, "q", lambda p, q, n: '{"message": {"items": []}}', provider="Crossref")
    assert not none.failed and none.papers.count() == 0 and "abstract" in none.warnings[0]
    for bad in ({"query": " "}, {"query": "q", "provider": "nowhere"}, {"query": "q", "provider": "openalex"}, {"query": "q", "enabled": False}):
        asked = bad.pop("query")
        got = search_papers(spark, asked, lambda p, q, n: body, **bad)
        assert got.failed and got.papers is None and got.warnings


SERVER = """
import json, sys
for line in sys.stdin:
    m = json.loads(line)
    if "id" not in m:
        continue
    print(json.dumps({"jsonrpc": "2.0", "method": "notifications/message"}), flush=True)
    p, out = m["params"], {}
    if m["method"] == "initialize":
        out = {"serverInfo": {"name": "s"}}
    elif m["method"] == "tools/list":
        out = {"tools": [{"name": "a"}], "nextCursor": "2"} if not p.get("cursor") else {"tools": [{"name": "b"}]}
    elif m["method"] == "tools/call":
        out = {"content": [{"type": "text", "text": p["name"] + str(p["arguments"]["x"])}, {"type": "image", "data": "AA", "mimeType": "image/png"}], "isError": False}
    elif m["method"] == "resources/read":
        out = {"contents": [{"uri": p["uri"], "blob": "AA"}]}
    if m["method"] in ("resources/list", "prompts/list"):
        print(json.dumps({"jsonrpc": "2.0", "id": m["id"], "error": {"message": "no " + m["method"]}}), flush=True)
    else:
        print(json.dumps({"jsonrpc": "2.0", "id": m["id"], "result": out}), flush=True)
"""


def test_context_servers(tmp_path):
    import sys

    from scholium.sources import mcp

    (tmp_path / "server.py").write_text(SERVER)
    connect = lambda c: mcp.Pipe(sys.executable, [c["command"]]) if c["name"] == "s" else mcp.Post(c["url"], lambda *a: 1 / 0)
    servers = mcp.Servers([{"name": "s", "command": str(tmp_path / "server.py")}], connect)
    got = servers.call("s", "t", {"x": 1})
    assert got.text == "t1" and [c.kind for c in got.content] == ["text", "image"] and not got.is_error
    assert servers.read("s", "u:1")[0].data == "AA"
    (probe,) = servers.probe_all()
    assert probe.ok and [t["name"] for t in probe.tools] == ["a", "b"] and len(probe.errors) == 2 and probe.info["serverInfo"]["name"] == "s"
    with pytest.raises(mcp.ServerError):
        servers.call("none", "t")
    down = mcp.Servers([{"name": "h", "url": "http://x"}], lambda c: mcp.Post(c["url"], lambda *a: (_ for _ in ()).throw(OSError("down"))))
    assert not down.probe("h").ok and down.probe("h").errors == ["down"]
    seen = []

    def post(url, body, headers):
        seen.append(headers.get("Mcp-Session-Id"))
        m = json.loads(body)
        return (b"" if "id" not in m else b"data: " + json.dumps({"id": m["id"], "result": {"ok": 1}}).encode(), {"Mcp-Session-Id": "77"})

    with mcp.Client(mcp.Post("u", post)) as client:
        client.ping()
    assert seen == [None, "77", "77"]


def test_pictures_once_for_equal_content(spark):
    from scholium.sources import images as M

    def render(content, page, box):
        if page > 2:
            raise ValueError
        return None if box == [0.0] else content[:2]

    block = "array<struct<block_id:string,page:int,bbox:array<double>>>"
    rows = [(1, b"aaa", [("x", 1, [0.0]), ("y", 2, [1.0]), ("z", 9, None)]), (2, b"bbb", None), (3, b"", [("x", 1, None)])]
    found = M.stored_figures(M.rendered_figures(spark.createDataFrame(rows, f"id long, content binary, blocks {block}"), render, lambda c: [(4, c, "jpeg")], doc="id"), doc="id", root="/r")
    got = {(r.id, r.block_id): r for r in found.collect()}
    assert set(got) == {(1, "x"), (1, "y"), (2, "figure_0004_001")}  # one file's renderer fails on its last figure, another has no content
    assert got[1, "y"].image_path == got[1, "x"].image_path and got[1, "y"].data is None and bytes(got[1, "x"].data) == b"aa"
    pictures = spark.createDataFrame([("h1", b"a", "cap"), ("h1", b"a", ""), ("h2", b"b", None), ("h3", None, "gone")], "image_hash string, data binary, caption string")
    text = {r.image_hash: r.summary for r in M.summaries(pictures, lambda d, c: 1 / 0 if d == b"b" else f"{c} seen").collect()}
    assert text == {"h1": "cap seen", "h2": ""}


def test_parsers_in_turn_and_reports(spark, tmp_path):
    parse = S.first_of(lambda c, p: 1 / 0, lambda c, p: {"markdown": p, "pages": []})
    assert parse(b"", "x")["markdown"] == "x"
    with pytest.raises(ZeroDivisionError):
        S.first_of(lambda c, p: {}["x"], lambda c, p: 1 / 0)(b"", "x")
    evaluate.write_report(spark, {"n": 3, "recall": None}, f"file://{tmp_path}/r")
    assert json.loads((tmp_path / "r/report.json").read_text()) == {"n": 3, "recall": None} and "| recall | N/A |" in (tmp_path / "r/report.md").read_text()


def test_example_plugin_and_progress(spark, tmp_path):
    from scholium.plans import example_plugin
    from scholium.streaming.progress import Progress

    plugins = Plugins()
    assert plugins.discover(["scholium.plans.example_plugin"]) == (["scholium.plans.example_plugin"], [])
    assert plugins.run("after_retrieve", spark.range(2)).value.first().plugin_tag == example_plugin.TAG
    listener = Progress(most=2)
    spark.streams.addListener(listener)
    spark.range(3).write.parquet(f"file://{tmp_path}/in")
    E.drain(E.stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    deadline, seen = time.time() + 20, []
    while time.time() < deadline and "ended" not in [e.kind for e in seen]:
        seen += listener.drain()
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert seen[-1].kind == "ended" and not list(listener.drain())


def test_scratch_is_cleared(spark):
    from scholium import session

    session.clear_scratch(spark)
    where = session.fresh_dir(spark, "scratch")
    spark.range(3).write.parquet(where)
    session.fresh_dir(spark, "unused")
    assert session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(where)


def test_cells_find_nine_of_ten(spark, tmp_path):
    """Against all vectors, with and without slices of the queries; and an index of nothing."""
    from scholium.functions.vector import build_cells, search_cells

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0")
    where = f"file://{tmp_path}/cells"
    build_cells(rows, where, vector_id="vec_id", cells=16)
    exact = {(r.query_id, r.vector_id) for r in top_k(asked, rows, 20, query_id="vec_id", vector_id="vec_id").collect()}
    for size in (1 << 20, 20_000):
        got = {(r.query_id, r.vector_id) for r in search_cells(asked, where, 20, query_id="vec_id", probes=12, query_bytes=size).collect()}
        assert len(exact & got) >= 0.9 * len(exact) and len(got) == len(exact)
    assert spark.read.parquet(f"{where}/vectors").count() == rows.count()
    whole = {(r.query_id, r.vector_id) for r in search_cells(asked, where, 20, query_id="vec_id", probes=16).collect()}
    assert whole == exact
    build_cells(rows.where("vec_id < 0"), f"{where}-none", vector_id="vec_id")
    assert search_cells(asked.where("vec_id < 0"), f"{where}-none", 3, query_id="vec_id").count() == 0


def test_joined_tables_are_those_of_a_plain_fold(spark):
    """Random tables, and the rules once more, one by one."""
    rng = random.Random(4)
    cells = lambda: ["Model", "Score", "Year"][: rng.randint(1, 3)] if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randint(1, 3))]
    rows = []
    for doc in range(150):
        page = 1
        for ord in range(rng.randint(1, 5)):
            caption = rng.choice(["", "", "Table 1", "Table 2 x", "Table 1 (continued)", "Notes"])
            rows.append((doc, ord, caption, page, page, [cells() for _ in range(rng.randint(0, 3))], rng.choice([None, 0.1, 0.5]), rng.choice([None, 0.6, 0.9])))
            page += rng.choice([1, 1, 1, 2])
    number = lambda c: (re.findall(r"Table (\d+)", c) or [""])[0]
    header = lambda rs: next((" | ".join(x.lower() for x in r) for r in rs if any(r)), "")
    want = []
    for doc in range(150):
        out = []
        for _, _, caption, start, end, cs, top, bottom in (r for r in rows if r[0] == doc):
            last = out[-1] if out else None
            ok = last is not None and start == last["end"] + 1
            ok = ok and not (number(caption) and number(last["caption"]) and number(caption) != number(last["caption"])) and not (number(caption) and not number(last["caption"]) and "continued" not in caption)
            if ok:
                a, b = header(last["rows"]), header(cs)
                like = difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0
                wide = max(map(len, last["rows"]), default=0)
                points = 2 + 3 * (wide > 0 and wide == max(map(len, cs), default=0)) + (4 if like >= 0.82 else 2 if like >= 0.55 else 0)
                points += 5 if "continued" in caption else 2 if not caption else 4 if number(caption) and number(caption) == number(last["caption"]) else -3
                points += 2 * ((last["bottom"] or 0) >= 0.78) + 2 * (top is not None and top <= 0.25)
                ok = points >= 7
            if ok:
                last |= {"end": end, "rows": last["rows"] + (cs[1:] if last["rows"] and cs and like >= 0.82 else cs), "caption": last["caption"] or caption, "joined": True}
            else:
                out.append({"start": start, "end": end, "rows": list(cs), "caption": caption, "bottom": bottom, "joined": False})
        want += [(doc, f"table_{k:03d}", t["caption"], t["start"], t["end"], t["joined"], t["rows"]) for k, t in enumerate(out, 1)]
    tables = spark.createDataFrame(rows, "doc int, ord int, caption string, page_start int, page_end int, rows array<array<string>>, top double, bottom double")
    got = sorted((r.doc, r.table_id, r.caption, r.page_start, r.page_end, r.continued, [list(x) for x in r["rows"]]) for r in layout.merge_continued(tables, doc="doc").collect())
    assert got == want and 20 < sum(w[5] for w in want) < len(want)


def test_write_decisions_sort_no_pairs_and_keep_large_ids(spark):
    big = 9 * 10**18
    made = "candidate_id long, c_user int, c_type string, c_key long, c_hash string, c_negated boolean, c_v double"
    asked = spark.createDataFrame([(1, 1, "s", 5, "x", True, 1.0), (2, 1, "s", 6, "x", False, -1.0), (3, 2, "s", 5, "x", True, 1.0), (4, 1, "s", 7, "x", True, 0.5)], made)
    held = spark.createDataFrame([(big, 1, "s", 5, "y", True, big, 0.95), (big - 1, 1, "s", 7, "y", True, 1, 0.95), (-3, 1, "s", 8, "y", False, 2, -0.99), (7, 1, "s", 8, "y", False, 3, None)], "id long, user int, type string, key long, hash string, negated boolean, updated_at long, v double")
    out = memory.write_decisions(asked, held, F.col("c_v") * F.col("v"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "SortAggregate" in line and "candidate_id" in line]
    assert sorted(map(tuple, out.collect())) == [(1, "insert", None, big), (2, "merge", -3, None), (3, "insert", None, None), (4, "insert", None, big - 1)]


def test_approximate_counts_make_no_sketch_for_each_part(spark):
    from scholium.queries.relational import approx_counts

    found = approx_counts(spark, "/root/testdata/sf0.001")
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(r.near_count and r.near_median for r in found.collect())
