"""Recall, fusion, reranking and compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, canonical_query, once, sentences, tokens
from ..functions.codes import encode, search_codes
from ..functions.vector import build_cells, cosine, search_cells, top_k
from ..operators import compress as C
from ..operators import index as X
from ..operators import retrieval as R
from ..operators import segment as W
from ..plans.answer import answer, hashing_embedding
from ..session import fresh_dir, table

QUERIES: dict = {}
QUERY_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            QUERY_SQL[name] = sql
        return fn

    return add


#: What the compatibility form makes of the characters of the tables that it changes, and the tokens.
PLAIN = "translate(translate({0}, '" + chr(0xAA) + chr(0xBA) + chr(0xB2) + chr(0xB3) + chr(0xB9) + chr(0xB5) + chr(0xA0) + "', 'ao231" + chr(0x3BC) + " '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = r"regexp_extract_all({0}, '[a-z0-9]+|[^\s\p{{Z}}\p{{P}}a-z0-9]')"
TOKENS_OF = lambda c: TOKENS.format(PLAIN.format(c))


def terms_sql(tokens: str, text: str = "documents") -> str:
    return f"""
tok AS (SELECT doc_id, {tokens} AS ts FROM {text}),
post AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token FROM tok),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM post GROUP BY token),
n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def bm25_sql(tokens: str, asked: str, k: int = 20) -> str:
    return f"""{terms_sql(tokens)},
asked AS (SELECT item_id AS question_id, token, count(*) AS times FROM (SELECT item_id, unnest({asked}) AS token FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, dl, token, count(*) AS f FROM post WHERE token IN (SELECT token FROM asked) GROUP BY 1, 2, 3),
sums AS (SELECT question_id, doc_id, round(sum(times * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (token) JOIN asked USING (token), n GROUP BY 1, 2),
bm AS (SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM sums WHERE score > 0 QUALIFY rank <= {k})"""


TERMS = terms_sql(TOKENS_OF("text"))
BM25 = bm25_sql(TOKENS_OF("text"), TOKENS_OF("text"))


def bm25(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k, question_id="item_id", question="text", doc_id="doc_id", text="text")


@query("bm25_idf", f"WITH {TERMS} SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_statistics(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text").select("token", "df", F.round("idf", 6).alias("idf"))


query("bm25_topk", f"WITH {BM25} SELECT * FROM bm")(bm25)

#: The indexes of this process's sessions, by session and table.
_KEPT: dict[tuple, str] = {}


def kept_index(spark: SparkSession, sf_dir: str) -> str:
    """An index over documents, made once for a session and a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        where = fresh_dir(spark, "index")
        X.put(table(spark, sf_dir, "documents"), where)
        _KEPT[key] = where
    return _KEPT[key]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query("bm25_indexed", f"WITH {BM25} SELECT * FROM bm")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk through the kept index."""
    return X.search(asked(spark, sf_dir), kept_index(spark, sf_dir), 20)


@query("index_blocks", f"""WITH {TERMS},
place AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {X.RANGE} AS range FROM documents),
q AS (SELECT DISTINCT item_id AS question_id, unnest({TOKENS_OF("text")}) AS token FROM benchmark),
b AS (SELECT DISTINCT token, range FROM post JOIN place USING (doc_id))
SELECT question_id, count(*) AS blocks, TRUE AS reads_less FROM q JOIN b USING (token) GROUP BY question_id""")
def index_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each question's tokens, and whether the best document of a question is found with fewer of them."""
    read = X.search(asked(spark, sf_dir), kept_index(spark, sf_dir), 1, with_blocks=True)
    return read.select("question_id", "blocks", (F.col("blocks_read") < F.col("blocks")).alias("reads_less"))


#: Documents as they are after changes: a third is gone, of the others some are replaced, and new ones come.
CHANGED = """(SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN lang || ' ' || text || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 7 = 1
 UNION ALL SELECT doc_id + 10000000, lang || ' ' || text FROM documents WHERE doc_id % 10 = 0)"""
BM25_CHANGED = BM25.replace("FROM documents),", f"FROM {CHANGED}),", 1)


@query("index_changes", f"WITH {BM25_CHANGED} SELECT * FROM bm")
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question after documents were deleted, replaced and added, each as a change of the index, and then merged."""
    docs, where = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), fresh_dir(spark, "index")
    spaced = lambda *cs: F.concat_ws(" ", *[F.col(c) for c in cs])
    X.put(docs, where)
    X.delete(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")), where)
    X.put(docs.where("doc_id % 7 = 1").select("doc_id", spaced("lang", "text", "source").alias("text")), where)
    X.put(docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), spaced("lang", "text").alias("text")), where)
    X.merge(spark, where)
    return X.search(asked(spark, sf_dir), where, 20)

#: Ideographs for letters: texts whose runs have no spaces between words.
HAN_LETTERS = "".join(chr(0x4E00 + 97 * k) for k in range(26))
HAN_TEXT = f"translate(translate(substr(text, 1, length(text)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'abcdefghijklmnopqrstuvwxyz', '{HAN_LETTERS}')"
HAN_TOKENS = rf"flatten(list_transform(regexp_extract_all({PLAIN.format(HAN_TEXT)}, '[a-z0-9]+|[㐀-鿿]+|[^\s\p{{Z}}\p{{P}}a-z0-9㐀-鿿]'), lambda r: CASE WHEN length(r) > 1 AND regexp_matches(r, '^[㐀-鿿]') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END))"


@query("bm25_han", f"WITH {bm25_sql(HAN_TOKENS, HAN_TOKENS)} SELECT * FROM bm")
def bm25_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk over the same texts in ideographs, whose terms are pairs of neighbours."""
    from string import ascii_lowercase

    han = F.translate(ascii_lower(F.col("text")), ascii_lowercase, HAN_LETTERS).alias("text")
    docs, asked = table(spark, sf_dir, "documents").select("doc_id", han), table(spark, sf_dir, "benchmark").select("item_id", han)
    return R.bm25(asked, docs, 20, question_id="item_id", question="text", doc_id="doc_id", text="text")


#: The dictionary that segment.count_words finds in those texts, the cheapest cut of each of their runs, and its words.
RUNS = f"regexp_extract_all({PLAIN.format(HAN_TEXT)}, '[㐀-鿿]+')"
WORDS = f"""
runs AS (SELECT run, count(*) AS times FROM (SELECT unnest({RUNS}) AS run FROM documents) GROUP BY run),
cuts AS (SELECT substr(run, i, k) AS word, sum(times)::BIGINT AS n FROM (SELECT run, times, k, unnest(range(1, length(run) - k + 2)) AS i FROM runs, range(1, {W.LONGEST + 1}) AS r(k)) GROUP BY word),
total AS (SELECT sum(n)::BIGINT AS total FROM cuts WHERE length(word) = 1),
held AS (SELECT c.word, c.n FROM (SELECT word, n, unnest(range(1, length(word))) AS i FROM cuts WHERE length(word) > 1 AND n >= {W.LEAST_COUNT}) c
  JOIN cuts h ON h.word = substr(c.word, 1, i) JOIN cuts t ON t.word = substr(c.word, i + 1), total GROUP BY c.word, c.n, total HAVING c.n * total >= {W.COHESION} * max(h.n * t.n)),
dict AS (SELECT word, n FROM cuts WHERE length(word) = 1 UNION ALL SELECT word, n FROM held),
cost AS (SELECT word, round(-ln(n / (SELECT sum(n) FROM dict)) * {W.MILLION})::BIGINT AS cost FROM dict),
asked_runs AS (SELECT run FROM runs UNION SELECT unnest({RUNS}) FROM benchmark),
"""


def words_sql() -> str:
    """The cheapest path from the end of each run: one step of the recursion for each place, all runs at once."""
    lengths = range(1, W.LONGEST + 1)
    joins = " ".join(f"LEFT JOIN cost c{k} ON c{k}.word = substr(run, i, {k}) AND i + {k - 1} <= length(run)" for k in lengths)
    options = ", ".join(f"{{'c': {'coalesce(c1.cost, unknown)' if k == 1 else f'c{k}.cost'} + costs[{k}], 'k': -{k}}}" for k in lengths)
    return f"""{WORDS}
rare AS (SELECT round(-ln(1 / sum(n)) * {W.MILLION})::BIGINT AS unknown FROM dict),
way AS (SELECT run, length(run) AS i, [0::BIGINT] AS costs, []::BIGINT[] AS steps, unknown FROM asked_runs, rare
  UNION ALL SELECT run, i - 1, list_prepend(b.c, costs), list_prepend((-b.k)::BIGINT, steps), unknown FROM
    (SELECT run, i, costs, steps, unknown, list_min(list_filter([{options}], lambda x: x.c IS NOT NULL)) AS b FROM way {joins} WHERE i > 0)),
steps AS (SELECT run, steps FROM way WHERE i = 0),
walk AS (SELECT run, 1::BIGINT AS i, []::VARCHAR[] AS words, steps FROM steps UNION ALL SELECT run, i + steps[i], list_append(words, substr(run, i, steps[i])), steps FROM walk WHERE i <= length(run)),
found AS (SELECT run, words FROM walk WHERE i > length(run))"""


def han_documents(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table's texts in ideographs."""
    from string import ascii_lowercase

    return table(spark, sf_dir, name).select(key, F.translate(ascii_lower(F.col("text")), ascii_lowercase, HAN_LETTERS).alias("text"))


@query("han_words", f"WITH RECURSIVE {words_sql()} SELECT run, array_to_string(words, '/') AS words, times FROM runs JOIN found USING (run)")
def han_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different run of ideographs of the texts, cut into words of a dictionary that is counted from them."""
    docs = han_documents(spark, sf_dir, "documents", "doc_id")
    cut = W.tokenizer(W.Dictionary.of(W.count_words(docs, text="text")))
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[㐀-鿿]+"), F.lit(0))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    return runs.select("run", F.array_join(cut(F.col("run")), "/").alias("words"), "times")


DISTANCE = "round(list_dot_product(q.e, q.e) + list_dot_product(v.e, v.e) - 2 * list_dot_product(q.e, v.e), 6)"
VECTORS = f"""q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS vector_id, round(list_cosine_similarity(q.e, v.e), 6) AS cos, abs({DISTANCE}) AS dist FROM q, v),
near AS (SELECT query_id, vector_id, dist AS score, row_number() OVER (PARTITION BY query_id ORDER BY dist, vector_id) AS rank FROM pairs QUALIFY rank <= 20),
alike AS (SELECT query_id, vector_id, cos AS score, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vector_id) AS rank FROM pairs QUALIFY rank <= 20)"""


def vectors(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 50 = 0"), rows, 20, query_id="vec_id", vector_id="vec_id", metric=metric)


@query("vec_topk_cosine", f"WITH {VECTORS} SELECT * FROM alike")
def vec_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir, "cosine")


@query("vec_topk_l2", f"WITH {VECTORS} SELECT * FROM near")
def vec_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir, "l2")
    return rows.withColumn("score", F.abs("score"))


@query("vec_topk_cells")
def vec_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_topk_cosine through an index of cells, of which each query probes three quarters, as these vectors have hardly any clusters; a tenth of the best may be missing."""
    where, rows = fresh_dir(spark, "cells"), table(spark, sf_dir, "embeddings")
    build_cells(rows, where, vector_id="vec_id", cells=16)
    return search_cells(rows.where("vec_id % 50 = 0"), where, 20, query_id="vec_id", probes=12)


@query("vec_topk_codes", f"WITH {VECTORS} SELECT * FROM alike")
def vec_topk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_topk_cosine through codes of an eighth of the vectors' bytes: the codes tell which vectors to read, and those
    tell the rest. Exact by the codes' bounds."""
    where, rows = fresh_dir(spark, "codes"), table(spark, sf_dir, "embeddings")
    encode(rows, where, vector_id="vec_id")
    return search_codes(rows.where("vec_id % 50 = 0"), where, 20, query_id="vec_id")


@query("vec_codes_recall", """SELECT vec_id AS query_id, 20::BIGINT AS wanted, TRUE AS reached, TRUE AS an_eighth FROM embeddings WHERE vec_id % 50 = 0""")
def vec_codes_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the 20 best a query finds that reads 200 vectors at most: reached is whether that is 0.9 of all
    queries' best; an_eighth, whether the codes' bytes are at most an eighth of the vectors'."""
    where, rows = fresh_dir(spark, "codes"), table(spark, sf_dir, "embeddings")
    encode(rows, where, vector_id="vec_id")
    asked = rows.where("vec_id % 50 = 0")
    best = vectors(spark, sf_dir, "cosine").select(F.col("query_id").alias("q"), F.col("vector_id").alias("v"))
    got = search_codes(asked, where, 20, query_id="vec_id", most=200).select(F.col("query_id").alias("q"), F.col("vector_id").alias("v"), F.lit(1).alias("hit"))
    share = best.join(got, ["q", "v"], "left").agg((F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("reached"))
    n_bytes = lambda name, size: spark.read.parquet(f"{where}/{name}").agg(F.sum(size).alias(name))
    sizes = n_bytes("codes", F.octet_length("code")).join(F.broadcast(n_bytes("vectors", 4 * F.size("e"))))  # one row each
    return best.groupBy(F.col("q").alias("query_id")).agg(F.count(F.lit(1)).alias("wanted")).join(F.broadcast(share)).join(F.broadcast(sizes.select((8 * F.col("codes") <= F.col("vectors")).alias("an_eighth"))))


RRF = f"""WITH {VECTORS}, u AS (SELECT query_id, vector_id, rank, 0 AS l FROM near UNION ALL SELECT query_id, vector_id, rank, 1 FROM alike),
s AS (SELECT query_id, vector_id, round(sum(0.5 / (60 + rank)), 9) AS score, min(l) AS l, min_by(rank, l) AS r FROM u GROUP BY 1, 2)"""


BUCKETS = "list_transform(ts, lambda t: ('0x' || substr(md5(t), 1, 4))::INT % 64)"
HASHED = "list_transform(range(64), lambda k: len(list_filter(bs, lambda b: b = k))::DOUBLE)"


@query("hybrid_fuse", f"""WITH {BM25},
v AS (SELECT doc_id, {HASHED} AS e FROM (SELECT doc_id, {BUCKETS} AS bs FROM tok)),
q AS (SELECT item_id, {HASHED} AS e FROM (SELECT item_id, {BUCKETS} AS bs FROM (SELECT item_id, {TOKENS_OF("text")} AS ts FROM benchmark))),
near AS (SELECT item_id AS query_id, doc_id AS vector_id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN list_sum(q.e) = 0 OR list_sum(v.e) = 0 THEN 0 ELSE round(list_cosine_similarity(q.e, v.e), 6) END DESC, doc_id) AS rank FROM q, v QUALIFY rank <= 20),
u AS (SELECT question_id AS query_id, doc_id AS vector_id, rank, 0 AS l FROM bm UNION ALL SELECT query_id, vector_id, rank, 1 FROM near),
s AS (SELECT query_id, vector_id, round(sum(0.5 / (60 + rank)), 9) AS score, min(l) AS l, min_by(rank, l) AS r FROM u GROUP BY 1, 2)
SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, r, vector_id) AS rank FROM s""")
def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and vectors fused: BM25 of each benchmark item, and its nearest documents by hashed token counts."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), hashing_embedding(F.col("text")).alias("embedding"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vector_id"), hashing_embedding(F.col("text")).alias("embedding"))
    near = top_k(asked, docs, 20, query_id="query_id", vector_id="vector_id", metric="cosine")
    words = bm25(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("doc_id").alias("vector_id"), "rank")
    return R.fuse([words, near], key="vector_id", query="query_id")


@query("rrf_fuse", RRF + " SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, r, vector_id) AS rank FROM s")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse([vectors(spark, sf_dir, "l2"), vectors(spark, sf_dir, "cosine")], key="vector_id", query="query_id")


@query("stable_key_order", """
SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id = 0 THEN '' ELSE doc_id::VARCHAR END, lang, source, trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS pos FROM documents""")
def stable_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the order of its key."""
    none = F.lit(None).cast("string")
    key = R.stable_key(doc_id=F.col("doc_id"), version=F.col("lang"), chunk_index=none, chunk_id=none, filename=F.col("source"), text=F.col("text"))
    short = F.struct(*[F.col(f"key.k{k}") for k in range(1, 6)], F.substring("key.k6", 1, 64))
    return R.positions(table(spark, sf_dir, "documents").select("doc_id", key.alias("key")), "key", ranges=short)


@query("rerank_topn", f"""WITH {VECTORS}, c AS (SELECT near.query_id, near.vector_id, cos FROM near JOIN pairs USING (query_id, vector_id))
SELECT query_id, vector_id, round(cos, 4) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vector_id) AS rank FROM c QUALIFY rank <= 5""")
def rerank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vectors(spark, sf_dir, "l2").select("query_id", "vector_id")
    pairs = found.join(rows.toDF("query_id", "q"), "query_id").join(rows.toDF("vector_id", "v"), "vector_id")
    best = R.rerank(pairs, F.round(cosine(F.col("q"), F.col("v")), 6), query="query_id", tie=[F.col("vector_id")])
    return best.select("query_id", "vector_id", "rerank_score", "rank")


@query("multi_query_dedup", f"""WITH {VECTORS}, u AS (SELECT query_id, vector_id, 0 AS l, rank FROM alike UNION ALL SELECT query_id, vector_id, 1, rank FROM near),
k AS (SELECT DISTINCT ON (g, vector_id) query_id // 200 AS g, vector_id, query_id, l, rank FROM u ORDER BY g, vector_id, query_id, l, rank)
SELECT g, vector_id, query_id, row_number() OVER (PARTITION BY g ORDER BY query_id, l, rank) AS rank FROM k""")
def multi_query_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = vectors(spark, sf_dir, "cosine").withColumn("l", F.lit(0)).unionByName(vectors(spark, sf_dir, "l2").withColumn("l", F.lit(1)))
    none = F.lit(None).cast("string")
    key = R.document_key(chunk_id=none, doc_id=F.col("vector_id"), version=none, chunk_index=F.lit(0), source=none, page=none, text=none)
    rows = lists.withColumn("g", F.floor(F.col("query_id") / 200)).withColumn("key", key)
    best = R.first_of_each(rows, within=["g"], key=["key"], order=[F.col("query_id"), F.col("l"), F.col("rank")])
    return best.select("g", "vector_id", "query_id", "rank")


CANON = r"""c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain FROM conversations WHERE role = 'user'),
k AS (SELECT *, CASE WHEN trim(regexp_replace(plain, '[\s?？!！。．.;；:：]+$', '')) = '' THEN plain ELSE trim(regexp_replace(plain, '[\s?？!！。．.;；:：]+$', '')) END AS canonical FROM c)"""


@query("query_anchor", f"""WITH {CANON}, f AS (SELECT conv_id, lower(canonical) AS key, min(turn) AS turn, min_by(canonical, turn) AS query FROM k WHERE canonical <> '' GROUP BY ALL)
SELECT conv_id, turn, query, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM f QUALIFY pos <= 3""")
def query_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three different questions of each conversation, in canonical form."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", canonical_query(F.col("text")).alias("query")).where("query <> ''")
    first = R.first_of_each(asked.withColumn("key", F.lower("query")), within=["conv_id"], key=["key"], order=[F.col("turn")])
    return first.where("rank <= 3").select("conv_id", "turn", "query", F.col("rank").alias("pos"))


@query("char_budget", """
SELECT source, doc_id, substr(text, 1, (40000 - used)::INT) AS text FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) WHERE used < 40000""")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return C.char_budget(rows, group="source", order="doc_id", text="text", budget=40_000)


@query("greedy_dedup")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), "embedding")
    found = vectors(spark, sf_dir, "cosine").join(rows, "vector_id")
    return C.greedy_dedup(found, group="query_id", order="rank", key="vector_id", embedding="embedding", threshold=0.6)


QUERY_SQL["greedy_dedup"] = f"""WITH RECURSIVE {VECTORS},
c AS (SELECT query_id, rank, vector_id, v.e FROM alike JOIN v ON vector_id = v.vec_id),
w AS (
  SELECT query_id, 0::BIGINT AS rank, []::BIGINT[] AS kept, []::DOUBLE[][] AS es FROM c GROUP BY query_id
  UNION ALL
  SELECT w.query_id, c.rank, CASE WHEN len(list_filter(w.es, lambda h: round(list_cosine_similarity(h, c.e), 6) >= 0.6)) > 0 THEN w.kept ELSE list_append(w.kept, c.vector_id) END,
         CASE WHEN len(list_filter(w.es, lambda h: round(list_cosine_similarity(h, c.e), 6) >= 0.6)) > 0 THEN w.es ELSE list_append(w.es, c.e) END
  FROM w JOIN c ON c.query_id = w.query_id AND c.rank = w.rank + 1),
l AS (SELECT query_id, max_by(kept, rank) AS kept FROM w GROUP BY query_id)
SELECT query_id, unnest(kept) AS vector_id, unnest(range(1, len(kept) + 1)) AS rank FROM l"""

@query("sentence_split", r"""WITH m AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '([。！？!?])\s*', '\1' || chr(1), 'g'), '(\.)\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM m) SELECT doc_id, len(s) AS n, array_to_string(list_transform(s, lambda x: length(x)), ',') AS lengths FROM s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: F.length(x).cast("string")), ",").alias("lengths"))


def overlap(sentence: Column) -> Column:
    """Share of a sentence's distinct tokens that the question has."""
    share = lambda own: F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, F.col("asked"))) / F.size(own))
    return once(F.array_distinct(tokens(sentence)), share)


def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each question, with the question's tokens."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    best = bm25(spark, sf_dir).where("rank <= 5")
    return R.with_rows(best, docs.select("doc_id", "text"), key="doc_id").join(asked.select(F.col("item_id").alias("question_id"), F.array_distinct(tokens(F.col("text"))).alias("asked")), "question_id")


SENTENCES = rf"""WITH {BM25},
best AS (SELECT question_id, doc_id, rank, text, list_distinct({TOKENS_OF("b.text")}) AS asked FROM (SELECT question_id, doc_id, rank, d.text FROM bm JOIN documents AS d USING (doc_id) WHERE rank <= 5) JOIN (SELECT item_id AS question_id, text AS btext FROM benchmark) USING (question_id)),
""".replace("b.text", "btext") + r"""parts AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([。！？!?])\s*', '\1' || chr(1), 'g'), '(\.)\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ss FROM best),
each AS (SELECT *, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM parts),
own AS (SELECT *, list_distinct(OWN) AS ts FROM each),
sim AS (SELECT *, CASE WHEN len(ts) = 0 THEN 0 ELSE round(len(list_intersect(ts, asked)) / len(ts), 6) END AS sim FROM own),
kept AS (SELECT *, first_value(pos) OVER (PARTITION BY question_id, doc_id ORDER BY sim DESC, pos) AS top, max(sim) OVER (PARTITION BY question_id, doc_id) AS most FROM sim),
short AS (SELECT question_id, doc_id, any_value(rank) AS rank, any_value(text) AS whole, len(any_value(ss)) AS n, count(*) AS k, string_agg(s, ' ' ORDER BY pos) AS joined, sum(length(s)) AS total FROM kept WHERE sim >= 0.25 OR (most < 0.25 AND pos = top) GROUP BY question_id, doc_id),
filtered AS (SELECT question_id, doc_id, rank, CASE WHEN n <= 1 OR k = n THEN whole ELSE joined END AS text, NOT (n <= 1 OR k = n) AS compressed, CASE WHEN n <= 1 OR k = n THEN length(whole) ELSE total END AS char_count FROM short)""".replace("OWN", TOKENS_OF("s"))


@query("sentence_filter", SENTENCES + " SELECT question_id, doc_id, text, compressed, char_count::INT AS char_count FROM filtered")
def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentence_filter(answer_context(spark, sf_dir), overlap, key=["question_id", "doc_id"], text="text")


@query("compressed_context", SENTENCES + """, used AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM filtered)
 SELECT question_id, doc_id, rank, substr(text, 1, (4000 - used)::INT) AS text FROM used WHERE used < 4000""")
def compressed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, sentence filter and budget in one plan, for all questions at once."""
    rows = C.compress(answer_context(spark, sf_dir), overlap, group="question_id", order="rank", key="doc_id", text="text")
    return rows.select("question_id", "doc_id", "rank", "text")


@query("hybrid_answers")
def hybrid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question, every document a chunk, answered and cited in one plan with stand-in services."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None)
    chunks = docs.select(
        F.col("doc_id").alias("chunk_id"), "text", hashing_embedding(F.col("text")).cast("array<float>").alias("embedding"), "doc_id", F.lit(0).alias("library_index"), "source", F.concat("source", F.lit(".pdf")).alias("filename"), none.cast("string").alias("paper_title"),
        F.lit(1).alias("page"), F.lit(1).alias("page_end"), F.lit("正文").alias("section"), F.lit(1).alias("paragraph_index"),
    )
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return answer(questions, chunks)
