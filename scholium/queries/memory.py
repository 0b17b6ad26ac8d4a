"""Memories: events are accesses, customers and orders are users and what is remembered of them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..operators import alike as A
from ..operators import memory as M
from ..plans.answer import hashing_embedding
from ..session import table

QUERIES: dict = {}
QUERY_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            QUERY_SQL[name] = sql
        return fn

    return add


NOW = "2000-01-01 00:00:00"
MEMORIES = f"""m AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'episodic' ELSE 'semantic' END AS memory_type,
 (['preference', 'research', 'task', 'terminology', 'background', 'interaction'])[(o_orderkey % 6 + 1)::INT] AS subtype, o_orderpriority AS memory_key, o_orderstatus <> 'F' AS is_active,
 least(1.0, o_totalprice / 300000) AS importance, (o_orderkey % 100) / 100.0 AS confidence, o_orderkey % 40 AS access_count, o_orderdate AS updated_at, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate + INTERVAL 400 DAY END AS expires_at, TIMESTAMP '{NOW}' AS now,
 greatest(0, epoch_us(TIMESTAMP '{NOW}' - o_orderdate) / 86400000000.0) AS age, round((o_orderkey % 97) / 97.0, 6) AS relevance FROM orders),
w AS (SELECT *, least(1.0, importance * power(0.5, age / CASE WHEN memory_type = 'semantic' THEN 180.0 ELSE 45.0 END) + least(0.15, 0.03 * ln(1 + access_count))) AS eff FROM m)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    now = F.lit(NOW).cast("timestamp_ntz")
    kinds = F.array(*map(F.lit, M.SUBTYPES))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), F.when(k % 3 == 0, "episodic").otherwise("semantic").alias("memory_type"), F.get(kinds, (k % 6).cast("int")).alias("subtype"), F.col("o_orderpriority").alias("memory_key"), (F.col("o_orderstatus") != "F").alias("is_active"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 300000).alias("importance"), ((k % 100) / 100).alias("confidence"), (k % 40).alias("access_count"), F.col("o_orderdate").alias("updated_at"),
        F.when(k % 10 == 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("expires_at"), now.alias("now"), F.round((k % 97) / 97, 6).alias("relevance"),
    )
    rows = rows.withColumn("age", M.age_days(F.col("updated_at"), F.col("now")))
    return rows.withColumn("eff", M.effective_importance(importance=F.col("importance"), memory_type=F.col("memory_type"), age=F.col("age"), accesses=F.col("access_count")))


@query("mem_effective", f"WITH {MEMORIES} SELECT id, round(age, 4) AS age, round(eff, 6) AS eff FROM w")
def mem_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", F.round("age", 4).alias("age"), F.round("eff", 6).alias("eff"))


@query("mem_archive", f"""WITH {MEMORIES} SELECT memory_type, count(*) AS n, count(*) FILTER (coalesce(expires_at <= now, false)) AS expired,
 count(*) FILTER (coalesce(expires_at <= now, false) OR (age >= CASE WHEN memory_type = 'semantic' THEN 730 ELSE 180 END AND eff < 0.15)) AS archived FROM w GROUP BY 1""")
def mem_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir)
    stale = M.is_stale(expires_at=F.col("expires_at"), memory_type=F.col("memory_type"), age=F.col("age"), effective=F.col("eff"), now=F.col("now"))
    return rows.groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("expires_at") <= F.col("now"), F.lit(False))).alias("expired"), F.count_if(stale).alias("archived"))


@query("mem_score_topk", f"""WITH {MEMORIES}, f AS (SELECT *, CASE WHEN subtype IN ('preference', 'terminology') THEN greatest(relevance, 0.45) ELSE relevance END AS rel FROM w WHERE is_active),
s AS (SELECT *, round(0.65 * greatest(0, rel) + 0.25 * eff + 0.10 * confidence, 8) AS score FROM f WHERE rel >= 0.30)
SELECT user_id, id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, updated_at DESC, id DESC) AS rank FROM s QUALIFY rank <= 6""")
def mem_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    floored, total = M.score(relevance=F.col("relevance"), subtype=F.col("subtype"), effective=F.col("eff"), confidence=F.col("confidence"))
    rows = memories(spark, sf_dir).where("is_active").withColumn("score", F.round(total, 8)).withColumn("relevance", floored)
    return M.recall(rows, user="user_id").select("user_id", "id", "score", "rank")


@query("mem_touch", f"""WITH {MEMORIES} SELECT id, access_count + CASE WHEN is_active AND id % 4 = 0 THEN 1 ELSE 0 END AS access_count, CASE WHEN is_active AND id % 4 = 0 THEN now ELSE updated_at END AS last_accessed FROM w""")
def mem_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memories(spark, sf_dir).withColumn("last_accessed", F.col("updated_at"))
    return M.touch(rows, rows.where("id % 4 = 0").select("id"), F.col("now")).select("id", "access_count", "last_accessed")


@query("mem_list", f"WITH {MEMORIES} SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) AS pos FROM w WHERE is_active QUALIFY pos <= 20")
def mem_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty active memories of each user."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("id")))
    return memories(spark, sf_dir).where("is_active").select("id", "user_id", pos.alias("pos")).where("pos <= 20")


@query("mem_decisions", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT vec_id AS candidate_id, label, vec_id // 50 % 4 AS k, e, vec_id % 100 = 0 AS neg FROM v WHERE vec_id % 50 = 0),
x AS (SELECT vec_id AS id, label, vec_id % 4 AS k, e, vec_id % 3 = 0 AS neg FROM v WHERE vec_id % 50 <> 0),
p AS (SELECT candidate_id, id, round(list_cosine_similarity(c.e, x.e), 6) AS s, c.neg = x.neg AS agree, c.k = x.k AS own FROM c LEFT JOIN x ON c.label = x.label),
b AS (SELECT candidate_id, first(id ORDER BY s DESC, id) AS best, first(s ORDER BY s DESC, id) AS s, first(agree ORDER BY s DESC, id) AS agree, max(id) FILTER (own) AS own FROM p GROUP BY 1),
d AS (SELECT *, coalesce(s >= 0.3 AND agree, false) AS dup FROM b)
SELECT candidate_id, CASE WHEN dup AND (own IS NULL OR own = best) THEN 'merge' ELSE 'insert' END AS action, CASE WHEN dup AND (own IS NULL OR own = best) THEN best END AS target_id, CASE WHEN NOT (dup AND (own IS NULL OR own = best)) THEN own END AS superseded_id FROM d""")
def mem_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector a candidate against all others of its label, which is the user; keys go round four."""
    rows = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    candidates = rows.where(i % 50 == 0).select(i.alias("candidate_id"), F.col("label").alias("c_user"), F.lit("semantic").alias("c_type"), F.floor(i / 50) % 4, F.lit("x").alias("c_hash"), (i % 100 == 0).alias("c_negated"), F.col("embedding").alias("c_e")).toDF("candidate_id", "c_user", "c_type", "c_key", "c_hash", "c_negated", "c_e")
    existing = rows.where(i % 50 != 0).select(i.alias("id"), F.col("label").alias("user"), F.lit("semantic").alias("type"), (i % 4).alias("key"), F.lit("y").alias("hash"), (i % 3 == 0).alias("negated"), i.alias("updated_at"), F.col("embedding").alias("e"))
    return M.write_decisions(candidates, existing, cosine(F.col("c_e"), F.col("e")), threshold=0.3)


@query("mem_update_in_order")
def mem_update_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's user turns as candidates, folded in order over its first turn; a third have embeddings. How
    alike texts are is no SQL function, and each step sees what those before it did."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    kind = F.when(F.col("conv_id") % 2 == 0, "semantic").otherwise("episodic")
    vector = F.when(F.col("conv_id") % 3 == 0, hashing_embedding(F.col("text")))
    shaped = turns.select(F.col("conv_id").alias("user_id"), "turn", F.concat(F.lit("用户"), "text").alias("content"), kind.alias("memory_type"), F.concat(F.lit("k"), (F.col("turn") % 4).cast("string")).alias("memory_key"), F.lit(0.6).alias("importance"), F.lit(0.7).alias("confidence"), vector.alias("embedding"), F.col("turn").alias("session_id"))
    state = shaped.where("turn = 0").withColumns({"id": F.lit(1).cast("long"), "is_active": F.lit(True), "updated_at": F.lit(datetime.datetime(2024, 1, 1))})
    done = M.update_in_order(state, shaped.where("turn > 0").withColumnRenamed("turn", "ord"), user="user_id", now=datetime.datetime(2024, 6, 1))
    return done.drop("content", "embedding")


@query("session_libraries", "SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN 7 WHEN conv_id % 4 <> 0 THEN conv_id % 5 END AS library FROM conversations")
def session_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library of each conversation: what the request names, else that of its session, which a quarter lack."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    sessions = ids.where("conv_id % 4 <> 0").select("conv_id", (F.col("conv_id") % 5).alias("library"))
    asked = ids.select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.lit(7).cast("long")).alias("library"))
    return M.session_library(sessions, asked, session="conv_id", group="library")


@query("relevant_turns", """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT count(*) AS m FROM embeddings)
SELECT conv_id, turn FROM r, m JOIN v AS a ON a.vec_id = (conv_id * 31 + turn) % m JOIN v AS b ON b.vec_id = conv_id % m WHERE n <= 8 AND (conv_id % 9 = 0 OR round(list_cosine_similarity(a.e, b.e), 6) >= 0.05)""")
def relevant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight messages of each conversation that are like what is asked; vectors stand for both. A ninth ask without one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    m = vectors.count()
    last = M.recent_turns(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", turns=4)
    met = last.withColumn("vec_id", (F.col("conv_id") * 31 + F.col("turn")) % m).join(vectors, "vec_id").drop("vec_id")
    asked = met.withColumn("vec_id", F.col("conv_id") % m).join(vectors.withColumnRenamed("embedding", "wanted"), "vec_id")
    both = asked.withColumn("asked", F.when(F.col("conv_id") % 9 != 0, F.col("wanted")))
    return M.relevant_turns(both, embedding="embedding", asked="asked", threshold=0.05).select("conv_id", "turn")


CANDIDATES = r"""c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'how to ' || text ELSE text END AS message, '用户' || substr(text, 1, (turn % 5 * 80)::INT) || CASE WHEN conv_id % 13 = 0 THEN ' my API key' ELSE '' END AS content,
 CASE WHEN conv_id % 4 = 0 THEN 'episodic' WHEN conv_id % 17 = 0 THEN 'other' ELSE 'semantic' END AS memory_type, (['preference', 'research', 'task', 'terminology', 'background', 'interaction', 'gossip'])[(conv_id % 7 + 1)::INT] AS subtype,
 greatest(0, least(1, turn / 4.0)) AS importance, greatest(0, least(1, 1.5 - turn / 4.0)) AS confidence FROM conversations)"""


@query("mem_validate", rf"""WITH {CANDIDATES} SELECT conv_id, turn, CASE WHEN memory_type = 'semantic' THEN subtype || '.key' END AS memory_key, importance, confidence FROM c
 WHERE memory_type IN ('semantic', 'episodic') AND subtype <> 'gossip' AND length(trim(content)) BETWEEN 6 AND 300 AND NOT contains(lower(content), 'api key') AND importance >= 0.5 AND confidence >= 0.5
 AND NOT (memory_type = 'semantic' AND subtype IN ('research', 'background', 'task') AND regexp_matches(message, '(?i)[?？]|\b(?:what|how|why|which|whether|where|when)\b'))""")
def mem_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    kind = F.get(F.array(*map(F.lit, (*M.SUBTYPES, "gossip"))), (conv % 7).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(turn % 3 == 0, F.concat(F.lit("how to "), "text")).otherwise(F.col("text")).alias("message"), F.concat(F.lit("用户"), F.expr("substring(text, 1, int(turn % 5 * 80))"), F.when(conv % 13 == 0, " my API key").otherwise("")).alias("content"),
        F.when(conv % 4 == 0, "episodic").when(conv % 17 == 0, "other").otherwise("semantic").alias("memory_type"), kind.alias("subtype"), F.concat(kind, F.lit(".key")).alias("memory_key"), (turn / 4).cast("string").alias("importance"), (1.5 - turn / 4).cast("string").alias("confidence"), F.lit(True).alias("should_store"),
    )
    return M.valid_candidates(rows).select("conv_id", "turn", "memory_key", "importance", "confidence")


@query("mem_expiry", f"WITH {MEMORIES} SELECT id, updated_at + to_days((30 + id % 60)::INT) AS expires_at FROM w WHERE memory_type = 'episodic'")
def mem_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.make_dt_interval((30 + F.col("id") % 60).cast("int"))
    return memories(spark, sf_dir).where("memory_type = 'episodic'").select("id", (F.col("updated_at") + days).alias("expires_at"))


@query("mem_context", f"""WITH {MEMORIES} SELECT user_id, string_agg('c' || id, '；' ORDER BY subtype, memory_key, id) AS context FROM w WHERE is_active AND (subtype IN ('research', 'task', 'terminology', 'background')) GROUP BY user_id""")
def mem_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.memory_context(memories(spark, sf_dir).where("is_active").withColumn("content", F.concat(F.lit("c"), F.col("id").cast("string"))), group="user_id")


@query("mem_format", f"""WITH {MEMORIES} SELECT user_id, string_agg('- [' || memory_type || '/' || subtype || '] m' || id, chr(10) ORDER BY memory_type, subtype, memory_key, id) AS text FROM w WHERE is_active GROUP BY user_id""")
def mem_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.format_memories(memories(spark, sf_dir).where("is_active").withColumn("content", F.concat(F.lit("m"), F.col("id").cast("string"))), group="user_id")


@query("mem_negation", """SELECT conv_id, turn, regexp_matches(lower(text || CASE WHEN turn % 4 = 0 THEN ' do not stop' WHEN turn % 4 = 1 THEN '不再' ELSE '' END), '不再|不是|停止|取消|don''t|not ') AS negated FROM conversations""")
def mem_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("turn") % 4 == 0, " do not stop").when(F.col("turn") % 4 == 1, "不再").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", M.has_negation(F.concat("text", more)).alias("negated"))


@query("recent_turns", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4""")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recent_turns(table(spark, sf_dir, "conversations"), session="conv_id", order="turn", turns=2).select("conv_id", "turn", "position")


@query("repeat_turn_drop", r"""WITH k AS (SELECT conv_id, turn, role, role = 'user' AS u, CASE WHEN role = 'user' THEN length(text) % 3 END AS key FROM conversations),
f AS (SELECT conv_id, turn, role, u AND key = 1 AS rep, u, sum(u::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM k),
g AS (SELECT *, bool_or(rep) OVER (PARTITION BY conv_id, run) AS after, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id, run ORDER BY turn) AS reply FROM f)
SELECT conv_id, turn, role FROM g WHERE NOT rep AND NOT (role = 'assistant' AND reply = 1 AND run > 0 AND after)""")
def repeat_turn_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions are the same here if their lengths agree modulo 3; the question asked has remainder 1."""
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.length("text") % 3)
    return M.drop_repeats(rows, F.lit(1), session="conv_id", order="turn", role="role", message_key=F.col("key")).select("conv_id", "turn", "role")


@query("mem_tallies", f"SELECT action, count(*) AS n, count(superseded_id) AS superseded FROM ({QUERY_SQL['mem_decisions']}) GROUP BY action")
def mem_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mem_decisions(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count("superseded_id").alias("superseded"))


@query("alike_turns")
def alike_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations, and the same with another first word, that are alike from a ratio of 0.92 on: links
    of keys, with how many turns have each. The ratio is no SQL function."""
    said = table(spark, sf_dir, "conversations").select("text")
    turns = said.unionByName(said.select(F.regexp_replace("text", r"^\S+", "Else").alias("text"))).withColumn("id", F.monotonically_increasing_id())
    keys, links = A.alike(turns, row_id="id", text="text")
    times = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    of = lambda k: times.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"))
    return links.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ratio", "n_a", "n_b")
