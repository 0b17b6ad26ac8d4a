"""Long-term memory: validation, decay, scoring, archiving, writing; conversation windows."""

from __future__ import annotations

import datetime
import difflib
import math
import re
from collections import Counter
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import bare_of, clamp01, content_hash
from ..functions.vector import cosine
from ..session import ready

#: Types and subtypes, labels of secrets, signs of negation, cues of questions and of self-disclosure.
TYPES = ("semantic", "episodic")
SUBTYPES = ("preference", "research", "task", "terminology", "background", "interaction")
SENSITIVE = ("密码", "口令", "身份证", "银行卡", "api key", "apikey", "access token", "refresh token", "private key", "secret key")
NEGATIONS = ("不再", "不是", "停止", "取消", "don't", "not ")
QUESTION_CUES = r"(?i)[?？]|如何|哪些|什么|是否|为何|为什么|怎么|多少|有没有|能否|\b(?:what|how|why|which|whether|where|when)\b"
SELF_DISCLOSURE = r"(?i)我(?:目前|现在|正在|长期|主要|一直|计划|准备|将继续|尚未)?(?:研究|从事|关注|学习|开发|负责|计划|准备|希望)|我的(?:研究方向|专业|背景|任务|项目|目标)(?:是|为)|\b(?:my research|my background|i (?:am|currently|mainly) (?:researching|studying|working on|focused on))\b"
LITERATURE_WORDS = ("论文", "文献", "实验", "推荐", "检索")


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w) for w in words))


def is_sensitive(text: Column) -> Column:
    return _has_any(text, SENSITIVE)


def has_negation(text: Column) -> Column:
    return _has_any(text, NEGATIONS)


def is_unsubstantiated(message: Column, kind: Column, subtype: Column) -> Column:
    """A question that discloses nothing of its asker is no lasting research, background or task."""
    return (kind == "semantic") & subtype.isin("research", "background", "task") & message.rlike(QUESTION_CUES) & ~message.rlike(SELF_DISCLOSURE)


def valid_candidates(candidates: DataFrame, *, least_importance: float = 0.5, least_confidence: float = 0.5) -> DataFrame:
    """candidates (message, content, memory_type, subtype, memory_key, importance, confidence, should_store) that may be
    stored, numbers clamped, semantic keys filled in and episodic ones removed."""
    rows = candidates.withColumns({"importance": clamp01(F.col("importance")), "confidence": clamp01(F.col("confidence")), "content": F.trim("content")})
    ok = (
        F.coalesce(F.col("should_store"), F.lit(False)) & F.col("memory_type").isin(*TYPES) & F.col("subtype").isin(*SUBTYPES) & F.startswith(F.col("content"), F.lit("用户"))
        & F.length("content").between(6, 300) & ~is_sensitive(F.col("content")) & (F.col("importance") >= least_importance) & (F.col("confidence") >= least_confidence)
        & ~is_unsubstantiated(F.col("message"), F.col("memory_type"), F.col("subtype"))
    )
    given = F.nullif(F.trim(F.coalesce("memory_key", F.lit(""))), F.lit(""))
    key = F.when(F.col("memory_type") == "semantic", F.coalesce(given, F.concat_ws(".", "subtype", F.substring(content_hash(F.col("content")), 1, 12))))
    return rows.where(ok).withColumn("memory_key", key)


def age_days(since: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(86_400_000_000.0))


def effective_importance(memories: Column | None = None, *, importance: Column, memory_type: Column, age: Column, accesses: Column, settings: Settings = DEFAULTS) -> Column:
    half = F.when(memory_type == "semantic", settings.semantic_half_life_days).otherwise(settings.episodic_half_life_days)
    return F.least(F.lit(1.0), importance * F.pow(F.lit(0.5), age / half) + F.least(F.lit(0.15), F.lit(0.03) * F.log1p(F.greatest(accesses, F.lit(0)))))


def is_stale(*, expires_at: Column, memory_type: Column, age: Column, effective: Column, now: Column, settings: Settings = DEFAULTS) -> Column:
    """Expired, or idle for long and of little weight."""
    idle = F.when(memory_type == "semantic", settings.semantic_max_idle_days).otherwise(settings.episodic_max_idle_days)
    return F.coalesce(expires_at <= now, F.lit(False)) | ((age >= idle) & (effective < settings.archive_below))


def score(*, relevance: Column, subtype: Column, effective: Column, confidence: Column, settings: Settings = DEFAULTS) -> tuple[Column, Column]:
    """(floored relevance, score)."""
    floored = F.when(subtype.isin("preference", "terminology"), F.greatest(relevance, F.lit(settings.memory_floor))).otherwise(relevance)
    return floored, F.lit(0.65) * F.greatest(F.lit(0.0), floored) + F.lit(0.25) * effective + F.lit(0.10) * confidence


def recall(scored: DataFrame, *, user: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The best memories of each user with enough relevance; equals go to the later update, then the greater id."""
    order = Window.partitionBy(user).orderBy(F.desc("score"), F.desc("updated_at"), F.desc("id"))
    return scored.where(F.col("relevance") >= settings.memory_threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.memory_top_k)


def touch(memories: DataFrame, used: DataFrame, now: Column, *, key: str = "id") -> DataFrame:
    """One more access, now, for the active memories whose key is in used."""
    hit = used.select(F.col(key).alias("_k")).distinct()
    met = memories.join(hit, F.col(key) == F.col("_k"), "left")
    active = F.col("_k").isNotNull() & F.col("is_active")
    return met.withColumn("access_count", F.when(active, F.col("access_count") + 1).otherwise(F.col("access_count"))).withColumn("last_accessed", F.when(active, now).otherwise(F.col("last_accessed"))).drop("_k")


#: Existing rows of one user and type that one task compares with a candidate.
ROWS_PER_SALT = 50_000


def write_decisions(candidates: DataFrame, existing: DataFrame, similarity: Column, *, threshold: float = 0.92) -> DataFrame:
    """candidate_id, action, target_id, superseded_id for candidates that do not depend on one another.

    candidates: candidate_id, c_user, c_type, c_key, c_hash, c_negated; existing: id, user, type, key, hash, negated,
    updated_at (active ones). similarity: over the columns of both. The best existing row of the same type is that of
    equal content, else the most similar; it is a duplicate from the threshold on if both or neither negate. A candidate
    goes to as many tasks as the rows of its user and type fill, and brings one row back from each."""
    sizes = existing.groupBy(F.col("user").alias("_user"), F.col("type").alias("_type")).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > ROWS_PER_SALT).select("_user", "_type", F.ceil(F.col("_n") / ROWS_PER_SALT).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    own = existing.join(large, (F.col("user") == F.col("_user")) & (F.col("type") == F.col("_type")), "left").withColumn("_salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("_user", "_type", "_salts")
    asked = candidates.join(large, (F.col("c_user") == F.col("_user")) & (F.col("c_type") == F.col("_type")), "left").withColumn("_c_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_user", "_type", "_salts")
    met = asked.join(own, (F.col("c_user") == F.col("user")) & (F.col("c_type") == F.col("type")) & (F.col("_c_salt") == F.col("_salt")), "left")
    sim = F.when(F.col("c_hash") == F.col("hash"), 1.0).otherwise(F.round(similarity, 6))
    # one number in the order of (millionths, the smaller id, agreement): a struct would have every pair sorted
    number = lambda c, digits: c.cast(f"decimal({digits},0)")
    most = F.lit(Decimal(10**21))  # above ten times an id
    rank = number(F.round(sim * 1_000_000), 15) * most - number(F.col("id"), 19) * F.lit(10).cast("decimal(2,0)") + (F.col("negated") == F.col("c_negated")).cast("int").cast("decimal(1,0)")
    best = met.groupBy("candidate_id").agg(F.max(rank.cast("decimal(38,0)")).alias("rank"))
    ten = F.lit(10).cast("decimal(2,0)")
    millionths = F.round(F.col("rank") / most, 0)
    rest = F.col("rank") - millionths.cast("decimal(15,0)") * most
    agree = F.pmod(rest, ten)
    parts = best.select("candidate_id", (millionths.cast("double") / 1_000_000).alias("s"), (-((rest - agree) / ten)).cast("long").alias("best_id"), (agree == 1).alias("agree"))
    keyed = existing.groupBy(F.col("user").alias("_user"), F.col("type").alias("_type"), F.col("key").alias("_key")).agg(F.max(F.struct("updated_at", "id")).alias("own"))
    owners = candidates.select("candidate_id", "c_user", "c_type", "c_key").join(keyed, (F.col("c_user") == F.col("_user")) & (F.col("c_type") == F.col("_type")) & (F.col("c_key") == F.col("_key"))).select("candidate_id", "own")
    found = parts.join(owners, "candidate_id", "left")
    dup = F.coalesce((F.col("s") >= threshold) & F.col("agree"), F.lit(False))
    dup_id = F.when(dup, F.col("best_id"))
    merge = dup & (F.col("own").isNull() | (F.col("own.id") == dup_id))
    return found.select("candidate_id", F.when(merge, "merge").otherwise("insert").alias("action"), F.when(merge, dup_id).alias("target_id"), F.when(~merge, F.col("own.id")).alias("superseded_id"))


#: Columns of a memory, beside its user.
MEMORY = "id long, content string, memory_type string, memory_key string, importance double, confidence double, embedding array<double>, session_id long, expires_at timestamp, updated_at timestamp, is_active boolean, superseded_by long"


#: Characters of the grams by which two contents are told apart before they are compared; for longer ones, and from where.
GRAM, LONG_GRAM, LONG = 4, 5, 1000


class _Said:
    """What is compared of a content, made once: its letters and digits, how often it has each, and each of its grams."""

    def __init__(self, content: str) -> None:
        self.bare, self.negated = bare_of(content), any(w in (content or "").lower() for w in NEGATIONS)
        self.letters, self.grams = Counter(self.bare), {}

    def of(self, q: int) -> Counter:
        if q not in self.grams:
            self.grams[q] = Counter(self.bare[k : k + q] for k in range(len(self.bare) - q + 1))
        return self.grams[q]


def _common(one: Counter, two: Counter) -> int:
    one, two = (one, two) if len(one) <= len(two) else (two, one)
    return sum(min(n, two[x]) for x, n in one.items() if x in two)


def _ratio(one: _Said, two: _Said, least: float) -> float:
    """The ratio of matching blocks, or 0 where it cannot be least. Of so many characters in blocks as that takes, each is
    in both contents, and all but q - 1 of each block begin a gram that both have (see operators.alike)."""
    both = len(one.bare) + len(two.bare)
    need = math.ceil((least - 1e-9) * both / 2)
    if min(len(one.bare), len(two.bare)) < need or _common(one.letters, two.letters) < need:
        return 0.0
    q = GRAM if both < 2 * LONG else LONG_GRAM
    shared = need - (q - 1) * (both - 2 * need + 1)
    if shared > 0 and _common(one.of(q), two.of(q)) < shared:
        return 0.0
    return difflib.SequenceMatcher(None, one.bare, two.bare).ratio()


class Memories:
    """One user's memories while candidates come in, and what was done."""

    def __init__(self, rows: list[dict], now: pd.Timestamp, threshold: float, keep_days: float):
        self.now, self.threshold, self.until = now, threshold, now + pd.Timedelta(days=keep_days)
        # the latest update first, as they are looked through; new ones go behind
        self.live = sorted((r for r in rows if r["is_active"]), key=lambda r: (r["updated_at"] or pd.Timestamp.min, r["id"]), reverse=True)
        self.rows, self.actions, self.next_id = rows, [], max((r["id"] for r in rows), default=0) + 1
        self.said: dict[str, _Said] = {}  # of the live ones' contents

    def _said(self, row: dict) -> _Said:
        if row["content"] not in self.said:
            if len(self.said) > 2 * len(self.live) + 16:
                live = {r["content"] for r in self.live}
                self.said = {c: x for c, x in self.said.items() if c in live}
            self.said[row["content"]] = _Said(row["content"])
        return self.said[row["content"]]

    def _alike(self, one: dict, two: dict) -> float:
        """The cosine of the embeddings where both have one, else the ratio of matching blocks (0 where that is below the
        threshold)."""
        a, b = one["embedding"], two["embedding"]
        if a is not None and b is not None and len(a) == len(b):
            norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            return sum(x * y for x, y in zip(a, b, strict=True)) / norms if norms else 0.0
        return _ratio(self._said(one), self._said(two), self.threshold)

    def take(self, c: dict) -> list[tuple[str, int]]:
        """Takes one candidate; what it did to which ids."""
        same = [r for r in self.live if r["memory_type"] == c["memory_type"]]
        equal = next((r for r in same if self._said(r).bare == self._said(c).bare), None)
        likes = [(self._alike(c, r), r) for r in same] if equal is None else [(1.0, equal)]
        like, best = max(likes, key=lambda x: x[0], default=(0.0, None))  # of equals the first
        owner = next((r for r in same if c["memory_key"] and r["memory_key"] == c["memory_key"]), None)
        double = best if best is not None and like >= self.threshold and self._said(best).negated == self._said(c).negated else None
        expiry = self.until if c["memory_type"] == "episodic" else None
        if double is not None and (owner is None or owner is double):
            double |= {"importance": min(1.0, max(double["importance"], c["importance"]) + 0.03), "confidence": max(double["confidence"], c["confidence"]), "session_id": c["session_id"], "updated_at": self.now}
            double |= {"embedding": double["embedding"] if double["embedding"] is not None else c["embedding"], "expires_at": expiry or double["expires_at"]}
            self.actions.append("merged")
            return [("merged", double["id"])]
        fresh = c | {"id": self.next_id, "expires_at": expiry, "updated_at": self.now, "is_active": True, "superseded_by": None}
        self.next_id += 1
        self.rows.append(fresh)
        self.actions.append("inserted")
        if owner is not None:
            owner |= {"is_active": False, "superseded_by": fresh["id"], "updated_at": self.now}
            self.live = [r for r in self.live if r is not owner]
            self.actions.append("superseded")
        self.live.append(fresh)
        return [("inserted", fresh["id"])] + ([("superseded", owner["id"])] if owner is not None else [])


def update_in_order(state: DataFrame, candidates: DataFrame, *, user: str, now: datetime.datetime, threshold: float = 0.92, keep_days: float = DEFAULTS.episodic_max_idle_days) -> DataFrame:
    """The memories of each user after its candidates, one after the other, each seeing what those before it did, and
    what was done: inserted, merged, superseded, a number for each user.

    state: user and the columns of MEMORY; candidates: user, ord, content, memory_type, memory_key, importance,
    confidence, and embedding and session_id where there are such. Episodic memories expire keep_days after now, also when
    they are merged. A user's memories are held by one task; how candidates meet depends on their order."""
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "timestamp": pa.timestamp("us"), "boolean": pa.bool_()}
    fields = {x.split(" ")[0]: kinds[x.split(" ")[1]] for x in MEMORY.split(", ")}
    at, spark = pd.Timestamp(now), ready(state.sparkSession)
    zone = spark.conf.get("spark.sql.session.timeZone")

    def records(rows: pa.Table, order: str) -> list[dict]:
        for k, c in enumerate(rows.column_names):
            if pa.types.is_timestamp(rows.schema.field(k).type) and rows.schema.field(k).type.tz:  # as the session's clock shows it
                rows = rows.set_column(k, c, pc.local_timestamp(rows.column(k).cast(pa.timestamp("us", zone))))
        listed = sorted(rows.to_pylist(), key=lambda r: (r[order] is None, r[order]))
        return [{f: r.get(f) for f in fields} for r in listed]

    def fold(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        own = Memories(records(old, "id"), at, threshold, keep_days)
        for c in records(new, "ord"):
            own.take(c)
        n = len(own.rows)
        made = {f: pa.array([r[f] for r in own.rows], t) for f, t in fields.items()}
        made |= {f: pc.assume_timezone(made[f], zone, ambiguous="earliest", nonexistent="latest").cast(pa.timestamp("us", "UTC")) for f, t in fields.items() if pa.types.is_timestamp(t)}
        counts = {c: pa.array([own.actions.count(c)] * n, pa.int32()) for c in ("inserted", "merged", "superseded")}
        return pa.table({user: pa.array([key[0].as_py()] * n, key[0].type)} | made | counts)

    kind = state.schema[user].dataType.simpleString()
    candidates = candidates.select(*[F.col(c).alias(c) for c in candidates.columns])  # own columns, also where both come from one table
    whole = state.select(F.col(user), *[(F.col(c.split(" ", 1)[0]) if c.split(" ", 1)[0] in state.columns else F.lit(None)).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in MEMORY.split(", ")])
    # users cost time, not bytes, by which partitions would be joined
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    both = whole.repartition(tasks, user).groupBy(user).cogroup(candidates.repartition(tasks, user).groupBy(user))
    return both.applyInArrow(fold, f"{user} {kind}, {MEMORY}, inserted int, merged int, superseded int")


def memory_context(memories: DataFrame, *, group: str) -> DataFrame:
    """group, context: what the memories that matter for a search say, in a stable order."""
    words = F.col("content").rlike("|".join(LITERATURE_WORDS))
    useful = F.col("subtype").isin("research", "task", "terminology", "background") | ((F.col("subtype") == "preference") & words)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("subtype", F.coalesce("memory_key", F.lit("")).alias("k"), "id", "content"))), lambda m: m["content"])
    return memories.where(useful).groupBy(group).agg(F.array_join(listed, "；").alias("context"))


def format_memories(memories: DataFrame, *, group: str) -> DataFrame:
    line = F.concat(F.lit("- ["), "memory_type", F.lit("/"), "subtype", F.lit("] "), "content")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("memory_type", "subtype", F.coalesce("memory_key", F.lit("")).alias("k"), "id", line.alias("line")))), lambda m: m["line"])
    return memories.groupBy(group).agg(F.array_join(listed, "\n").alias("text"))


def relevant_turns(turns: DataFrame, *, embedding: str, asked: str, threshold: float) -> DataFrame:
    """Messages of a window (see recent_turns) that are like what is asked (a column of each row); all where there is no
    embedding of it."""
    like = cosine(F.col(embedding), F.col(asked))
    return turns.where(F.col(asked).isNull() | (F.round(like, 6) >= threshold))


def session_library(sessions: DataFrame, given: DataFrame, *, session: str, group: str) -> DataFrame:
    """session, group: the library that a request names, else that of its session; null where neither is known."""
    known = sessions.select(F.col(session).alias("_s"), F.col(group).alias("_g"))
    met = given.join(known, F.col(session) == F.col("_s"), "left")
    return met.select(session, F.coalesce(group, "_g").alias(group))


def recent_turns(messages: DataFrame, *, session: str, order: str, turns: int) -> DataFrame:
    """The last 2 * turns messages of each session, with their position (from 1) in order."""
    last = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return messages.withColumn("_n", last).where(F.col("_n") <= 2 * turns).drop("_n").withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(order)))


def drop_repeats(messages: DataFrame, question_key: Column, *, session: str, order: str, role: str, message_key: Column) -> DataFrame:
    """Messages without the user turns that ask the question again and the first reply after each."""
    rows = messages.withColumn("_user", F.col(role) == "user").withColumn("_repeat", F.col("_user") & (message_key == question_key))
    window = Window.partitionBy(session).orderBy(order)
    run = F.sum(F.col("_user").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_run", run)
    flagged = rows.withColumn("_after", F.max("_repeat").over(Window.partitionBy(session, "_run"))).withColumn("_reply", F.sum((F.col(role) == "assistant").cast("int")).over(Window.partitionBy(session, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    first_reply = (F.col(role) == "assistant") & (F.col("_reply") == 1) & (F.col("_run") > 0)
    return flagged.where(~F.col("_repeat") & ~(first_reply & F.col("_after"))).drop("_user", "_repeat", "_run", "_after", "_reply")
