"""The queries of the training-data operators, one for each, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, chat, decontaminate, licenses, merkle, pii, quality, repair, repeats, simhash, toxicity, urlfilter, warc
from .common import lower_ascii


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words that stand in a window of the benchmark."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    rows = decontaminate.report(found)
    return rows.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM w),
p AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks)),
h AS (SELECT doc_id, i, p.k, item_id FROM p JOIN w ON p.k = w.k AND p.gram = w.gram),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on labels outside the held-out quarter; scores every document."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity.with_scores(docs, network, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and found again through the index."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1), '' ORDER BY i) FROM range(32) AS t(i)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licenses that it names or holds."""
    return licenses.with_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts made of all conversations, parsed by a model of the labelled turns of three quarters of them."""
    turns = chat.as_transcripts(table(spark, sf_dir, "conversations"))
    held = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 4 == 2, F.lit(False))
    model = chat.fit(turns.where(~held), conv="conv_id", place="turn", text="block", role="role")
    return chat.parse(turns, model, conv="conv_id", place="turn", text="block")


#: Hosts and path prefixes with their verdicts.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the longest rule that fits its URL."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, verdict)")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


OP7_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS r, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC) = 1
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates, by the session's key (or one of this run's own)."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key=pii.key_of(spark), keep=["doc_id"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the base counts and whether the line rules keep it."""
    return quality.with_quality(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("clean_text")


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)),
f AS (SELECT r, len(ws) AS w, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again,
             length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS s, length(regexp_replace(line, '[^|]', '', 'g')) AS bars,
             length(regexp_replace(line, '\P{{Lu}}', '', 'g')) AS up, length(array_to_string(ws, '')) AS filled,
             len(list_filter(range(2, len(ws) + 1), lambda j: ws[j] = ws[j - 1])) AS same,
             regexp_matches(lower(line), '{"|".join(quality.BOILERPLATE).replace("'", "''")}') AS boiler,
             regexp_matches(line, '[.!?:;,)"''…。！？：；，）»”’][\x20\x09-\x0D]*$') AS ended
      FROM l WHERE len(ws) > 0),
b AS (SELECT r, sum(w) AS n_words, sum(filled) AS word_chars, sum(again::INT) AS n_dup_lines,
             sum(w) FILTER (again OR bars >= 3 OR 10 * s > 3 * w OR 2 * up > filled OR (w >= 10 AND 2 * same > w) OR boiler OR (w < {quality.UNPUNCTUATED} AND NOT ended)) AS lost FROM f GROUP BY r),
a AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM a)),
q AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM g WHERE k > 1) GROUP BY r),
c AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words FROM d LEFT JOIN b USING (r) LEFT JOIN q USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_lost_words <= n_words AS kept FROM c
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of tokens and digests of the ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])

#: An unsigned crc32 in SQL, of a text of ASCII characters: bytes by folding, bits by folding.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of words, of those that stand in repeated windows, and a digest of the others."""
    done = repeats.without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
c AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY gram) > 1),
h AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM c),
u AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN h USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations with planted faults: by a checksum of its number, a turn is dropped, emptied, bereft of its
    full stops, repeated, or given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with its faults and its cheapest repair."""
    turns = table(spark, sf_dir, "conversations")
    found = repair.repair(damaged(turns)).withColumnRenamed("conv_id", "r_conv_id")
    met = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("r_conv_id")), "left").drop("r_conv_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return met.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair_sql() -> str:
    """The four states are texts of nine digits of cost and the audit, so that the least one is the cheapest."""
    add = lambda x, cost, letter: f"(lpad((left({x}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}')"
    crc = CRC32_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    kept = lambda c, x: f"CASE WHEN ok AND c = '{c}' THEN {add(x, 't', 'K')} END"
    rerole = lambda x: f"CASE WHEN ok THEN {add(x, '2 + t', 'R')} END"
    before_user = "least(n, s, a)"
    return f"""
WITH RECURSIVE c AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g, {crc} % 20 AS k FROM conversations),
e AS (SELECT g, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text FROM c WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i,
             lag(left(role, 1)) OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) || left(role, 1) AS pair FROM e),
f AS (SELECT *, left(role, 1) AS c, fault <> 'b' AND fault <> 'd' AS ok, (fault = 't')::BIGINT AS t FROM (SELECT *,
             row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM o)),
p AS (SELECT g, 0::BIGINT AS i, '000000000' AS n, NULL::VARCHAR AS s, '000000002I' AS u, '000000004II' AS a FROM (SELECT DISTINCT g FROM f)
      UNION ALL
      SELECT g, i, n, s, u2, least(a, {add("u2", 2, "I")}) FROM (SELECT *, least(u, {add(before_user, 2, "I")}) AS u2 FROM
        (SELECT p.g, f.i, {add("n", 3, "D")} AS n, least({add("s", 3, "D")}, {kept("s", "n")}) AS s,
                least({add("u", 3, "D")}, {kept("u", before_user)}, {rerole(before_user)}) AS u, least({add("a", 3, "D")}, {kept("a", "u")}, {rerole("u")}) AS a
         FROM p JOIN f ON p.g = f.g AND f.i = p.i + 1))),
w AS (SELECT g, left(x, 9)::BIGINT AS cost, substr(x, 10) AS audit FROM (SELECT g, least(n, a) AS x FROM p QUALIFY i = max(i) OVER (PARTITION BY g))),
l AS (SELECT g, unnest(range(1, length(audit) + 1)) AS pos, unnest(string_split(audit, '')) AS letter FROM w WHERE audit <> ''),
m AS (SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY g ORDER BY pos) AS i, sum((letter <> 'D')::INT) OVER (PARTITION BY g ORDER BY pos) AS q, sum((letter <> 'D')::INT) OVER (PARTITION BY g) AS total FROM l),
r AS (SELECT m.g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (q + total) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired
      FROM m LEFT JOIN f ON m.g = f.g AND m.i = f.i AND letter <> 'I' WHERE letter <> 'D' GROUP BY m.g),
k AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM c) LEFT JOIN k USING (g) LEFT JOIN w USING (g) LEFT JOIN r USING (g)
"""


OP12_SQL = repair_sql()


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot and proof, and the root that a copy leads to of which a fifth of the texts is changed."""
    docs = table(spark, sf_dir, "documents")
    lowered = [lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.unhex(merkle.leaf_of(lowered)))
    rows = merkle.manifest(docs, keep={"changed": changed})
    refolded = rows.withColumn("folded_root", merkle.folded(F.coalesce(F.lower(F.hex("changed")), "leaf"), F.col("path")))
    proof = merkle.digest_of(merkle.siblings(F.col("path")))
    return refolded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def merkle_sql(depth: int, top_depth: int) -> str:
    """For up to 16 ** depth documents of a source and 16 ** top_depth sources."""
    value = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    fields = lambda text: "sha256(" + " || ".join(value(text if f == "text" else f) for f in merkle.FIELDS) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, {fields("text")} AS leaf,
  CASE WHEN {CRC32_SQL.format("doc_id::VARCHAR")} % 5 = 0 THEN {fields(lowered)} ELSE {fields("text")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
a0 AS (SELECT g, i, leaf AS h, n FROM placed)"""
    ]

    def level(k: str, up: str) -> None:
        run = f"OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        steps.append(f"""s{k} AS (SELECT g, i, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {k} WHERE n > 1)""")
        steps.append(f"{up} AS (SELECT g, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 15) // 16 AS n FROM {k} WHERE n > 1 GROUP BY g, i // 16, n)")

    for k in range(depth):
        level(f"a{k}", f"a{k + 1}")
    steps.append("tops AS (" + " UNION ALL ".join(f"SELECT g, h FROM a{k} WHERE n = 1" for k in range(depth + 1)) + ")")
    steps.append("b0 AS (SELECT 0 AS g, g - 1 AS i, h, count(*) OVER () AS n FROM tops)")
    for k in range(top_depth):
        level(f"b{k}", f"b{k + 1}")
    steps.append("root AS (" + " UNION ALL ".join(f"SELECT h FROM b{k} WHERE n = 1" for k in range(top_depth + 1)) + ")")
    steps.append("f0 AS (SELECT *, changed AS f, '' AS p FROM placed)")
    runs = [(f"sa{k}", f"s.g = f.g AND s.i = f.i // {16**k}") for k in range(depth)] + [(f"sb{k}", f"s.i = (f.g - 1) // {16**k}") for k in range(top_depth)]
    for k, (s, on) in enumerate(runs):
        steps.append(f"f{k + 1} AS (SELECT f.* EXCLUDE (f, p), CASE WHEN s.i IS NULL THEN f.f ELSE sha256(s.l || f.f || s.r) END AS f, p || coalesce(s.l || s.r, '') AS p FROM f{k} f LEFT JOIN {s} s ON {on})")
    last = f"SELECT doc_id, leaf, t.h AS subroot, root.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM f{len(runs)} f JOIN tops t USING (g), root"
    return "WITH " + ",\n".join(steps) + "\n" + last


OP13_SQL = merkle_sql(6, 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_licenses": op5_licenses,
    "op6_chat": op6_chat,
    "op7_url_filter": op7_url_filter,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_repeats": op11_repeats,
    "op12_repair": op12_repair,
    "op13_merkle": op13_merkle,
}
QUERY_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op4_warc": OP4_SQL, "op7_url_filter": OP7_SQL, "op9_quality": OP9_SQL, "op11_repeats": OP11_SQL, "op12_repair": OP12_SQL, "op13_merkle": OP13_SQL}
