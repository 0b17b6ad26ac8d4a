"""Repeated passages, repair of conversations and manifests, against plain, slow versions and on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.llm import merkle, repair, repeats

SF = "/root/testdata/sf0.001"
CLASHES = ("id", "key", "grp", "idx", "digest", "path", "top", "row", "spans", "k1", "first", "bucket", "kept_text", "level")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 -----------------------------------------------------------------------------------------------------------------


def plain_repeats(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    times = Counter(tuple(ws[i : i + window]) for ws in words for i in range(len(ws) - window + 1))
    out = []
    for ws in words:
        gone = {p for i in range(len(ws) - window + 1) if times[tuple(ws[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((" ".join(w for k, w in enumerate(ws) if k not in gone), len(ws), len(gone)))
    return out


def passages(seed=0):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["a", "b", "ç", "日本語", "x" * 40]) + str(k) for k in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, other = text(14), text(9)
    texts = [" ".join(text(rng.randrange(0, 60))) for _ in range(40)]
    texts += [" \n".join(text(5) + common + text(rng.randrange(4))) for _ in range(60)]  # one passage in most of the texts
    texts += ["\t".join(text(3) + other + text(2) + other), " ".join(other[1:] + text(3)), " ".join(["same"] * 50)]
    return texts + [None, "", " \t\n", "a b c", texts[3], texts[3], "\x00 \x1f " * 20, "one two three four five " * 2000]


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 400, "limit_bytes": 900}, {"bucket_bytes": 400, "limit_bytes": 900, "most_hot": 3}, {"bucket_bytes": 1 << 30, "limit_bytes": 200, "most_hot": 1}])
def test_repeats_are_those_of_all_windows(spark, sizes):
    """Gathered buckets, buckets too large to gather, and hot ones that leave as digests at once."""
    texts = passages()
    rows = spark.createDataFrame([(None if k % 17 == 0 else k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumns({c: F.lit("z") for c in CLASHES})
    got = repeats.without_repeats(rows, window=7, **sizes)
    assert sorted((r.kept_text, r.n_words, r.n_removed) for r in got.collect()) == sorted(plain_repeats(texts, 7))
    assert set(got.columns) == set(rows.columns) | {"kept_text", "n_words", "n_removed"}
    assert repeats.without_repeats(rows.where("doc_id = -1"), window=7).count() == 0


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(repeats, "window_hashes", lambda words, starts, window: np.zeros(len(starts), np.uint64))
    strings = [b"a b c d", b"x a b c", b"p q r"]
    assert sorted(repeats.repeated_windows(strings, np.array([1, 1, 1]), 3)) == [(0, 0, 0), (1, 1, 1)]
    assert sorted(repeats.repeated_windows(strings, np.array([1, 1, 2]), 3)) == [(0, 0, 0), (1, 1, 1), (2, 0, 0)]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 32])
def test_sliding_least(width):
    values = np.random.default_rng(1).integers(0, 1000, 200)
    assert repeats._least(values, width).tolist() == [values[i : i + width].min() for i in range(200 - width + 1)]


# 12 -----------------------------------------------------------------------------------------------------------------


def faults_of(rows):
    found, seen = [], set()
    for role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")[-1:]
        found.append("b" if not end else "d" if (role, text) in seen else "" if end in ".!?" else "t")
        seen.add((role, text))
    return found


def plain_repair(rows):
    """Every way to edit: least cost, then the least audit; and the text that it gives."""
    found, ways = faults_of(rows), set()

    def go(k, cost, audit, out):
        if cost > 3 * len(rows):  # deleting all costs that
            return
        initials = "".join(r[:1] for r, _ in out)
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            ways.add((cost, audit, "\n".join(f"{r}:{t}" for r, t in out)))
        for r in ("user", "assistant"):
            go(k, cost + 2, audit + "I", [*out, (r, "")])
        if k < len(rows):
            role, text = rows[k]
            go(k + 1, cost + 3, audit + "D", out)
            if found[k] not in ("b", "d"):
                more = found[k] == "t"
                if role[:1] in ("s", "u", "a"):
                    go(k + 1, cost + more, audit + "K", [*out, rows[k]])
                for r in ("user", "assistant"):
                    go(k + 1, cost + 2 + more, audit + "R", [*out, (r, text)])

    go(0, 0, "", [])
    cost, audit, text = min(ways)
    assert len({w for w in ways if w[:2] == (cost, audit)}) == 1
    return cost, audit, sha(text)


def conversations(n=60, longest=5):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", "umpire"], ["Yes.", "No", " ", "", "Why? ", "end!\n", "日本。"]
    for c in range(n):
        for t in range(rng.randrange(1, longest + 1)):
            yield c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts)


def test_repairs_are_the_cheapest(spark):
    rows = list(conversations())
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("z") for c in CLASHES})
    found = repair.repair(turns)
    got = {r.conv_id: r for r in found.collect()}
    by_conv = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        by_conv[c].append((t, r, x))
    assert set(got) == set(by_conv)
    said = defaultdict(list)
    for r in repair.repaired_turns(turns, found).orderBy("conv_id", "place").collect():
        said[r.conv_id].append(f"{r.role}:{r.text}")
    for c, all_of in by_conv.items():
        own = [(r, x) for _, r, x in all_of]
        numbers = {t for t, _, _ in all_of if t is not None}
        faults = Counter(faults_of(own))
        want = plain_repair(own)
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == want
        assert (got[c].blank, got[c].duplicate, got[c].truncated) == (faults["b"], faults["d"], faults["t"])
        assert got[c].gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert got[c].illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        assert sha("\n".join(said[c])) == want[2]


def test_long_conversations_put_their_letters_away():
    """Against carrying whole audits; unknown roles keep several audits alive to the end."""
    rng = random.Random(2)
    for roles in (["tool"], ["user", "assistant"], ["system", "user", "tool"]):
        rows = [(rng.choice(roles), "Said." if rng.random() < 0.8 else "") for _ in range(3000)]
        paths = repair.Paths()
        add = lambda x, cost, letter: x and (x[0] + cost, x[1] + letter)
        least = lambda *xs: min((x for x in xs if x), default=None)

        def closed(n, s, u, a):
            u = least(u, add(least(n, s, a), 2, "I"))
            return n, s, u, least(a, add(u, 2, "I"))

        n, s, u, a = closed((0, ""), None, None, None)
        for role, text in rows:
            paths.turn(role, text, "" if text else "blank")
            before, ok = least(n, s, a), bool(text)
            layer = (
                add(n, 3, "D"), least(add(s, 3, "D"), ok and role == "system" and add(n, 0, "K") or None),
                least(add(u, 3, "D"), ok and add(before, 0, "K") if role == "user" else None, ok and add(before, 2, "R") or None),
                least(add(a, 3, "D"), ok and add(u, 0, "K") if role == "assistant" else None, ok and add(u, 2, "R") or None),
            )
            n, s, u, a = closed(*layer)
        assert paths.best()[:2] == least(n, a)


def test_repair_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, 1, "system", "x" * 300_000 + "."), (2, 5, "user", "Hi."), (2, 9, "assistant", "Ho.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.repair(turns).collect()}
    assert (got[None].blank, got[None].duplicate, got[None].gaps, got[None].audit, got[None].cost) == (1, 1, 0, "DDKI" if got[None].audit[1] == "D" else "DKDI", 8)
    assert (got[1].audit, got[1].repaired_sha256) == ("D", sha("")) and (got[2].audit, got[2].gaps) == ("KK", 3)
    assert repair.repair(turns.where("conv_id = 9")).count() == 0


# 13 -----------------------------------------------------------------------------------------------------------------


def plain_tree(nodes, fanout):
    """The top, and for each node its siblings on either side, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // fanout * fanout
            paths[k].append((level[first:i], level[i + 1 : first + fanout]))
            at[k] = i // fanout
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_is_that_of_plain_trees(spark, fanout):
    rng = random.Random(fanout)
    rows = [(k // 2 if k % 9 else None, rng.choice(["hot"] * 6 + [None, "", "é", "z", "Z"]), "en", k, rng.choice(["Text", "text", None, "", "ß" * 5000])) for k in range(150)] + [(7, "lone", None, None, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("z") for c in CLASHES})
    got = merkle.manifest(docs, keep={"source": F.col("source")}, fanout=fanout)
    assert got.count() == len(rows)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for *_, leaf in sorted(groups[s])], fanout) for s in names}
    root, upper = plain_tree([trees[s][0] for s in names], fanout)
    want = []
    for s, more in zip(names, upper):
        for (known, i, leaf), path in zip(sorted(groups[s]), trees[s][1]):
            want.append((s or "", i if known else -1, leaf, trees[s][0], root, [x for a, b in path + more for x in a + b]))
    hexes = lambda path: [bytes(x).hex() for run in path for x in [*run.before, *run.after]]
    said = got.collect()
    assert sorted((r.source or "", -1 if r.id is None else r.id, r.leaf, r.subroot, r.root, hexes(r.path)) for r in said) == sorted(want)
    folded = got.select(merkle.folded(F.col("leaf"), F.col("path")).alias("f"), merkle.folded(F.sha2(F.lit("x"), 256), F.col("path")).alias("g"), "root")
    assert folded.where("f = root").count() == len(rows) and folded.where("g = root").count() == 0


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = merkle.manifest(docs.limit(1)).first()
    assert one.leaf == one.subroot == one.root and one.path == []
    assert merkle.manifest(docs.where("doc_id = -1")).count() == 0
