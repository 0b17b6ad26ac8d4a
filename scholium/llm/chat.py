"""Transcripts to chat turns: a hidden Markov model over line features finds the roles, by Viterbi.

A transcript is a sequence of blocks of lines. States are a role's first line and its further lines; a line's
features are its speaker marker (of a user, an assistant, a system, a bare dash, an unknown speaker, or none), whether it
begins a block, whether it asks, and its length class. The model's tables are counted, with add-one smoothing, on a
bounded sample of labelled blocks and their first lines. Turns are rendered in one canonical form, without the markers
that name their speaker; what only looks like a marker ("The answer: 42") stays.

Sequences are dealt by ranges of (conversation, place), so a conversation of any length may lie in many tasks. Each
task sums up the parts of conversations that it does not hold whole as max-plus matrices; the driver finds the states
at those parts' ends (two parts a task, and one for each MAX_LINES lines), and each part is decoded between its end
states. The result is the Viterbi path of the whole conversation.

Defined cases: a null text is a block of one empty line; a null conversation or place sorts first and is a value like
others; ties in place are ordered by the text; repeated rows are repeated blocks. Labels other than user, assistant
and system teach nothing. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ready
from .common import cut, pieces

ROLES = ("user", "assistant", "system")
N = 2 * len(ROLES)
START = N
#: Labelled blocks that the model is fitted on, at most.
SAMPLE_BLOCKS = 20_000
#: Lines of each that it is fitted on, at most.
SAMPLE_LINES = 200
MAX_LINES = 50_000

_MARKERS = [
    (1, r"(?:user|human|customer|question|q)\s*[:>]\s*|<user>\s*|\[user\]\s*|#+ (?:user|instruction)\b:?\s*"),
    (2, r"(?:assistant|ai|bot|answer|a)\s*[:>]\s*|<(?:bot|assistant)>\s*|\[assistant\]\s*|#+ (?:assistant|response)\b:?\s*"),
    (3, r"(?:system|note)\s*[:>]\s*|<(?:sys|system)>\s*|\[system\]\s*|#+ system\b:?\s*"),
    (4, r"[-–—]\s+"),
    (5, r"(?-i:[A-Z])[\w.]{0,15}(?: [\w.]{1,10})?\s?(?:[:>|]|[-–—]) +"),
]
_MARKER = re.compile("|".join(f"(?P<m{k}>{p})" for k, p in _MARKERS), re.IGNORECASE)
SIZES = (6, 2, 2, 3)


def features(line: str, begins_block: bool) -> tuple[int, int, int, int]:
    m = _MARKER.match(line)
    marker = int(m.lastgroup[1:]) if m else 0
    return marker, int(begins_block), int(line.rstrip().endswith("?")), 0 if len(line) <= 40 else 1 if len(line) <= 200 else 2


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


class Model:
    """Log tables: first[state], step[state, state] and one table of emissions for each feature."""

    def __init__(self, first: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        # a conversation and a change of role begin with a first line; a further line follows its own role
        allowed = np.array([[j % 2 == 0 or j // 2 == i // 2 for j in range(N)] for i in range(N)])
        first_ok = np.arange(N) % 2 == 0
        logs = lambda counts, ok: np.where(ok, np.log((counts + 1) * ok / ((counts + 1) * ok).sum(axis=-1, keepdims=True) + 1e-300), -np.inf)
        self.step = np.vstack([logs(step, allowed), logs(first, first_ok)[None]])  # START is the last row
        self.emit = [np.log((c + 1) / (c + 1).sum(axis=1, keepdims=True)) for c in emit]

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """(lines, states)."""
        return sum(table.T[seen[:, k]] for k, table in enumerate(self.emit))

    def matrix(self, seen: np.ndarray) -> np.ndarray:
        """(N + 1, N): the best score from a state before the lines to a state at the last."""
        emits = self.scores(seen)
        out = self.step + emits[0]
        for e in emits[1:]:
            out = (out[:, :, None] + self.step[None, :N]).max(axis=1) + e
        return out

    def decode(self, seen: np.ndarray, entry: int = START, leave: int | None = None) -> np.ndarray:
        emits = self.scores(seen)
        best = self.step[entry] + emits[0]
        back = np.zeros((len(seen), N), np.int8)
        for t in range(1, len(seen)):
            reach = best[:, None] + self.step[:N]
            back[t] = reach.argmax(axis=0)
            best = reach.max(axis=0) + emits[t]
        path = np.empty(len(seen), np.int64)
        path[-1] = best.argmax() if leave is None else leave
        for t in range(len(seen) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def fit(labelled: DataFrame, *, conv: str, place: str, text: str, role: str, sample_blocks: int = SAMPLE_BLOCKS, sample_lines: int = SAMPLE_LINES) -> Model:
    """The model of the first sample_blocks blocks by a hash of the conversation; only line features are sorted and gathered."""
    ready(labelled.sparkSession)
    rows = labelled.select(F.xxhash64(F.col(conv).cast("string")).alias("h"), F.col(conv).cast("string").alias("conv"), F.col(place).alias("place"), F.col(role).alias("role"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            marks = [[v for k, line in enumerate(lines_of(t)[:sample_lines]) for v in features(line, k == 0)] for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(marks, pa.list_(pa.int32()))], names=["h", "conv", "place", "role", "tag", "marks"])

    kind = rows.schema["place"].dataType.simpleString()
    marked = rows.mapInArrow(seen, f"h long, conv string, place {kind}, role string, tag long, marks array<int>")
    gathered = marked.orderBy("h", "conv", "place", "tag").limit(sample_blocks).collect()
    first, step, emit = np.zeros(N), np.zeros((N, N)), [np.zeros((N, size)) for size in SIZES]
    before, last = None, None
    for r in sorted(gathered, key=lambda r: (r["h"], r["conv"] is not None, r["conv"] or "", r["place"] is not None, r["place"] if r["place"] is not None else 0)):
        if r["conv"] != before or r["h"] is None:
            before, last = r["conv"], START
        if r["role"] not in ROLES:
            last = None
            continue
        state = 2 * ROLES.index(r["role"])
        for k, marks in enumerate(np.array(r["marks"]).reshape(-1, len(SIZES))):
            now = state + (k > 0)
            if last == START:
                first[now] += 1
            elif last is not None:
                step[last, now] += 1
            last = now
            for f, v in enumerate(marks):
                emit[f][now, v] += 1
    return Model(first, step, emit)


def _parts(batches: Iterator[pa.RecordBatch], max_lines: int) -> Iterator[tuple[int, object, list[dict], np.ndarray, bool, bool]]:
    """(number, conversation, rows, line features, goes on a part before, is followed by another) of a task's sorted rows."""
    number, conv, rows, seen, follows, begun = 0, None, [], [], False, False
    for batch in pieces(batches):
        for r in batch.to_pylist():
            if begun and (r["conv"] != conv or len(seen) >= max_lines):
                same = r["conv"] == conv
                yield number, conv, rows, np.array(seen), follows, same
                number, rows, seen, follows = number + 1, [], [], same
            conv, begun = r["conv"], True
            rows.append(r)
            seen += [features(line, k == 0) for k, line in enumerate(lines_of(r["text"]))]
    if begun:
        yield number, conv, rows, np.array(seen), follows, False


def _ends(model: Model, max_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out = lambda p: pa.RecordBatch.from_pylist([{"task": p[2][0]["task"], "part": p[0], "conv": p[1], "matrix": model.matrix(p[3]).ravel().tolist()}], schema=pa.schema([("task", pa.int32()), ("part", pa.int32()), ("conv", pa.string()), ("matrix", pa.list_(pa.float64()))]))
        for part in _parts(batches, max_lines):
            if held is not None and (held[0] == 0 or held[4] or held[5]):
                yield out(held)
            held = part
        if held is not None:
            yield out(held)  # the first, the last, and what is not whole

    return run


def _end_states(rows: list) -> dict[tuple[int, int], tuple[int, int]]:
    """(task, part) -> states before its first line and at its last, for the best path of each conversation."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    rows = sorted(rows, key=lambda r: (r["task"], r["part"]))
    k = 0
    while k < len(rows):
        end = k
        while end < len(rows) and rows[end]["conv"] == rows[k]["conv"]:
            end += 1
        best, backs = None, []
        for r in rows[k:end]:
            m = np.array(r["matrix"]).reshape(N + 1, N)
            reach = m[START][None] if best is None else best[:, None] + m[:N]
            backs.append(reach.argmax(axis=0))
            best = reach.max(axis=0)
        state = int(best.argmax())
        for j in range(end - 1, k - 1, -1):
            before = START if j == k else int(backs[j - k][state])
            found[(rows[j]["task"], rows[j]["part"])] = (before, state)
            state = before
        k = end
    return found


#: What a decoded block is: its first role, whether it begins a turn, how many turns begin in it, and its lines: head
#: ("<|role|>" and a line break where a turn begins), a marker that may be a name, that name, and the rest.
OUT = "role string, begins_turn boolean, n_turns long, lines array<struct<head:string,mark:string,name:string,body:string>>"
LINES = pa.list_(pa.struct([(c, pa.string()) for c in ("head", "mark", "name", "body")]))
_NAME_END = re.compile(r"\s?[:>|]? *$|\s?[-–—] +$")


def read_lines(lines: list[str], path: list[int]) -> tuple[str, bool, int, list[dict]]:
    """OUT of a block. A marker goes at once where it names the speaker that the model has found; one that may be an unknown speaker's name stays beside it, for named to decide; all else is text."""
    out, begun = [], 0
    for line, state in zip(lines, path, strict=True):
        m = _MARKER.match(line) if state % 2 == 0 else None
        kind = int(m.lastgroup[1:]) if m else 0
        head = f"<|{ROLES[state // 2]}|>\n" if state % 2 == 0 else ""
        begun += state % 2 == 0
        if kind == state // 2 + 1:
            body, mark, name = line[m.end() :], None, None
            if not body:
                out.append({"head": head, "mark": None, "name": None, "body": None})  # a marker alone on its line
                continue
        elif kind in (4, 5):
            body, mark, name = line[m.end() :], m[0], _NAME_END.sub("", m[0])
        else:
            body, mark, name = line, None, None
        out.append({"head": head, "mark": mark, "name": name, "body": body})
    return ROLES[path[0] // 2], path[0] % 2 == 0, begun, out


def named(blocks: DataFrame, *, conv: str) -> DataFrame:
    """blocks with rendered for lines: markers go whose name opens several turns of a conversation; others are text.

    Joining the renderings of a conversation's blocks in order renders the conversation: a turn is "<|role|>", a line
    break, and its lines, each followed by a line break."""
    said = blocks.select(F.col(conv).alias("n_conv"), F.explode(F.filter("lines", lambda x: x["name"].isNotNull())).alias("line"))
    often = said.groupBy("n_conv", F.col("line.name").alias("name")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    names = often.groupBy("n_conv").agg(F.collect_list("name").alias("names"))
    met = blocks.join(names, F.col(conv).eqNullSafe(F.col("n_conv")), "left")
    goes = lambda x: x["name"].isNotNull() & F.coalesce(F.array_contains("names", x["name"]), F.lit(False))
    kept = lambda x: F.when(goes(x), "").otherwise(F.coalesce(x["mark"], F.lit("")))
    alone = lambda x: x["body"].isNull() | (goes(x) & (x["body"] == ""))
    line = lambda x: F.concat(x["head"], F.when(alone(x), "").otherwise(F.concat(kept(x), F.coalesce(x["body"], F.lit("")), F.lit("\n"))))
    return met.withColumn("rendered", F.array_join(F.transform("lines", line), "")).drop("lines", "n_conv", "names")


def _decoder(model: Model, max_lines: int, known, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, rows, seen, _, _ in _parts(batches, max_lines):
            entry, leave = known.value.get((rows[0]["task"], number), (START, None))
            path, at, done = model.decode(seen, entry, leave).tolist(), 0, []
            for r in rows:
                lines = lines_of(r["text"])
                done.append(read_lines(lines, path[at : at + len(lines)]))
                at += len(lines)
            columns = [pa.array([r["conv"] for r in rows], pa.string()), pa.array([r["place"] for r in rows], kind), *[pa.array([d[k] for d in done]) for k in range(3)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[3] for d in done], LINES)], names=["conv", "place", "role", "begins_turn", "n_turns", "lines"])

    return run


def parse(transcripts: DataFrame, model: Model, *, conv: str, place: str, text: str, max_lines: int = MAX_LINES) -> DataFrame:
    """conv, place, role, begins_turn, n_turns, rendered for each block of the transcripts."""
    spark = ready(transcripts.sparkSession)
    kind = transcripts.schema[conv].dataType
    rows = transcripts.select(F.col(conv).cast("string").alias("conv"), F.col(place).alias("place"), F.col(text).alias("text"))
    dealt = cut(rows.repartitionByRange("conv", "place", F.xxhash64("text")).sortWithinPartitions("conv", "place", "text").withColumn("task", F.spark_partition_id()))
    ends = dealt.mapInArrow(_ends(model, max_lines), "task int, part int, conv string, matrix array<double>").collect()
    known = spark.sparkContext.broadcast(_end_states(ends))
    place_type = dealt.schema["place"].dataType
    read = cut(dealt.mapInArrow(_decoder(model, max_lines, known, to_arrow_type(place_type)), f"conv string, place {place_type.simpleString()}, {OUT}"))
    out = named(read, conv="conv")
    return out.select(F.col("conv").cast(kind).alias(conv), F.col("place").alias(place), "role", "begins_turn", "n_turns", "rendered")


#: Markers by style and role, for transcripts made of labelled turns. The last two styles name speakers that no marker knows.
STYLES = [("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "[system] "), ("Q: ", "A: ", "Note: "), ("### User\n", "### Assistant\n", "### System\n"), ("<user> ", "<bot> ", "<sys> "), ("- ", "- ", "- "), ("Caller | ", "Desk | ", "Log | "), ("Kim – ", "Helper 2 – ", "Setup – ")]


def as_transcripts(turns: DataFrame, *, conv: str = "conv_id", place: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns with a column block: the text behind its speaker's marker, in the conversation's style, a quarter unmarked."""
    style = F.pmod(F.xxhash64(conv), F.lit(len(STYLES)))
    marker = F.lit("")
    for s, marks in enumerate(STYLES):
        for r, mark in zip(ROLES, marks, strict=True):
            marker = F.when((style == s) & (F.col(role) == r), F.lit(mark)).otherwise(marker)
    bare = F.pmod(F.xxhash64(conv, place), F.lit(4)) == 0
    return turns.withColumn("block", F.concat(F.when(bare, F.lit("")).otherwise(marker), F.coalesce(F.col(text), F.lit(""))))
