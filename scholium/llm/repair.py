"""Repair of conversations: the cheapest edits that give a system turn at most and then pairs of user and assistant.

A conversation's turns, in order, are a text over role initials; the grammar is (s?(ua)+)?. Its four states are nothing
yet, a system turn, a user's and an assistant's. A forward Viterbi pass goes over the turns and carries, for each state,
the least (cost, audit): what the cheapest edits cost and, among equally cheap ones, the edits' initials that come first
in ASCII order. A turn is kept, gets another role, or is deleted; then inserts close the layer: one user's turn, and one
assistant's behind it, as more inserts lead back to a state that was cheaper. Audits of equal cost over the same turns
are never one another's beginnings, so the order of two audits outlasts what both are continued with.

Conversations stream through a task in the order of their turns, and nothing is gathered for them: a path is its cost,
the last letters of its audit, a link to what comes before, and the state of the hash over its repaired text. What is
kept of a conversation is its audit. The turns of one conversation, however many, pass one task, as a hash over them all
is made in their order; their sorting spills to disk. Which turns repeat an earlier one is counted by Spark before.

Defined cases: nulls in role and text are one space, so such a role cannot be kept and such a text is blank. An empty
role cannot be kept either. Turns without a number come first. Turns that share a number go by role and text. A null
conversation id is a conversation. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ordered import running
from ..session import ready

#: What edits cost, and what a kept turn costs that has no end.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK = " \t\n\v\f\r"
ENDS = ".!?"
#: States, and which may follow: nothing yet, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIAL = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
NAME = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {NOTHING: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
LEGAL = {"su", "ua", "au"}
#: Turns after which the audits' letters are put away.
SETTLE = 512


class Paths:
    """The cheapest path to each state: (cost, rank, letters, before, hash).

    before: a link to the letters put away; rank: its place among those of the live paths."""

    def __init__(self) -> None:
        self.live: list[tuple | None] = [(0, 0, "", None, hashlib.sha256()), None, None, None]
        self.turns = 0
        self._close()

    def _moved(self, state: int, cost: int, letter: str) -> tuple | None:
        path = self.live[state]
        return path and (path[0] + cost, path[1], path[2] + letter, path[3], path[4], state)

    @staticmethod
    def _hashed(path: tuple, piece: bytes | None) -> tuple:
        """The path with the piece added to its hash, on a line of its own."""
        digest, came_from = path[4], path[5]
        if piece is not None:
            digest = digest.copy()
            digest.update(b"\n" + piece if came_from != NOTHING else piece)
        return (*path[:4], digest)

    def _close(self) -> None:
        for state, sources in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            found = [m for s in sources if (m := self._moved(s, INSERT, "I"))]
            best = min(found, key=lambda m: m[:3], default=None)
            if best and (self.live[state] is None or best[:3] < self.live[state][:3]):
                self.live[state] = self._hashed(best, f"{NAME[state]}:".encode())

    def turn(self, role: str, text: str, fault: str) -> None:
        offers: list[list[tuple]] = [[], [], [], []]
        for state in range(4):
            if self.live[state] is None:
                continue
            offers[state].append((self._moved(state, DELETE, "D"), None))
            if fault in ("blank", "duplicate"):
                continue
            more = TRUNCATED if fault == "truncated" else 0
            for after in FOLLOWS[state]:
                if role[:1] == INITIAL[after]:
                    offers[after].append((self._moved(state, more, "K"), role))
                elif after in NAME:
                    offers[after].append((self._moved(state, REROLE + more, "R"), NAME[after]))
        layer: list[tuple | None] = []
        for found in offers:
            best = min(found, key=lambda o: o[0][:3], default=None)
            layer.append(best and self._hashed(best[0], None if best[1] is None else f"{best[1]}:{text}".encode()))
        self.live = layer
        self.turns += 1
        if self.turns % SETTLE == 0:
            self._settle()
        self._close()

    def _settle(self) -> None:
        """Puts the letters away. All audits end with a turn's edit here, so that two are equal or differ in a letter."""
        ranks = {key: k for k, key in enumerate(sorted({p[1:3] for p in self.live if p}))}
        self.live = [p and (p[0], ranks[p[1:3]], "", (p[3], p[2]), p[4]) for p in self.live]

    def best(self) -> tuple[int, str, str]:
        """cost, audit and digest of the cheapest way to end."""
        cost, _, letters, before, digest = min((p for p in (self.live[NOTHING], self.live[ASSISTANT]) if p), key=lambda p: p[:3])
        parts = [letters]
        while before:
            before, letters = before
            parts.append(letters)
        return cost, "".join(reversed(parts)), digest.hexdigest()


class Conversation:
    """Counts and paths of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.paths = Paths()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = None
        self.numbers = 0
        self.before: tuple | None = None

    def add(self, turn, role: str, text: str, later: bool) -> None:
        end = text.rstrip(BLANK)[-1:]
        same = self.before is not None and self.before == (turn, role, text)
        fault = "blank" if not end else "duplicate" if later or same else "truncated" if end not in ENDS else ""
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        if turn is not None and turn != self.last:
            self.first, self.last, self.numbers = turn if self.first is None else self.first, turn, self.numbers + 1
        self.before = (turn, role, text)
        self.paths.turn(role, text, fault)

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.numbers if self.numbers else 0
        return gaps, *self.counts.values(), *self.paths.best()


COLUMNS = T.StructType([T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")])


def _said(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and COLUMNS for each conversation of turns: its faults, and the cost, edits and digest of its repair.

    gaps: numbers that no turn has between the least and the greatest. A turn's first fault counts: blank, duplicate (its
    role and text came earlier), truncated (no full stop, exclamation or question mark at its end). illegal: neighbours
    that the grammar has not. repaired_sha256: of the repaired turns, role:text, joined by line feeds."""
    ready(turns.sparkSession)
    said = _said(turns, conv, turn, role, text).withColumn("what", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    number = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    # one row for each text that is said more than once, made before anything is shuffled by it
    first = said.groupBy(F.col("conv").alias("f_conv"), F.col("what").alias("f_what")).agg(F.min(number)["turn"].alias("first"), F.count(F.lit(1)).alias("times"))
    met = said.join(first.where("times > 1").drop("times").withColumn("again", F.lit(True)), F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("what") == F.col("f_what")), "left")
    later = F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    sorted_turns = met.select("conv", "turn", "role", "text", later.alias("later")).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *_order())
    schema = T.StructType([T.StructField("conv", sorted_turns.schema["conv"].dataType), *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), types)], names=types.names)
        key, open_one = None, None
        for batch in batches:
            done = []
            for c, *said in zip(*(column.to_pylist() for column in batch.columns)):
                if open_one is None or c != key:
                    if open_one is not None:
                        done.append((key, *open_one.row()))
                    key, open_one = c, Conversation()
                open_one.add(*said)
            if done:
                yield batch_of(done)
        if open_one is not None:
            yield batch_of([(key, *open_one.row())])

    return sorted_turns.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def repaired_turns(turns: DataFrame, repairs: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 1), role, text and edit (K, R or I) of each turn after the repair that repairs found for turns.

    The k-th piece of an audit is what happens to the k-th turn, with the inserts before it; the last may be inserts
    alone. A place's role follows from the number of places behind it, as a conversation ends with an assistant's turn."""
    said = running(_said(turns, conv, turn, role, text), by=["conv"], order=_order())
    made = F.length("audit") - F.length(F.translate("audit", "KRI", ""))
    pieces = repairs.select(F.col(f"`{conv}`").alias("conv"), made.alias("total"), F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]|I+$"), F.lit(0))).alias("k", "piece"))
    placed = running(pieces, by=["conv"], order=[F.col("k")], value=F.length(F.translate("piece", "D", ""))).select("conv", "total", "k", "piece", "_before")
    numbered = said.select(F.col("conv").alias("s_conv"), (F.col("_n") - 1).alias("s_k"), "role", "text")
    met = placed.join(numbered, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("k") == F.col("s_k")), "left")
    each = met.select("conv", "total", "role", "text", "_before", F.posexplode(F.regexp_extract_all("piece", F.lit("."), F.lit(0))).alias("at", "edit")).where("edit <> 'D'")
    place = (F.col("_before") + F.col("at") + 1).cast("long")
    named = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.when((place + F.col("total")) % 2 == 1, NAME[USER]).otherwise(NAME[ASSISTANT]))
    return each.select(F.col("conv").alias(conv), place.alias("place"), named.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")
