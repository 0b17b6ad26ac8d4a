"""What several of the training-data operators share."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ready, shared_dir


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


#: Rows of a few numbers each that make a file worth its own.
ROWS_PER_FILE = 500_000


def cut(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, written to the shared folder, without the plan that made them.

    rows: their number or a bound on it, where known; they then go to as few files as that needs."""
    shared_dir(frame.sparkSession)
    if rows is not None:
        frame = frame.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    return frame.checkpoint(eager=True)


#: The most frequent keys, whose rows are joined by broadcast; of few keys all are.
FREQUENT, WHOLE = 10_000, 20_000


def join_spread(rows: DataFrame, side: DataFrame, key: str, weight: str, *, keys: int) -> DataFrame:
    """rows with the columns of side, which has one row for each key of rows and, as weight, how many rows have it.

    keys: how many rows side has at most. Up to WHOLE it is broadcast. Of more, rows of the most frequent keys, a fixed
    number, meet theirs by broadcast and stay where they are; the others have no hot key. rows is then read twice, so it
    should be a written table; weight is dropped."""
    own = [c for c in side.columns if c not in (key, weight)]
    if keys <= WHOLE:
        return rows.join(F.broadcast(side.drop(weight)), key).select(*rows.columns, *own)
    packed = side.select(key, F.struct(*own).alias("_side"), weight)
    top = packed.orderBy(F.desc(weight), key).limit(FREQUENT).drop(weight)
    met = rows.join(F.broadcast(top), key, "left")
    rest = met.where("_side is null").drop("_side").join(packed.drop(weight), key)
    return met.where("_side is not null").unionByName(rest).select(*rows.columns, *[F.col(f"_side.{c}").alias(c) for c in own])


#: Bytes of input that a function gets at once, unless a single row has more.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most that many bytes or, where rows differ much in size, about that many."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def with_arrow_columns(
    frame: DataFrame,
    inputs: Sequence[str],
    outputs: T.StructType,
    make: Callable[..., Callable[..., dict]],
    *args,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """frame with the columns of outputs, made batch by batch from the columns named by inputs.

    make(*args) is called once in each task and returns a function of the input arrays that returns an
    array (or list) for each output. A column of frame that has an output's name gives way to it.
    keep: the other columns to carry along, by default all."""
    new = {f.name for f in outputs}
    keep = [c for c in (frame.columns if keep is None else keep) if c not in new]
    ready(frame.sparkSession)
    chosen = frame.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([T.StructField(f"k{i}", chosen.schema[i].dataType) for i in range(len(keep))] + list(outputs))
    n_keep, n_in = len(keep), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make(*args)
        types = to_arrow_schema(outputs)
        for batch in pieces(batches):
            got = fn(*[batch.column(n_keep + i) for i in range(n_in)])
            arrays = [batch.column(i) for i in range(n_keep)]
            arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f in types for x in (got[f.name],)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    out = chosen.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f.name) for f in outputs])
