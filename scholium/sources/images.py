"""Figures of papers: cut out by an injected renderer, stored once for equal content, described once for equal content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mime_type
from ..session import ready

RENDERED = "index int, page int, block_id string, bbox array<double>, suffix string, data binary"


def rendered_figures(files: DataFrame, render: Callable[[bytes, int, list | None], bytes | None], embedded: Callable[[bytes], list[tuple[int, bytes, str]]], *, doc: str) -> DataFrame:
    """doc and the columns of RENDERED: the figures of each file, in order; a file that fails keeps those before.

    files: doc, content (binary), blocks array<struct<block_id, page, bbox>> of figures. render: (content, page, bbox or
    None) -> the picture in that box, or the page's first picture. Without blocks all embedded pictures are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, blocks in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows: list[dict] = []
                try:
                    for k, b in enumerate(blocks or [], 1):
                        page = max(1, b["page"] or 1)
                        data = render(content, page, b["bbox"]) or render(content, page, None)
                        rows.append({"index": k, "page": page, "block_id": b["block_id"], "bbox": b["bbox"] or [], "suffix": "png", "data": data})
                    for k, (page, data, suffix) in enumerate([] if blocks else embedded(content), 1):
                        rows.append({"index": k, "page": page, "block_id": f"figure_{page:04d}_{k:03d}", "bbox": [], "suffix": suffix, "data": data})
                except Exception:  # noqa: BLE001 - pictures are an addition, the text is indexed without them
                    pass
                good = [r for r in rows if r["data"]]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(good), batch.column(0).type), *[pa.array([r[f] for r in good], t) for f, t in shape]], names=["key", *[f for f, _ in shape]])

    shape = [("index", pa.int32()), ("page", pa.int32()), ("block_id", pa.string()), ("bbox", pa.list_(pa.float64())), ("suffix", pa.string()), ("data", pa.binary())]
    kind = files.schema[doc].dataType.simpleString()
    ready(files.sparkSession)
    return files.select(doc, "content", "blocks").mapInArrow(run, f"key {kind}, {RENDERED}").withColumnRenamed("key", doc)


def stored_figures(rendered: DataFrame, *, doc: str, root: str) -> DataFrame:
    """doc, block_id, page, bbox, image_id, image_path, image_mime_type, image_hash, data (of the first of equal pictures
    in a document, whose path the others have)."""
    hashed = rendered.withColumn("image_hash", F.sha2("data", 256))
    same = Window.partitionBy(doc, "image_hash").orderBy("index")
    first = hashed.withColumn("_first", F.first("index").over(same)).withColumn("_suffix", F.first("suffix").over(same))
    path = F.concat(F.lit(f"{root.rstrip('/')}/doc_"), F.col(doc).cast("string"), F.format_string("/images/figure_%03d_%s.%s", F.col("_first"), F.substring("image_hash", 1, 12), F.col("_suffix")))
    named = first.withColumn("image_path", path)
    return named.select(doc, "block_id", "page", "bbox", F.format_string("image_%03d", F.col("index")).alias("image_id"), "image_path", mime_type(F.col("image_path")).alias("image_mime_type"), "image_hash", F.when(F.col("index") == F.col("_first"), F.col("data")).alias("data"))


def summaries(images: DataFrame, describe: Callable[[bytes, str], str]) -> DataFrame:
    """image_hash, summary: what a model says of each distinct picture, blank where it fails. images: image_hash, data,
    caption; of equal pictures the first caption counts."""

    @F.pandas_udf(T.StringType())
    def ask(data: pd.Series, captions: pd.Series) -> pd.Series:
        def one(picture: bytes, caption: str | None) -> str:
            try:
                return (describe(picture, caption or "") or "").strip()
            except Exception:  # noqa: BLE001 - a figure without a summary is found by its caption
                return ""

        return pd.Series([one(d, c) for d, c in zip(data, captions, strict=True)])

    once = images.where("data is not null").groupBy("image_hash").agg(F.min_by("data", F.coalesce("caption", F.lit(""))).alias("data"), F.min(F.nullif("caption", F.lit(""))).alias("caption"))
    return once.select("image_hash", ask("data", "caption").alias("summary"))
