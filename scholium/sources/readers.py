"""Sources: parsed documents, content lists, golden sets, images, replies of external services."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import mime_type
from ..session import ready

ITEM = "struct<type:string,text:string,page_idx:int,page_no:int,bbox:array<double>>"
GOLDEN = "description string, corpus array<string>, page_tolerance int, items array<struct<id:string,question:string,ground_truth:string,evidence:array<struct<filename:string,page:int>>,expect_refusal:boolean>>"


def content_list(body: Column) -> Column:
    """The items of a bare JSON list, or of one under items, content_list, content or blocks."""
    bare = F.from_json(body, f"array<{ITEM}>")
    wrapped = F.from_json(body, f"struct<items:array<{ITEM}>,content_list:array<{ITEM}>,content:array<{ITEM}>,blocks:array<{ITEM}>>")
    found = F.when(F.startswith(F.ltrim(body), F.lit("[")), bare).otherwise(F.coalesce(*[wrapped[k] for k in ("items", "content_list", "content", "blocks")]))
    return F.filter(F.coalesce(found, F.array().cast(f"array<{ITEM}>")), lambda i: i.isNotNull())


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """question id, question, ground_truth, expect_refusal, page_tolerance, filename, page: a row for each evidence page."""
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True)
    items = rows.select(F.coalesce("page_tolerance", F.lit(0)).alias("page_tolerance"), F.explode("items").alias("i")).select("page_tolerance", "i.*")
    return items.select("id", "question", "ground_truth", F.coalesce("expect_refusal", F.lit(False)).alias("expect_refusal"), "page_tolerance", F.explode_outer("evidence").alias("e")).select("id", "question", "ground_truth", "expect_refusal", "page_tolerance", "e.filename", "e.page")


def parsed_files(spark: SparkSession, path: str, parse: Callable[[bytes, str], dict]) -> DataFrame:
    """path, markdown, pages of the files below path, by an injected parser of (content, path).

    parse gives {"markdown": str, "pages": [(number, text)]}. A file that cannot be parsed has an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("markdown", pa.string()), ("pages", pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))), ("error", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = {"path": name, "markdown": None, "pages": [], "error": None}
                try:
                    got = parse(content, name)
                    row |= {"markdown": got["markdown"], "pages": [{"page": p, "text": t} for p, t in got["pages"]]}
                except Exception as e:  # noqa: BLE001 - one bad file is a row with its error
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    files = ready(spark).read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, markdown string, pages array<struct<page:int,text:string>>, error string")


def first_of(*parsers: Callable[[bytes, str], dict]) -> Callable[[bytes, str], dict]:
    """A parser that asks the others in turn, the next where one fails; what the last raises is its own error."""

    def parse(content: bytes, path: str) -> dict:
        for parser in parsers[:-1]:
            try:
                return parser(content, path)
            except Exception:  # noqa: BLE001 - the next one may do
                continue
        return parsers[-1](content, path)

    return parse


def plain_pages(content: bytes, path: str) -> dict:
    """A parser of text files whose pages are ended by form feeds."""
    pages = [(k, t) for k, t in enumerate(content.decode("utf-8").split("\f"), 1) if sum(c.isalnum() for c in t) >= 4]
    if not pages:
        raise ValueError("no page has text")
    return {"markdown": "\n\n".join(f"<!-- page {k} -->\n{t}" for k, t in pages), "pages": pages}


def data_urls(images: DataFrame, *, root: str, most_bytes: int = 5 << 20, most_images: int = 4, group: str, order: str) -> DataFrame:
    """group, image_path, data_url: the first most_images distinct images of each group, below root and not too large."""
    from pyspark.sql import Window

    inside = F.startswith(F.col("image_path"), F.lit(root.rstrip("/") + "/")) & ~F.contains(F.col("image_path"), F.lit("/../"))
    first = images.where(inside & (F.length("content") <= most_bytes)).groupBy(group, "image_path").agg(F.min(order).alias("_o"), F.first("content").alias("content"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_o", "image_path"))).where(F.col("_n") <= most_images)
    return ranked.select(group, "image_path", F.concat(F.lit("data:"), mime_type(F.col("image_path")), F.lit(";base64,"), F.regexp_replace(F.base64("content"), r"\s", "")).alias("data_url"))


def fetch_json(transport: Callable[[str, dict, dict, float], tuple[int, bytes]], url: str, params: dict, *, headers: dict | None = None, timeout: float = 10.0, retries: int = 2, most_bytes: int = 8 << 20, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A JSON object by GET; tried again after 0.4 * 2^n seconds on 429, 5xx and lost connections."""
    for attempt in range(retries + 1):
        try:
            status, body = transport(url, params, headers or {}, timeout)
        except OSError:
            if attempt == retries:
                raise
        else:
            if status < 400:
                if len(body) > most_bytes:
                    raise ValueError("the reply is too large")
                found = json.loads(body)
                if not isinstance(found, dict):
                    raise ValueError("the reply is no object")
                return found
            if attempt == retries or not (status == 429 or status >= 500):
                raise OSError(f"status {status}")
        sleep(0.4 * 2**attempt)
    raise AssertionError


def pages_of(call: Callable[[str | None], tuple[list, str | None]], *, most_pages: int = 100, most_items: int = 10_000) -> list:
    """All items behind a cursor; a cursor that comes again, or too many pages or items, is an error."""
    items, seen, cursor = [], set(), None
    for _ in range(most_pages):
        got, cursor = call(cursor)
        items += got
        if len(items) > most_items:
            raise ValueError("too many items")
        if not cursor:
            return items
        if cursor in seen:
            raise ValueError("the cursor came again")
        seen.add(cursor)
    raise ValueError("too many pages")


def server_configs(raw: str) -> tuple[list[dict], list[str]]:
    """(configurations, errors) from a JSON array; a bad item or a name that came before is an error, the others stay."""
    try:
        items = json.loads(raw or "[]")
    except ValueError as e:
        return [], [f"no JSON: {e}"]
    if not isinstance(items, list):
        return [], ["no list"]
    good: list[dict] = []
    errors = []
    for k, item in enumerate(items):
        name = item.get("name") if isinstance(item, dict) else None
        kind = item.get("transport", "stdio") if name else None
        if not name:
            errors.append(f"item {k} has no name")
        elif name in {g["name"] for g in good}:
            errors.append(f"{name} came before")
        elif kind == "stdio" and not item.get("command") or kind == "http" and not item.get("url") or kind not in ("stdio", "http"):
            errors.append(f"{name} lacks its {'command' if kind == 'stdio' else 'url' if kind == 'http' else 'transport'}")
        else:
            good.append(item)
    return good, errors


class RepliesSource(DataSource):
    """Rows (provider, query, body) of injected services: options `queries` (a JSON list) and `transport` (a pickled
    function of provider and query, in base64)."""

    @classmethod
    def name(cls) -> str:
        return "scholium_replies"

    def schema(self) -> str:
        return "provider string, query string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _RepliesReader(self.options)


class _Ask(InputPartition):
    def __init__(self, provider: str, query: str):
        self.provider, self.query = provider, query


class _RepliesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.asked, self.transport = json.loads(options["queries"]), options["transport"]

    def partitions(self) -> list[InputPartition]:
        return [_Ask(*pair) for pair in self.asked]

    def read(self, partition: _Ask):
        from pyspark import cloudpickle

        call = cloudpickle.loads(base64.b64decode(self.transport))
        try:
            yield partition.provider, partition.query, call(partition.provider, partition.query), None
        except Exception as e:  # noqa: BLE001 - a provider that fails must not fail the others
            yield partition.provider, partition.query, None, str(e)


def replies(spark: SparkSession, asked: list[tuple[str, str]], transport: Callable[[str, str], str]) -> DataFrame:
    """One task for each (provider, query). All providers failing is an error for the caller to raise."""
    from pyspark import cloudpickle

    ready(spark).dataSource.register(RepliesSource)
    return spark.read.format(RepliesSource.name()).options(queries=json.dumps(asked), transport=base64.b64encode(cloudpickle.dumps(transport)).decode()).load()
