"""WARC archives with a two-level capture index.

Pages go to archives, a gzip member for each record, behind a warcinfo record. The capture index has a line "key date
json" for each record, sorted by reversed-host URL key, in gzip blocks of `block_lines`. A directory (Parquet, one row
for each block: its first and last key and where it lies) is the second level. A look-up searches the directory by
bisection, reads the ranges of the blocks that it finds, searches each by bisection, and reads the records' ranges. Many
look-ups go together: blocks are read once for all keys in them, records in the order in which they lie, and the blocks
and records of one frequent key by many tasks.

Of pages with equal payloads (of min_size bytes or more) the one of the smallest id is a response record, the others
are revisit records that refer to it, with the HTTP headers but no payload. Which is which is decided by hashes alone;
payloads stay with the task that reads them, unless the list of payloads with copies is too long to be broadcast.

A task writes under names of its own and hands on what it wrote, so a task that is run again leaves files that no
directory row names. Files go through pyarrow.fs, to any store that it knows.

Defined cases: null html is an empty payload, a null URL has an empty key. Rows with a null id are revisits of
the smallest non-null id of their payload, and responses where there is none. Every row whose id is the smallest
of its payload is a response, also if it is repeated. An empty table has no archives. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_dir, ready
from .common import PIECE_BYTES, cut, pieces

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 1000
#: An archive is closed after this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Directory rows that a look-up broadcasts at most; 500 bytes each are 100 MB.
MAX_DIRECTORY = 200_000
#: Payloads with copies whose list is broadcast at most; 200 bytes each are 40 MB.
MAX_BROADCAST = 200_000

DIRECTORY = "first_key string, last_key string, n int, index_file string, index_at long, index_bytes long"


def url_key(url: str | None) -> str:
    """https://a.example.org:80/x?y becomes org,example,a)/x?y."""
    rest = (url or "").partition("://")[2]
    cut_at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut_at].rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + rest[cut_at:].partition("#")[0] if rest else ""


def _line(value: object) -> str:
    """A header's value on one line."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in str(value) for c in "\r\n") else str(value)


def record(kind: str, name: str, page: object, url: str | None, date: str, size: int, digest: str, payload: bytes = b"", refers_to: object = None, refers_url: str | None = None) -> bytes:
    """name: what the record's id is made of."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"]
    head += [f"WARC-Target-URI: {_line(url)}"] * (url is not None) + [f"X-Page-ID: {_line(page)}"] * (page is not None)
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {_line(refers_to)}", f"WARC-Refers-To-Date: {date}"]
        head += [f"WARC-Refers-To-Target-URI: {_line(refers_url)}"] * (refers_url is not None)
    head += [f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + http + payload + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that an archive begins with."""
    body = b"software: scholium\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """headers, http (its headers) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Writer:
    """A file under a name of its own, in the store of root."""

    def __init__(self, root: str, suffix: str):
        self.store, folder = pafs.FileSystem.from_uri(root)
        self.store.create_dir(folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.out = self.store.open_output_stream(f"{folder}/{self.name}", compression=None)
        self.at = 0

    def add(self, data: bytes) -> int:
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at


CAPTURES = "key string, id_text string, url string, file string, at long, bytes long"


def _archiver(root: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id_text, url, html as bytes, first, first_url): revisits of first, where that is not null."""
        archive = None
        for batch in pieces(batches):
            keys, names, ats, sizes = [], [], [], []
            for r in batch.to_pylist():
                if archive is not None and archive.at >= archive_bytes:
                    archive.out.close()
                    archive = None
                if archive is None:
                    archive = _Writer(root, ".warc.gz")
                    archive.add(_gzip(info(archive.name)))
                payload, name = r["html"] or b"", f"{archive.name}/{archive.at}"
                kind = "response" if r["first"] is None else "revisit"
                kept = payload if kind == "response" else b""
                data = _gzip(record(kind, name, r["id_text"], r["url"], DATE, len(payload), digest_of(payload), kept, r["first"], r["first_url"]))
                keys.append(url_key(r["url"]))
                names.append(archive.name)
                ats.append(archive.add(data))
                sizes.append(len(data))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id_text", "url")]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *kept, pa.array(names, pa.string()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "id_text", "url", "file", "at", "bytes"])
        if archive is not None:
            archive.out.close()

    return run


def _indexer(root: str, block_lines: int):
    """Captures come sorted by key; gives directory rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, lines = None, []
        fields = [("first_key", pa.string()), ("last_key", pa.string()), ("n", pa.int32()), ("index_file", pa.string()), ("index_at", pa.int64()), ("index_bytes", pa.int64())]

        def block() -> pa.RecordBatch:
            data = _gzip("".join(lines).encode("utf-8", "surrogatepass"))
            row = [lines[0].partition("\t")[0], lines[-1].partition("\t")[0], len(lines), index.name, index.add(data), len(data)]
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, fields, strict=True)], names=[n for n, _ in fields])

        for batch in pieces(batches):
            for r in batch.to_pylist():
                index = index or _Writer(root, ".cdx.gz")
                lines.append(f"{json.dumps(r['key'])[1:-1]}\t{DATE}\t" + json.dumps({"id": r["id_text"], "url": r["url"], "file": r["file"], "at": r["at"], "bytes": r["bytes"]}) + "\n")
                if len(lines) >= block_lines:
                    yield block()
        if lines:
            yield block()
        if index is not None:
            index.out.close()

    return run


def first_copies(plain: DataFrame, min_size: int) -> DataFrame:
    """sha, first, first_url of the payloads (of min_size bytes or more) that several rows of plain (id, url, sha, bytes) have."""
    some = plain.where(F.col("bytes") >= min_size).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("best"))
    return some.where((F.col("n") > 1) & F.col("best.id").isNotNull()).select("sha", F.col("best.id").alias("first"), F.col("best.url").alias("first_url"))


def write_archives(pages: DataFrame, root: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_size: int = 0, block_lines: int = BLOCK_LINES, archive_bytes: int = ARCHIVE_BYTES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Writes archives and their index below root, and gives the directory (also written, at root/directory)."""
    spark = ready(pages.sparkSession)
    plain = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html"))
    hashed = plain.withColumns({"sha": F.sha1("html"), "bytes": F.length("html")})
    firsts = cut(first_copies(hashed.select("id", "url", "sha", "bytes"), min_size))
    if firsts.limit(max_broadcast + 1).count() <= max_broadcast:
        met = hashed.join(F.broadcast(firsts), "sha", "left")
    else:  # rows of one payload go by their ids, so no task gets all
        rows = hashed.select("id", "sha").distinct().join(firsts, "sha").toDF("r_sha", "r_id", "first", "first_url")
        met = hashed.join(rows, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left")
    own = F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    typed = met.select(F.col("id").cast("string").alias("id_text"), "url", "html", F.when(~own, F.col("first").cast("string")).alias("first"), "first_url")
    captures = cut(typed.mapInArrow(_archiver(root, archive_bytes), CAPTURES))
    dealt = captures.repartitionByRange("key", "file", "at").sortWithinPartitions("key", "file", "at")
    dealt.mapInArrow(_indexer(root, block_lines), DIRECTORY).write.parquet(f"{root}/directory")
    return spark.read.schema(DIRECTORY).parquet(f"{root}/directory")


def _captures(store: pafs.FileSystem, folder: str, row: dict) -> list[dict]:
    """The captures of one index block, in key order."""
    with store.open_input_file(f"{folder}/{row['index_file']}") as f:
        data = zlib.decompress(f.read_at(row["index_bytes"], row["index_at"]), 31)
    out = []
    for line in data.decode("utf-8", "surrogatepass").splitlines():
        key, _, rest = line.split("\t", 2)
        got = json.loads(rest)
        out.append({"key": json.loads(f'"{key}"'), "id_text": got["id"]} | {k: got[k] for k in ("url", "file", "at", "bytes")})
    return out


RECORDS = T.StructType([T.StructField(n, t) for n, t in (("id_text", T.StringType()), ("key", T.StringType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))])


def _read(store: pafs.FileSystem, folder: str, captures: list[dict], with_payload: bool) -> Iterator[dict]:
    """The records of captures; ranges of one file are read through one handle."""
    name, f = None, None
    for c in captures:
        if c["file"] != name:
            name, f = c["file"], store.open_input_file(f"{folder}/{c['file']}")
        got = parse(zlib.decompress(f.read_at(c["bytes"], c["at"]), 31))
        head, full = got["headers"], head_bytes(got)
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and digest != digest_of(got["payload"]):
            raise ValueError(f"{c['file']} at {c['at']}: the payload does not have its digest")
        yield {"id_text": c["id_text"], "key": c["key"], "url": c["url"], "record_type": head["WARC-Type"], "payload_bytes": full, "payload_digest": digest, "refers_to": head.get("X-Refers-To-Page-ID"), "payload": got["payload"] if with_payload and head["WARC-Type"] == "response" else None}


def head_bytes(got: dict) -> int:
    """Of the full payload, also in a revisit record."""
    return int(got["http"]["Content-Length"])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], kinds.get(f.name, pa.string())) for f in RECORDS], names=RECORDS.names)


def _key(text: str) -> str:
    """A key as the directory has it."""
    return json.loads(f'"{text}"')


def find_blocks(keys: DataFrame, directory: DataFrame, *, max_directory: int = MAX_DIRECTORY) -> DataFrame:
    """key, index_file, index_at, index_bytes: the blocks that may have each key (of the column key, distinct), by bisection.

    A directory of more than max_directory rows is searched in slices, ranges of its keys, each broadcast by itself."""
    spark = ready(keys.sparkSession)
    slices, out = max(1, -(-directory.count() // max_directory)), None
    if slices > 1:
        directory = cut(directory.repartitionByRange(2 * slices, "first_key", "last_key", "index_file", "index_at").withColumn("slice", F.spark_partition_id()))
    for k in range(2 * slices if slices > 1 else 1):
        rows = sorted((_key(r["first_key"]), _key(r["last_key"]), r["index_file"], r["index_at"], r["index_bytes"]) for r in (directory.where(F.col("slice") == k) if slices > 1 else directory).collect())
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            firsts, tops = [r[0] for r in rows], []  # tops: the greatest last key so far, which bisection needs
            for r in rows:
                tops.append(max(r[1], tops[-1]) if tops else r[1])
            for batch in batches:
                met = [(key, *r[2:]) for key in batch.column(0).to_pylist() for r in rows[bisect_left(tops, key) : bisect_right(firsts, key)] if r[1] >= key]
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*met, strict=True)], names=["key", "index_file", "index_at", "index_bytes"])

        got = keys.select("key").mapInArrow(run, "key string, index_file string, index_at long, index_bytes long")
        out = got if out is None else out.unionByName(got)
    return out


def find_captures(blocks: DataFrame, root: str) -> DataFrame:
    """CAPTURES of the keys in the blocks that find_blocks gave; a block is read once and searched by bisection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(root)
        at, captures, keys = None, [], []
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if at != (r["index_file"], r["index_at"]):
                    at, captures = (r["index_file"], r["index_at"]), _captures(store, folder, r)
                    keys = [c["key"] for c in captures]
                found += captures[bisect_left(keys, r["key"]) : bisect_right(keys, r["key"])]
            yield pa.RecordBatch.from_arrays([pa.array([c[f] for c in found], kind) for f, kind in (("key", pa.string()), ("id_text", pa.string()), ("url", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()))], names=["key", "id_text", "url", "file", "at", "bytes"])

    return blocks.repartition("index_file", "index_at").sortWithinPartitions("index_file", "index_at", "key").mapInArrow(run, CAPTURES)


def read_records(captures: DataFrame, root: str, *, with_payload: bool = False) -> DataFrame:
    """RECORDS of captures, each archive's ranges read in the order in which they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(root)
        for batch in batches:
            rows: list[dict] = []
            size = 0
            for r in _read(store, folder, batch.to_pylist(), with_payload):
                rows.append(r)
                size += len(r["payload"] or b"")
                if size > PIECE_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    near = F.floor(F.col("at") / (32 << 20))
    return captures.repartition("file", near).sortWithinPartitions("file", "at").mapInArrow(run, RECORDS)


def look_up(queries: DataFrame, directory: DataFrame, root: str, *, url: str = "url", with_payload: bool = True, max_directory: int = MAX_DIRECTORY) -> DataFrame:
    """RECORDS of the captures of each different URL key asked for; a null URL asks for records without one."""
    ready(queries.sparkSession)

    def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    keys = queries.select(F.col(url).cast("string").alias("url")).distinct().mapInArrow(key_batches, "key string").distinct()
    return read_records(find_captures(find_blocks(keys, directory, max_directory=max_directory), root), root, with_payload=with_payload)


def round_trip(spark: SparkSession, pages: DataFrame, *, page_id: str = "page_id", **options) -> DataFrame:
    """Writes the pages below the shared folder and looks all their URLs up again: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    root = fresh_dir(spark, "warc")
    kind = pages.schema[page_id].dataType
    directory = cut(write_archives(pages, root, page_id=page_id, **options))
    back = look_up(pages, directory, root, url=options.get("url", "url"), with_payload=False)
    return back.select(F.col("id_text").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
