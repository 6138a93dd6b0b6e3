"""WARC archives with a two-level capture index.

Archives: one gzip member per record, one file per task. Index, first level:
capture lines sorted by reversed-host URL key, in gzip blocks of some thousand
lines. Second level: a directory with one row per block (first and last key,
place, length). A look-up finds its blocks by binary search in the directory,
reads just those byte ranges, searches the lines, and reads just the byte
ranges of the records.

Tasks write under names of their own attempt, and only files named by rows of
a finished task are ever read, so a lost executor or a repeated task leaves
nothing but an unused file.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import open_folder
from framewright.operators.lookups import lookup_join
from framewright.session import reliable, shared_path

# Payloads shorter than this are always stored in full.
LEAST_REVISIT = 100
BLOCK_LINES = 3_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LINE_SCHEMA = "key string, page_id bigint, file string, offset bigint, length bigint"
DIRECTORY_SCHEMA = (
    "first_key string, last_key string, shard string, offset bigint, length bigint, lines bigint"
)
CAPTURE_SCHEMA = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
)


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query`` of a URL; the whole text where there is no ``://``."""
    found = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", url or "", re.S)
    if not found:
        return url or ""
    host = re.sub(r"^.*@|:\d*$", "", found[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (found[2] or "/")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return int(page) if page else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One WARC record as a gzip member. ``first``: the page whose response this one revisits."""
    digest = hashlib.sha256(payload).hexdigest()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe='%:/?#[]@!$&()*+,;=~' + chr(39))}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if first is None:
        block = http + payload
    else:
        block = http
        head += [f"WARC-Refers-To: {_record_id(first, digest)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    text = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(text, 6, mtime=0)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])
    return {p[0]: p[1] if len(p) > 1 else "" for p in pairs}


def parse_record(member: bytes) -> tuple:
    """(page_id, payload bytes, payload digest, type, refers_to) of a stored record.

    The digest of a response is computed from what was read and must agree
    with its header.
    """
    head, rest = gzip.decompress(member).split(b"\r\n\r\n", 1)
    warc = _fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    digest = warc["WARC-Payload-Digest"].removeprefix("sha256:")
    kind, refers = warc["WARC-Type"], None
    if kind == "response":
        n = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"digest of {warc['WARC-Record-ID']} does not match its payload")
    else:
        n = int(_fields(http)["Content-Length"])
        refers = _page_of(warc["WARC-Refers-To"])
    return _page_of(warc["WARC-Record-ID"]), n, digest, kind, refers


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)],
        names=[n for n, _ in schema],
    )


_I, _S = pa.int64(), pa.string()
_LINE = [("key", _S), ("page_id", _I), ("file", _S), ("offset", _I), ("length", _I)]
_DIRECTORY = [
    ("first_key", _S), ("last_key", _S), ("shard", _S), ("offset", _I), ("length", _I), ("lines", _I),
]
_CAPTURE = [
    ("page_id", _I), ("payload_bytes", _I), ("payload_digest", _S), ("record_type", _S), ("refers_to", _I),
]


def _own_name(kind: str, ending: str) -> str:
    return f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.{ending}"


def _write_records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        name, at, out = _own_name("pages", "warc.gz"), 0, None
        try:
            for batch in batches:
                rows = []
                columns = [batch.column(i) for i in range(4)]
                for i in range(batch.num_rows):
                    page_id, url, payload, first = (c[i].as_py() for c in columns)
                    member = record(page_id, url, payload, first)
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member)
                    rows.append((url_key(url), page_id, name, at, len(member)))
                    at += len(member)
                yield _batch(_LINE, rows)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write a record per row below ``folder``; returns the capture lines, written once.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those of the
    smallest page_id are responses and the others revisit it; a null page_id
    counts as larger than any, and where all are null all are responses. Rows
    that repeat both id and payload of a response are responses. A null html is
    an empty payload, a null url an empty target. Payload digests are joined
    to repeated digests only; digests with a large share of the rows are
    broadcast, the others shuffled, so no group of copies meets in one task.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    long_enough = F.octet_length("payload") >= LEAST_REVISIT
    rows = rows.withColumn("digest", F.when(long_enough, F.sha2("payload", 256)))
    repeated = reliable(
        rows.filter(F.col("digest").isNotNull())
        .groupBy(F.col("digest").alias("key"))
        .agg(F.min("page_id").alias("value"), F.count("*").alias("occurrences"))
        .filter("occurrences > 1 and value is not null")
    )
    joined = lookup_join(rows, "digest", repeated, "first").select(
        "page_id",
        "url",
        "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"),
    )
    return reliable(joined.mapInArrow(_write_records(folder), LINE_SCHEMA))


def _write_blocks(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        name, at, out, held = _own_name("captures", "cdx.gz"), 0, None, []

        def block() -> pa.RecordBatch:
            nonlocal at, out
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            text = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in held)
            member = gzip.compress(text.encode("utf-8", "surrogatepass"), 6, mtime=0)
            out.write(member)
            row = (held[0][0], held[-1][0], name, at, len(member), len(held))
            at += len(member)
            held.clear()
            return _batch(_DIRECTORY, [row])

        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(row)
                    if len(held) == block_lines:
                        yield block()
            if held:
                yield block()
        finally:
            if out is not None:
                out.close()

    return run


def write_index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted blocks below ``folder``; returns the directory, written once.

    Keys are dealt by range, and equal keys by page and place, so that a host
    or a URL with very many captures spreads over several shards.
    """
    ordered = lines.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions(
        "key", "page_id", "file", "offset"
    )
    return reliable(ordered.mapInArrow(_write_blocks(folder, block_lines), DIRECTORY_SCHEMA))


def _lines_of(fs, path: str, shard: str, offset: int, length: int) -> list[list]:
    with fs.open_input_file(f"{path}/{shard}") as f:
        text = gzip.decompress(f.read_at(length, offset)).decode("utf-8", "surrogatepass")
    return [json.loads(x) for x in text.split("\n")[:-1]]


def _read_blocks(folder: str, keys: list[str] | None):
    """Lines of all blocks, or those of the (sorted) keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for batch in batches:
            first, last, shard, offset, length, _ = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                low, high = 0, 0
                if keys is not None:
                    low, high = bisect_left(keys, first[i]), bisect_right(keys, last[i])
                    if low == high:
                        continue
                rows = _lines_of(fs, path, shard[i], offset[i], length[i])
                if keys is not None:
                    at = [r[0] for r in rows]
                    rows = [
                        r for k in keys[low:high] for r in rows[bisect_left(at, k) : bisect_right(at, k)]
                    ]
                if rows:
                    yield _batch(_LINE, [tuple(r) for r in rows])

    return run


def _read_records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        name, source = None, None
        try:
            for batch in batches:
                rows = []
                _, _, file, offset, length = (c.to_pylist() for c in batch.columns)
                for f, at, n in zip(file, offset, length, strict=True):
                    if f != name:
                        if source is not None:
                            source.close()
                        name, source = f, fs.open_input_file(f"{path}/{f}")
                    rows.append(parse_record(source.read_at(n, at)))
                yield _batch(_CAPTURE, rows)
        finally:
            if source is not None:
                source.close()

    return run


def _records(lines: DataFrame, folder: str) -> DataFrame:
    """Records of the lines, each archive read from front to back by one task."""
    ordered = lines.repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read_records(folder), CAPTURE_SCHEMA)


def read_all(directory: DataFrame, folder: str) -> DataFrame:
    """Every capture, found through the blocks of the index."""
    spread = directory.repartition("shard", "offset")
    return _records(spread.mapInArrow(_read_blocks(folder, None), LINE_SCHEMA), folder)


def look_up(directory: DataFrame, folder: str, urls: list[str]) -> DataFrame:
    """Captures of a list of URLs, each capture once; unknown URLs give no row.

    The sorted keys of the list travel to the tasks, each of which holds some
    rows of the sparse directory and searches them by bisection.
    """
    keys = sorted({url_key(u) for u in urls})
    return _records(directory.mapInArrow(_read_blocks(folder, keys), LINE_SCHEMA), folder)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write archives and index of all pages; returns the directory and the folder.

    An empty table gives an empty directory. Other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    return write_index(write_archives(pages, folder), folder), folder
