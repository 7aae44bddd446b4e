"""WARC archives with a two-level capture index.

Archives are gzip members, one a record.  Of pages with equal payloads the one with the largest
page_id is a `response`, the others are `revisit` records that refer to it.  The capture index sorts
reversed-host URL keys into compressed blocks of BLOCK_LINES lines, in parts by ranges of keys; each
part's sparse directory holds its blocks' first keys and places, with a table of fixed-width positions, so
it is searched by bisection over range reads and never loaded whole.  A top list has the first key and
the directory of each part, a row for each; parts follow spark.sql.shuffle.partitions.  A capture is
fetched by bisecting the top list and a directory, reading one block, and one range read of the archive.

Files are written under names of their own by each task attempt; only the files that the committed
tables of captures and parts name are ever read, so lost executors leave nothing wrong behind.

Defined cases: a null html is an empty payload; payloads shorter than `least_bytes` are never
revisits; a null URL has the key "-"; rows with one page_id and equal payloads that hold the largest
page_id are all responses; a null page_id counts as the least; a very long payload is one record; repeated rows are records of
their own; an empty table gives an archive without parts, in which nothing is found; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, new_folder, staged

ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 1000
LEVEL = 4
CAPTURED = "1970-01-01T00:00:00Z"
CAPTURES = "key string, page_id long, file string, offset long, length long"
PARTS = "part int, first string, directory string, blocks long, lines long"
RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: com,example)/path?query."""
    if not url:
        return "-"
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return url.strip().replace(" ", "%20")
    host = re.sub(r"^www\d*\.", "", host)
    tail = (p.path or "/") + (f"?{p.query}" if p.query else "")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail.lower()
    return re.sub(r"\s", "%20", key)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:lexisift:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:lexisift:page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    kind = "revisit" if refers else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {CAPTURED}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or ""),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> dict:
    """Fields of RECORDS of one gzip member; the digest of a response is that of the bytes read."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    kind = h["WARC-Type"]
    out = {"page_id": _page_of(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "record_type": kind}
    if kind == "revisit":
        return out | {"payload": None, "payload_bytes": int(h["WARC-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": _page_of(h["WARC-Refers-To"])}
    payload = block.partition(b"\r\n\r\n")[2]
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest_of(payload), "refers_to": None}


class _Out:
    """A file of this task attempt's own."""

    def __init__(self, folder: str, kind: str) -> None:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{kind}"
        self.f, self.pos = fs.open_output_stream(f"{base}/{self.name}", compression=None), 0

    def put(self, data: bytes) -> tuple[int, int]:
        self.f.write(data)
        self.pos += len(data)
        return self.pos - len(data), len(data)

    def close(self) -> None:
        self.f.close()


class _In:
    """Open files of a folder, the last few of them."""

    def __init__(self, folder: str) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.open: dict[str, object] = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.open[name].read_at(length, offset)


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    cols = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[k]) for c, k in cols], names=[c for c, _ in cols])


def _write_archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for page, url, html, refers, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or out.pos >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    out = _Out(folder, "warc.gz")
                at, n = out.put(record(page, url, html, refers, to))
                rows.append({"key": url_key(url), "page_id": page, "file": out.name, "offset": at, "length": n})
            yield _batch(rows, CAPTURES)
        if out:
            out.close()

    return run


def _write_index(folder: str, block_lines: int):
    """Sorted captures to compressed blocks and their sparse directory; a row for each part.

    A directory holds its entries in order, then the fixed-width positions of all, then their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, first, at, held, lines = None, None, None, [], [], 0

        def flush() -> None:
            start, n = out.put(zlib.compress("\n".join(json.dumps(r) for r in held).encode(), 6))
            at.append(directory.put(json.dumps([held[0][0], out.name, start, n]).encode())[0])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, directory, first = _Out(folder, "cdx"), _Out(folder, "dir"), r[0]
                held.append(list(r))
                lines += 1
                if len(held) == block_lines:
                    flush()
                    held = []
        if out is None:
            return
        if held:
            flush()
        blocks = len(at)
        at.append(directory.pos)
        directory.put(b"".join(x.to_bytes(8, "little") for x in at))
        directory.put(blocks.to_bytes(8, "little"))
        directory.close()
        out.close()
        yield _batch([{"part": TaskContext.get().partitionId(), "first": first, "directory": directory.name, "blocks": blocks, "lines": lines}], PARTS)

    return run


class Directory:
    """Bisection over the sparse directory by range reads; what was read stays in a small cache."""

    def __init__(self, folder: str, name: str) -> None:
        self.files, self.name = _In(folder), name
        info = self.files.fs.get_file_info(f"{self.files.base}/{name}")
        self.n = int.from_bytes(self.files.read(name, info.size - 8, 8), "little")
        self.table = info.size - 8 - 8 * (self.n + 1)
        self.seen: dict[int, list] = {}

    def __len__(self) -> int:
        return self.n

    def entry(self, i: int) -> list:
        if i not in self.seen:
            if len(self.seen) > 4096:
                self.seen.clear()
            a, b = (int.from_bytes(self.files.read(self.name, self.table + 8 * k, 8), "little") for k in (i, i + 1))
            self.seen[i] = json.loads(self.files.read(self.name, a, b - a))
        return self.seen[i]

    def __getitem__(self, i: int) -> str:
        return self.entry(i)[0]

    def blocks(self, key: str) -> range:
        """The blocks that may hold the key."""
        return range(max(0, bisect.bisect_left(self, key) - 1), bisect.bisect_right(self, key))

    def lines(self, i: int) -> list[list]:
        _, file, offset, length = self.entry(i)
        return [json.loads(x) for x in zlib.decompress(self.files.read(file, offset, length)).decode().split("\n")]


class TopList:
    """The parts in the order of their first keys, and their directories as they are needed."""

    def __init__(self, folder: str, parts: list[tuple[str, str]]) -> None:
        self.folder, self.parts, self.firsts = folder, parts, [first for first, _ in parts]
        self.known: dict[int, Directory] = {}

    def directory(self, part: int) -> Directory:
        if part not in self.known:
            if len(self.known) >= 64:
                self.known.clear()
            self.known[part] = Directory(self.folder, self.parts[part][1])
        return self.known[part]

    def blocks(self, key: str) -> list[tuple[int, int]]:
        """(part, block) of all that may hold the key."""
        parts = range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key))
        return [(p, i) for p in parts for i in self.directory(p).blocks(key)]


class Archive:
    """A written archive folder: whole or by URL."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        rows = spark.read.schema(PARTS).parquet(f"{folder}/parts").select("part", "first", "directory").collect()  # a row for each shuffle partition at most
        self.parts = [(r["first"], r["directory"]) for r in sorted(rows, key=lambda r: r["part"])]

    def fetch(self, url: str) -> list[dict]:
        """All captures of one URL."""
        top, files, key = TopList(f"{self.folder}/index", self.parts), _In(f"{self.folder}/warc"), url_key(url)
        return [parse(files.read(r[2], r[3], r[4])) for p, i in top.blocks(key) for r in top.directory(p).lines(i) if r[0] == key]

    def fetch_all(self, urls: DataFrame) -> DataFrame:
        """The captures of all URLs of a one-column table: keys, then blocks, then records, each dealt out anew."""
        folder, parts = self.folder, self.spark.sparkContext.broadcast(self.parts)

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = TopList(f"{folder}/index", parts.value)
            for batch in batches:
                got = [(k, p, i) for k in batch.column(0).to_pylist() for p, i in top.blocks(k)]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int64())], names=["key", "part", "block"])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, files = TopList(f"{folder}/index", parts.value), _In(f"{folder}/warc")
            for batch in batches:
                for part, block, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    wanted, rows, size = set(wanted), [], 0
                    for r in top.directory(part).lines(block):
                        if r[0] in wanted:
                            rows.append(parse(files.read(r[2], r[3], r[4])))
                            size += rows[-1]["payload_bytes"]
                            if size > 8 << 20:
                                yield _batch(rows, RECORDS)
                                rows, size = [], 0
                    if rows:
                        yield _batch(rows, RECORDS)

        n = n_partitions(self.spark)
        wanted = urls.mapInArrow(keys, "key string").distinct().mapInArrow(find, "key string, part int, block long")
        blocks = wanted.groupBy("part", "block").agg(F.collect_set("key").alias("keys"))  # no more keys than a block has lines match it
        # dealt without keys: by the same keys as above nothing would be dealt, and few small lists of keys end in one task
        return blocks.repartition(n).mapInArrow(fetch, RECORDS)


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, block_lines: int = BLOCK_LINES) -> Archive:
    """Writes the records and the capture index of pages (page_id, url, html)."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    hashed = rows.where(F.octet_length("html") >= least_bytes).select("page_id", F.unhex(F.sha1("html")).alias("sha"))
    groups = hashed.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("target")).where("n > 1").select("sha", "target")
    again = hashed.join(groups, "sha").where(~F.col("page_id").eqNullSafe(F.col("target")))
    again = staged(again.select("page_id", "sha", "target").distinct(), "revisits")
    keyed = rows.withColumn("sha", F.unhex(F.sha1("html")))
    mark = again.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "target", F.lit(True).alias("refers"))
    joined = keyed.join(mark, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    marked = joined.select("page_id", "url", "html", F.coalesce("refers", F.lit(False)).alias("refers"), "target")
    marked.mapInArrow(_write_archives(f"{folder}/warc"), CAPTURES).write.parquet(f"{folder}/captures")
    captures = spark.read.schema(CAPTURES).parquet(f"{folder}/captures")
    ranged = captures.repartitionByRange(n_partitions(spark), "key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")
    ranged.mapInArrow(_write_index(f"{folder}/index", block_lines), PARTS).write.parquet(f"{folder}/parts")
    return Archive(spark, folder)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = write_archive(pages, new_folder(spark, "archive"))
    read = archive.fetch_all(pages.select(F.col("url").cast("string").alias("url")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS target FROM p GROUP BY h),
d AS (SELECT page_id, html, h, target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc FROM p JOIN g USING (h))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: abc[1 + CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER)]), '') AS payload_digest,
  CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = target THEN NULL ELSE target END AS refers_to
FROM d
"""
