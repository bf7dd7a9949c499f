"""WARC archives with a two-level capture index (operator 1).

Writing: pages are range-dealt and sorted by reversed-host URL key (com,example)/path), so archives, index blocks and the directory share one order. A
task writes an archive of gzip members, one a record, an index file of compressed blocks of `block` entries (key, page, archive, offset, length), and a directory
file with a row for every block: its first and last key and its byte range. Of the directory, `page` rows are one compressed page, and the task returns a row for each
page: this table of pages, a row for block * page captures, is all that ever leaves the files.

Reading: a URL's key is looked up by binary search in the pages, then in the page it may be in, then in the block; each is range-read, and so are the records. A
whole read-back looks up every distinct key, in order, so that a task keeps the page and the block it is in and reads neighbouring records in one range.

Duplicates: of records with equal payloads of at least `least` bytes, that with the smallest page_id is a response, others are revisits that refer to it.
Equal payloads meet only as digests, by partial minimums.

Files are written by the executors through Arrow's file systems into the folder given (on a cluster: below spark.checkpoint.dir) under names that no second attempt
shares; only files that a finished task has returned are ever read. A null payload is empty, a null URL is the empty URL, a null page_id is never the smallest unless all
are null, and the record then refers to nothing. Repeated rows with equal page_id and payload of that size or more are one response and revisits to it only where the
page_id differs. An empty table gives an empty archive. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.shared import shared_dir

_PAGES = "first_key string, last_key string, file string, offset long, length long, captures long"
_READ = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


@dataclass(frozen=True)
class Layout:
    block: int = 256
    page: int = 256
    least: int = 100
    #: Bytes that one range read of neighbouring records may have.
    span_bytes: int = 8 << 20


def url_key(url: Column) -> Column:
    """Reversed host, ')', then port, path and query: https://m.example.net:80/en -> net,example,m)80/en."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    rest = F.when(host != "", F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/:?#]*)([\s\S]*)$", 1), "^:", "")).otherwise(url)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


_HOST = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)([\s\S]*)$")


def plain_url_key(url: str | None) -> str:
    """What url_key gives for one URL, without Spark."""
    found = _HOST.match(url or "")
    if not found or not found[1]:
        return ")" + (url or "")
    return ",".join(reversed(found[1].lower().split("."))) + ")" + found[2].removeprefix(":")


def _urn(page_id: int | None, url: str, digest: str, nth: int = 0) -> str:
    """The id of the nth record of one page, URL and payload."""
    return f"<urn:page:{page_id}:{digest[:16]}:{hashlib.sha256(url.encode('utf-8', 'surrogatepass')).hexdigest()[:16]}" + (f":{nth}>" if nth else ">")


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: tuple[int, str] | None, nth: int) -> bytes:
    """refers_to: page and URL of the response that a revisit refers to."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": _urn(page_id, url, digest, nth),
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": "2024-01-31T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": _urn(*refers_to, digest), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + press.flush()


def _page(urn: str | None) -> int | None:
    found = (urn or "<urn:page:None:").split(":")[2]
    return int(found) if found != "None" else None


def parse_record(member: bytes) -> dict:
    """Of one gzip member: what the record says, and the payload it holds (of a revisit, none)."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "revisit":
        size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have the digest of its record")
    refers_to = _page(fields.get("WARC-Refers-To"))
    return {"record_id": fields["WARC-Record-ID"], "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": refers_to, "payload": payload, "payload_bytes": size, "payload_digest": digest}


class _Sheets:
    """Rows of text lines that go to a file, `size` of them as one compressed sheet; of each sheet its first and last key, its place and its number of captures."""

    def __init__(self, files: fs.FileSystem, base: str, name: str, size: int):
        self.files, self.path, self.name, self.size = files, f"{base}/{name}", name, size
        self.out, self.at = None, 0
        self.lines: list[str] = []
        self.keys: list[str] = []
        self.captures = 0

    def add(self, line: list, first: str, last: str, captures: int) -> tuple | None:
        """The sheet that this line completes, if it does."""
        self.lines.append(json.dumps(line))
        self.keys += [first, last]
        self.captures += captures
        return self.close() if len(self.lines) == self.size else None

    def close(self) -> tuple | None:
        if not self.lines:
            return None
        if self.out is None:
            self.out = self.files.open_output_stream(self.path, compression=None)
        data = zlib.compress("\n".join(self.lines).encode("utf-8", "surrogatepass"))
        self.out.write(data)
        made = (self.keys[0], self.keys[-1], self.name, self.at, len(data), self.captures)
        self.at += len(data)
        self.lines, self.keys, self.captures = [], [], 0
        return made


def _write_partition(batches: Iterator[pa.RecordBatch], root: str, layout: Layout) -> Iterator[pa.RecordBatch]:
    files, base = fs.FileSystem.from_uri(root)
    name = f"part-{uuid.uuid4().hex}"
    blocks, sheets = _Sheets(files, base, f"{name}.idx", layout.block), _Sheets(files, base, f"{name}.dir", layout.page)
    pages: list[tuple] = []
    out, at = None, 0

    def note(block: tuple | None) -> None:
        if block and (page := sheets.add(list(block), block[0], block[1], block[5])):
            pages.append(page)

    refers: dict[tuple, tuple[int, str]] = {}
    nth: Counter = Counter()
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["key"], row["page_id"]) != last:  # rows of a page and key stand together
                last = row["key"], row["page_id"]
                refers, nth = {}, Counter()
            if row["refers_to"] is not None:  # comes just before the rows of its page
                refers[row["digest"]] = row["refers_to"], row["url"]
                continue
            if out is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
            same = row["url"], row["digest"]
            data = _record(row["page_id"], row["url"], row["payload"], row["digest"], refers.get(row["digest"]), nth[same])
            nth[same] += 1
            out.write(data)
            note(blocks.add([row["key"], row["page_id"], f"{name}.warc.gz", at, len(data)], row["key"], row["key"], 1))
            at += len(data)
    if out is not None:
        note(blocks.close())
        pages += filter(None, [sheets.close()])
        for f in (out, blocks.out, sheets.out):
            f.close()
    names = [x.split()[0] for x in _PAGES.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int64()] * 3
    yield pa.RecordBatch.from_arrays([pa.array([b[j] for b in pages], t) for j, t in enumerate(kinds)], names=names)


def _keyed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    return rows.withColumn("key", url_key(F.col("url")))


def write_archives(pages: DataFrame, root: str, layout: Layout = Layout()) -> None:
    """Writes archives, index and directory files, and the table of directory pages (root/directory) for pages (page_id, url, html)."""
    keyed = _keyed(pages)
    large = keyed.filter(F.octet_length("payload") >= layout.least).select("page_id", "digest", "key", "url")
    first = large.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1 and first is not null")
    revisits = large.join(first.select(F.col("digest").alias("d"), "first"), F.col("digest") == F.col("d")).filter("page_id <> first.page_id").select("page_id", "digest", "key", "first").distinct()
    # Only digests are joined. What a page refers to travels as a row of its own that sorts before the page, so payloads move once.
    marks = revisits.select("page_id", F.col("first.url").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.col("first.page_id").alias("refers_to"), "key")
    dealt = marks.unionAll(keyed.select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"), "key"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", F.col("refers_to").asc_nulls_last(), "url", "digest")
    ordered.mapInArrow(lambda batches: _write_partition(batches, root, layout), _PAGES).write.parquet(f"{root}/directory")


def directory(spark: SparkSession, root: str) -> DataFrame:
    """A row for each directory page."""
    return spark.read.schema(_PAGES).parquet(f"{root}/directory")


def _range(files: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with files.open_input_file(path) as f:
        return f.read_at(length, offset)


def _sheet(files: fs.FileSystem, base: str, file: str, offset: int, length: int) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(_range(files, f"{base}/{file}", offset, length)).decode("utf-8", "surrogatepass").split("\n")]


def _records(files: fs.FileSystem, base: str, entries: list[list], span_bytes: int) -> Iterator[dict]:
    """Records of index entries in their order; neighbours in an archive are read together."""
    i = 0
    while i < len(entries):
        j = i + 1
        while j < len(entries) and entries[j][2] == entries[i][2] and entries[j][3] == entries[j - 1][3] + entries[j - 1][4] and entries[j][3] + entries[j][4] - entries[i][3] <= span_bytes:
            j += 1
        start = entries[i][3]
        data = _range(files, f"{base}/{entries[i][2]}", start, entries[j - 1][3] + entries[j - 1][4] - start)
        for _, _, _, offset, length in entries[i:j]:
            yield parse_record(data[offset - start : offset - start + length])
        i = j


class _Search:
    """Binary search in pages, their directory rows and their blocks; the sheets that the last key was in are kept."""

    def __init__(self, pages: list[tuple], root: str, span_bytes: int):
        self.files, self.base = fs.FileSystem.from_uri(root)
        self.pages, self.span_bytes = pages, span_bytes
        self.firsts = [p[0] for p in pages]
        self.kept: dict[tuple, tuple[list[list], list[str]]] = {}

    def _read(self, row: tuple) -> tuple[list[list], list[str]]:
        """Lines of a sheet, and their first keys."""
        at = row[2], row[3]
        if at not in self.kept:
            lines = _sheet(self.files, self.base, *row[2:5])
            if len(self.kept) >= 8:
                self.kept.pop(next(iter(self.kept)))
            self.kept[at] = lines, [x[0] for x in lines]
        return self.kept[at]

    @staticmethod
    def _within(rows: list, firsts: list[str], key: str) -> list:
        """Rows whose range of keys can hold the key, in order: the last that begins at or before it, and those before while they end at or after it."""
        at = end = bisect.bisect_right(firsts, key)
        while at and rows[at - 1][1] >= key:
            at -= 1
        return rows[at:end]

    def entries(self, key: str) -> list[list]:
        found = []
        for page in self._within(self.pages, self.firsts, key):
            for block in self._within(*self._read(page), key):
                lines, keys = self._read(tuple(block))
                found += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
        return found

    def records(self, entries: list[list]) -> Iterator[dict]:
        return _records(self.files, self.base, entries, self.span_bytes)


def _pages(spark: SparkSession, root: str) -> list[tuple]:
    """The table of pages in order: a row for Layout.block * Layout.page captures, and one for each task that wrote."""
    return sorted((r.first_key, r.last_key, r.file, r.offset, r.length) for r in directory(spark, root).collect())


def find(keys: DataFrame, root: str, layout: Layout = Layout(), payloads: bool = False) -> DataFrame:
    """The records of every key (column key) by way of the index: a row per record. Keys that stand once give their records once."""
    schema = _READ if payloads else _READ.replace("payload binary, ", "")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(k, kinds[t]) for k, t in (x.split() for x in schema.split(", "))])
    spark = keys.sparkSession
    sent = spark.sparkContext.broadcast(_pages(spark, root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(sent.value, root, layout.span_bytes)
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for i in range(0, len(wanted), 1024):  # records of neighbouring keys are read together
                entries = [e for key in wanted[i : i + 1024] for e in search.entries(key)]
                rows: list[dict] = []
                size = 0
                for r in search.records(entries):
                    rows.append({k: r[k] for k in arrow.names})
                    size += len(r["payload"]) if payloads else 64
                    if size >= layout.span_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.select("key").repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, schema)


class CaptureIndex:
    """Lookups of single URLs. Holds the table of pages."""

    def __init__(self, spark: SparkSession, root: str, layout: Layout = Layout()):
        self.search = _Search(_pages(spark, root), root, layout.span_bytes)

    def lookup(self, url: str) -> list[dict]:
        """All captures of a URL."""
        return list(self.search.records(self.search.entries(plain_url_key(url))))


def round_trip(pages: DataFrame, root: str | None = None, layout: Layout = Layout(), payloads: bool = False) -> DataFrame:
    """Writes the archives and reads them back: every distinct key is looked up in the index."""
    root = root or f"{shared_dir(pages.sparkSession)}/warc"
    write_archives(pages, root, layout)
    return find(_keyed(pages).select("key").distinct(), root, layout, payloads)
