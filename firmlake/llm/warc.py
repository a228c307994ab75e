"""WARC archives with a two-level capture index.

Writing: every page becomes a record. Spark builds the records and writes them as uncompressed WARC files, RECORDS a
file; nothing is shuffled unless there are very many repeated payloads. Of pages with equal payloads of at least
LEAST_REVISIT bytes the one with the smallest id is a ``response``, the others are ``revisit`` records without payload.

Indexing: the archives are read back, every record is checked against its digest, and one line per capture (reversed
host and path, page, file, offset, length and so on) is range-partitioned by key and packed into compressed blocks of
LINES lines. The directory holds the first and last key of each block and no lines.

Looking up: the partitions' key ranges (one row per partition) tell where a key can lie, a binary search in the
partition's directory finds the blocks, and only those blocks are unpacked. ``fetch`` then seeks the byte ranges in the
archives that hold them, and ``payloads`` reads revisits where they refer to, whose place it looks up in the index.
Archives are never held whole; they must lie where ``pyarrow.fs`` can open them (local folders, HDFS, S3).
"""

from __future__ import annotations

import bisect
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.session import settle
from firmlake.sources.archives import open_file

LEAST_REVISIT = 100
RECORDS = 4096  # in an archive file
LINES = 1000  # in an index block
BATCH_BYTES = 4 << 20  # of payloads are handed on at once; a longer payload makes a larger batch
CRLF = "\r\n"


def _uuid(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("-")), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_kinds(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_url`` of every page."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    base = base.withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": F.sha2(F.col("payload").cast("binary"), 256),
    })
    first = (
        base.where(F.col("payload_bytes") >= LEAST_REVISIT)
        .groupBy("payload_digest").agg(
            F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_f"), F.count("*").alias("_n")
        ).where("_n > 1 and _f is not null")
        .select(F.col("payload_digest").alias("_digest"), F.col("_f.page_id").alias("_first"), F.col("_f.url").alias("_first_url"))
    )
    joined = base.join(settle(first, "payloads"), F.col("payload_digest") == F.col("_digest"), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"), F.when(again, F.col("_first_url")).alias("refers_url"),
    )


def write_archives(pages: DataFrame, path: str, fetched: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC record per row of ``page_id, url, html`` below ``path``; a null html is an empty payload.

    Equal rows give equal records. Control characters and blanks in a URL become ``%20``; a null URL becomes the
    record's id. A null page id is left out of the record.
    """
    rows = with_kinds(pages)
    own = _uuid(F.col("page_id"), F.col("payload_digest"))
    again = F.col("record_type") == "revisit"
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    )

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))

    def target(url: str, record: Column) -> Column:
        return F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"), F.substring(record, 2, 45))

    first = _uuid(F.col("refers_to"), F.col("payload_digest"))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", own),
        field("WARC-Target-URI", target("url", own)), field("WARC-Date", F.lit(fetched)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        field("WARC-Refers-To", F.when(again, first)),
        field("WARC-Refers-To-Target-URI", F.when(again, target("refers_url", first))),
        field("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        field("X-Page-Id", F.col("page_id")), field("X-Refers-To-Page", F.col("refers_to")),
        field("X-Payload-Length", F.col("payload_bytes")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(CRLF + CRLF),
    )
    # Each record is a row of a text file whose line end is the record's end.
    rows.select(F.concat(head, http, body).alias("value")).write.option("lineSep", CRLF + CRLF).option(
        "compression", "none"
    ).option("maxRecordsPerFile", RECORDS).text(path)


def surt(url: str | None) -> str:
    """The URL's sort key: host labels in reverse order, then the rest; scheme, port, user and a leading www. are left out."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "")
    if not m:
        return url or ""
    host = m[1].lower().rstrip(".").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def records_in(f) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and payload of each record of an open archive, one after the other."""
    at = 0
    while line := f.readline():
        lines = [line]
        while lines[-1] != b"\r\n":
            if not (line := f.readline()):
                raise ValueError(f"the record at {at} is not whole")
            lines.append(line)
        head = dict(x.decode("utf-8", "replace").rstrip(CRLF).split(": ", 1) for x in lines[1:-1])
        size = int(head["Content-Length"])
        block = f.read(size)
        f.read(4)
        length = sum(map(len, lines)) + size
        yield at, length, head, block[block.index(b"\r\n\r\n") + 4 :]
        at += length + 4


CAPTURE = "key string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, at long, length long, refers_url string"
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64()}
_SCHEMA = pa.schema([(n, _KINDS[x.split()[1]]) for n, x in zip(_NAMES, CAPTURE.split(", "))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_SCHEMA)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows = []
            with open_file(file) as opened, io.BufferedReader(opened, 1 << 20) as f:
                for at, length, head, payload in records_in(f):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file}: the record at {at} does not match its digest")
                    size = len(payload) if head["WARC-Type"] == "response" else int(head["X-Payload-Length"])
                    url = head["WARC-Target-URI"]
                    rows.append((surt(url), _number(head.get("X-Page-Id")), url, head["WARC-Type"], size, digest,
                                 _number(head.get("X-Refers-To-Page")), file, at, length, head.get("WARC-Refers-To-Target-URI")))
                    if len(rows) == RECORDS:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The archives' paths; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, read back and checked."""
    return archives(spark, path).mapInArrow(_captures, CAPTURE)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, lines = TaskContext.get().partitionId(), 0, []

    def block() -> pa.RecordBatch:
        data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
        return pa.record_batch(
            [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([lines[0][0]]), pa.array([lines[-1][0]]), pa.array([data])],
            names=["part", "block", "first_key", "last_key", "data"],
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            lines.append(row)
            if len(lines) == LINES:
                yield block()
                number, lines = number + 1, []
    if lines:
        yield block()


def write_index(found: DataFrame, path: str) -> None:
    """Write the captures' index below ``path``: compressed blocks of lines in key order, with their first and last keys.

    A key with very many captures is spread over several blocks and partitions: the page and the place sort as well.
    """
    ordered = found.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    ordered.select(*_NAMES).mapInArrow(
        _pack, "part long, block long, first_key string, last_key string, data binary"
    ).write.parquet(path)


def _unpack(data: bytes) -> list[tuple]:
    return [tuple(json.loads(x)) for x in zlib.decompress(data).decode().split("\n")]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All captures of an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield _rows(_unpack(data.as_py()))

    return spark.read.parquet(path).select("data").mapInArrow(run, CAPTURE)


def look_up(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """The captures whose key is that of one of the URLs (column ``url``); each capture once."""
    blocks = spark.read.parquet(path)
    ranges = sorted(
        (r["low"], r["high"], r["part"])
        for r in blocks.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    )  # a row per partition that the index was written with
    lows = [r[0] for r in ranges]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                key = surt(url)
                k = bisect.bisect_right(lows, key) - 1
                while k >= 0 and ranges[k][1] >= key:  # a key can run through several partitions
                    rows.append((key, ranges[k][2]))
                    k -= 1
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["key", "part"])

    asked = urls.select("url").where("url is not null").mapInArrow(place, "key string, part long").distinct()

    def search(key, directory: pa.Table, keys: pa.Table) -> pa.Table:
        found = sorted(zip(*(directory.column(c).to_pylist() for c in ("first_key", "last_key", "block"))))
        first, hits = [f[0] for f in found], []
        for q in keys.column("key").to_pylist():
            k = bisect.bisect_right(first, q) - 1
            while k >= 0 and found[k][1] >= q:
                hits.append((key[0].as_py(), found[k][2], q))
                k -= 1
        return pa.table([pa.array([h[i] for h in hits], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["part", "block", "key"])

    directory = blocks.select("part", "block", "first_key", "last_key")
    wanted = directory.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(search, "part long, block long, key string")
    opened = blocks.select("part", "block", "data").join(wanted.select("part", "block").distinct(), ["part", "block"], "left_semi")

    def pick(key, packed: pa.Table, keys: pa.Table) -> pa.Table:
        asked_for = set(keys.column("key").to_pylist())
        rows = [x for d in packed.column("data").to_pylist() for x in _unpack(d) if x[0] in asked_for]
        return pa.Table.from_batches([_rows(rows)])

    return opened.groupBy("part", "block").cogroup(wanted.groupBy("part", "block")).applyInArrow(pick, CAPTURE)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last three columns, the place of a record, become its payload."""
    name, opened = None, None
    for batch in batches:
        width = batch.num_columns
        out, size, begin = [], 0, 0
        last, payload = None, None
        for n, place in enumerate(zip(*(batch.column(width - k).to_pylist() for k in (3, 2, 1))), 1):
            if place != last:
                file, at, length = last = place
                if file != name:
                    if opened is not None:
                        opened.close()
                    name, opened = file, open_file(file)
                opened.seek(at)
                _, _, _, found = next(records_in(io.BytesIO(opened.read(length))))
                payload = found.decode("utf-8")
            out.append(payload)
            size += len(payload)
            if size >= BATCH_BYTES or n == batch.num_rows:
                columns = [c.slice(begin, n - begin) for c in batch.columns[: width - 3]]
                yield pa.record_batch([*columns, pa.array(out, pa.string())], names=[*batch.schema.names[: width - 3], "payload"])
                out, size, begin = [], 0, n
    if opened is not None:
        opened.close()


def _read(found: DataFrame) -> DataFrame:
    """Neighbours in an archive are read by one task; a record that very many captures refer to is read by several.

    The count is given outright: rows of places are tiny, and adaptive execution would merge them into few tasks.
    """
    kept = [c for c in found.columns if c not in ("file", "at", "length")]
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartitionByRange(tasks, "file", "at", "page_id").sortWithinPartitions("file", "at")
    return dealt.select(*kept, "file", "at", "length").mapInArrow(
        _cut, ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in kept) + ", payload string"
    )


def fetch(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """``page_id, payload`` of captures as their own records hold it: that of a revisit is empty, see ``payloads``."""
    return _read(found.select("page_id", "file", "at", "length"))


def payloads(spark: SparkSession, index: str, found: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload`` of captures; revisits are read where they refer to.

    The places of the records that revisits refer to are looked up in the index.
    """
    asked = found.where("record_type = 'revisit'").select(F.col("refers_url").alias("url")).distinct()
    held = look_up(spark, index, asked).where("record_type = 'response' and page_id is not null")
    held = held.groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(
        F.min(F.struct("file", "at", "length")).alias("_held")
    )
    again = F.col("record_type") == "revisit"
    joined = found.join(held, again & (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    places = [
        F.when(again, F.coalesce(f"_held.{c}", F.raise_error(F.lit("a revisit refers to no record")).cast(k))).otherwise(F.col(c)).alias(c)
        for c, k in (("file", "string"), ("at", "long"), ("length", "long"))
    ]
    return _read(joined.select("page_id", "url", "record_type", "refers_to", *places))
