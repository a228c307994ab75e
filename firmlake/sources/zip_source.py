"""Bulk archives as Spark data sources: ``spark.read.format("zip_entries" | "company_csv" | "accounts_filings").load(folder)``.

* ``zip_entries``: a row per entry, with its body.
* ``company_csv``: a row per record of the first CSV entry of each archive, text columns under their table names.
* ``accounts_filings``: a row per report period of each filing, for ``sources.accounts.records``.

Planning looks at file names and sizes only. Archives of entries are cut into ranges of ``splitBytes``, or of more where an
archive would have more than RANGES; a task reads the archive's directory and takes the entries that begin in its range, so
a large archive is shared by many tasks and the driver holds nothing of it. The
directory is read once for each range of its archive: their number is bounded, so that this reading grows with the archive
and not with its square. A nested archive that is stored uncompressed is opened where it lies, as a part of the outer
file, and its entries fall to ranges like any others: its size bounds neither memory nor tasks. A nested archive that is
compressed cannot be sought in; it is unpacked by the task in whose range it begins.

Filters on ``extension`` are pushed down: other entries are not unpacked. Columns that the schema given to the reader leaves
out are not made; without ``body`` nothing is unpacked at all.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from firmlake.sources.accounts import IXBRL_EXTENSIONS, PERIODS, XBRL_EXTENSIONS, period_converter
from firmlake.sources.archives import csv_batches, csv_schema, extension, inflate, open_file
from firmlake.sources.company_csv import CSV_COLUMNS

ENTRIES = "archive string, entry string, pos long, inner_pos long, extension string, unpacked long, body binary, reject string"
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
RANGES = 16  # of one archive


class Window(io.RawIOBase):
    """A part of a seekable file, as a file of its own."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.at = file, start, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def read(self, size: int = -1) -> bytes:
        left = max(0, self.size - self.at)
        size = left if size is None or size < 0 else min(size, left)
        self.file.seek(self.start + self.at)
        data = self.file.read(size) if size else b""
        self.at += len(data)
        return data


def _facts(path: str, e: zipfile.ZipInfo, pos: int, inner: int, base: int) -> dict:
    return {
        "archive": path, "entry": e.filename, "pos": pos, "inner_pos": inner, "extension": extension(e.filename), "reject": None,
        "offset": base + e.header_offset, "packed": e.compress_size, "unpacked": e.file_size, "crc": e.CRC, "method": e.compress_type,
    }


def _data_start(file, e: dict) -> int:
    file.seek(e["offset"])
    header = file.read(30)
    return e["offset"] + 30 + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little")


def entries(path: str, start: int, stop: int, wanted: set[str] | None, bodies: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Entries that begin in a range of an archive, with their bodies; damage costs the entry, or the archive if its directory is lost.

    ``wanted`` are the extensions to take, all if it is nothing. What cannot be read has a reject reason and no body; an
    archive that cannot be opened gives its reject in the range that begins at 0.
    """

    def one(file, e: dict) -> tuple[dict, bytes | None]:
        try:
            return e, inflate(file, e) if bodies else None
        except Exception as error:
            return {**e, "reject": f"entry: {error}"}, None

    def compressed(file, e: dict) -> Iterator[tuple[dict, bytes | None]]:
        with zipfile.ZipFile(io.BytesIO(inflate(file, e))) as inner:
            for k, info in enumerate(inner.infolist()):
                own = _facts(path, info, e["pos"], k, 0)
                if wanted is None or own["extension"] in wanted:
                    try:
                        yield own, inner.read(info) if bodies else None
                    except Exception as error:
                        yield {**own, "reject": f"entry: {error}"}, None

    def stored(file, e: dict) -> Iterator[tuple[dict, bytes | None]]:
        begin = _data_start(file, e)
        if begin >= stop or begin + e["packed"] <= start:
            return
        with zipfile.ZipFile(Window(file, begin, e["packed"])) as inner:
            for k, info in enumerate(inner.infolist()):
                own = _facts(path, info, e["pos"], k, begin)
                if start <= own["offset"] < stop and (wanted is None or own["extension"] in wanted):
                    yield one(file, own)

    try:
        file = open_file(path)
        archive = zipfile.ZipFile(file)
    except Exception as error:
        if start == 0:
            yield {"archive": path, "reject": f"archive: {error}"}, None
        return
    with file, archive:
        for pos, info in enumerate(archive.infolist()):
            e = _facts(path, info, pos, 0, 0)
            own = start <= e["offset"] < stop
            nested = e["extension"] == "zip" and (wanted is None or "zip" not in wanted)
            if nested and (own or e["method"] == zipfile.ZIP_STORED):
                try:
                    yield from stored(file, e) if e["method"] == zipfile.ZIP_STORED else compressed(file, e)
                except Exception as error:
                    if own:
                        yield {**e, "reject": f"entry: {error}"}, None
            elif own and not nested and (wanted is None or e["extension"] in wanted):
                yield one(file, e)


def files(path: str, suffix: str = ".zip") -> list[tuple[str, int]]:
    """Names and sizes of the archives below a folder, or of the one archive."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    fs, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if scheme else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.is_file and f.path.endswith(suffix)]
    # Other file systems give paths without the part of the address that names them.
    prefix = path[: len(path) - len(inner)] if scheme and path.endswith(inner) else scheme
    return sorted((prefix + f.path, f.size) for f in found)


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class EntryReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType, extensions: list[str] | None = None):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        given = options["extensions"].split(",") if options.get("extensions") else extensions
        self.wanted = {e.strip().lower() for e in given} if given else None
        self.schema, self.bodies, self.pushed = schema, "body" in schema.names, False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("extension",):
                own = {f.value}
            elif isinstance(f, In) and f.attribute == ("extension",):
                own = set(f.value)
            elif isinstance(f, IsNotNull) and f.attribute == ("extension",):
                own = self.wanted
            else:
                yield f
                continue
            self.wanted, self.pushed = own if self.wanted is None else self.wanted & own, True

    def partitions(self) -> Sequence[InputPartition]:
        # The directory stands at the end, so the last range has no entries of its own; one that is smaller is no task.
        out = []
        for path, size in files(self.path):
            count = min(RANGES, max(1, round(size / self.split)))
            cuts = [k * size // count for k in range(count)] + [1 << 62]
            out += [Range(path, a, b) for a, b in zip(cuts, cuts[1:])]
        return out

    def found(self, part: Range) -> Iterator[tuple[dict, bytes | None]]:
        for e, body in entries(part.path, part.start, part.stop, self.wanted, self.bodies):
            # Spark does not ask a pushed filter again: a reject of another extension, or of a whole archive, would not pass it.
            if not self.pushed or (e.get("extension") is not None and (self.wanted is None or e["extension"] in self.wanted)):
                yield e, body

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        rows, size = [], 0
        for e, body in self.found(partition):
            rows.append({**e, "body": body})
            size += len(body or b"") + 200
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class ZipEntries(DataSource):
    """Options: ``path``, ``extensions`` (with commas between), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return EntryReader(self.options, schema)


class FilingReader(EntryReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        super().__init__(options, schema, XBRL_EXTENSIONS + IXBRL_EXTENSIONS)
        self.names, self.bodies = schema.names, True
        self.signs = str(options.get("applysignscale", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return filters

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        blank = {"entry": None, "pos": None, "inner_pos": None, "extension": None}
        for batch in period_converter(self.signs)(({**blank, **e}, body) for e, body in self.found(partition)):
            yield batch.select(self.names)


class AccountsFilings(DataSource):
    """Options: ``path``, ``splitBytes``, ``applySignScale``."""

    @classmethod
    def name(cls) -> str:
        return "accounts_filings"

    def schema(self) -> str:
        return PERIODS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FilingReader(self.options, schema)


class CsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.names = options["path"], schema.names
        # Columns that nobody asks for are not taken out of the text.
        self.mapping = {s: t for s, t in CSV_COLUMNS.items() if t in self.names}

    def partitions(self) -> Sequence[InputPartition]:
        return [Range(path, 0, size) for path, size in files(self.path)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for batch in csv_batches(partition.path, self.mapping):
            yield batch.select(self.names)


class CompanyCsv(DataSource):
    """Option: ``path``. A compressed entry cannot be cut: there is a task per archive."""

    @classmethod
    def name(cls) -> str:
        return "company_csv"

    def schema(self) -> str:
        return csv_schema(CSV_COLUMNS)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CsvReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session. The package must be on the executors (``session.ship``)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZipEntries, AccountsFilings, CompanyCsv):
        spark.dataSource.register(source)
