"""ZIP archives as rows.

Archives are opened where they lie and read by seeking, never loaded whole. A listing pass reads only the archives'
directories; the entries are then dealt by archive and block of positions, so one archive with a third of all filings is
shared by many tasks. A nested archive is one unit: it is unpacked once, where its entries are read. A single compressed
CSV or JSON entry cannot be split; it is streamed in blocks, and its rows are dealt out right after reading, so that all
parsing that follows is shared.

Damage costs as little as possible: an entry whose checksum is wrong, a record with too many fields, a line that is not
UTF-8 or whose quote stays open becomes one reject, and reading goes on with what follows. Records have no longest length.
"""

from __future__ import annotations

import csv
import io
import pickle
import struct
import sys
import zipfile
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ENTRIES = (
    "archive string, entry string, pos long, inner_pos long, offset long, packed long, unpacked long, crc long, method int, "
    "nested boolean, extension string, reject string"
)
ENTRY_NAMES = [field.split()[0] for field in ENTRIES.split(", ")]
LINES = "archive string, entry string, line_no long, line string, reject string"
BLOCK_BYTES = 4 << 20  # lines are handed on in blocks of about this size; a longer line makes a larger block
ROWS_PER_LISTING = 10_000
ENTRIES_PER_TASK = 64  # neighbours in an archive that stay together
SMALL_BYTES = 1 << 16  # packed entries up to this size are read together with their header
EXTRA_BYTES = 64  # what a header usually holds besides its fixed part and the name
LOCAL, CENTRAL = struct.Struct("<4s5H3L2H"), struct.Struct("<4sBB5H3L5H2L")  # the frames of an entry
LINES_BY_ONE = 64  # so many lines with a damaged one among them are read one by one


def open_file(path: str):
    """Seekable handle on a file of any file system the path names."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path)
    fs, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.open_input_file(inner)


def files_of(folder: str, suffix: str = ".parquet") -> list[str]:
    """Paths of the files in a folder, as ``open_file`` takes them."""
    plain = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
    fs, inner = (pafs.LocalFileSystem(), plain) if "://" not in plain else pafs.FileSystem.from_uri(plain.replace("s3a://", "s3://", 1))
    before = plain[: len(plain) - len(inner)] if plain.endswith(inner) else ""
    return sorted(before + f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.is_file and f.path.endswith(suffix))


def extension(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def spread(df: DataFrame, *keys) -> DataFrame:
    """Rows dealt by the hash of the keys to as many tasks as a shuffle has.

    The count is given outright: rows that stand for whole files are tiny, and adaptive execution would otherwise merge
    them all into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _directory(path: str, extensions: list[str]) -> Iterator[tuple]:
    """Rows of ENTRIES: those of one archive that ``list_entries`` gives, from its directory."""
    try:
        with open_file(path) as f, zipfile.ZipFile(f) as z:
            for pos, e in enumerate(z.infolist()):
                kind = extension(e.filename)
                if kind in extensions or kind == "zip":
                    place = (e.header_offset, e.compress_size, e.file_size, e.CRC, e.compress_type)
                    yield (path, e.filename, pos, 0, *place, kind not in extensions, kind, None)
    except Exception as error:
        yield (path, *[None] * 10, f"archive: {error}")


def list_entries(paths: DataFrame, extensions: list[str]) -> DataFrame:
    """Entries with one of the extensions in the archives of column ``path``, and a row per nested archive.

    Only directories are read. What cannot be opened gives one row with a reject reason.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(ENTRIES))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ([] for _ in schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        for incoming in batches:
            for path in incoming.column("path").to_pylist():
                found = _directory(path, extensions)
                while rows := list(islice(found, ROWS_PER_LISTING)):
                    yield batch(rows)

    return spread(paths.select("path"), "path").mapInArrow(run, ENTRIES)


def inflate(f, e: dict) -> bytes:
    """One entry by its place in the archive, without reading the archive's directory again; a small one with a single read."""
    f.seek(e["offset"])
    head = f.read(30 + len(e["entry"] or "") + EXTRA_BYTES + (e["packed"] if e["packed"] <= SMALL_BYTES else 0))
    name_length, extra_length = struct.unpack("<HH", head[26:30])
    start = 30 + name_length + extra_length
    if start + e["packed"] <= len(head):
        data = head[start : start + e["packed"]]
    else:
        f.seek(e["offset"] + start)
        data = f.read(e["packed"])
    if e["method"] == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif e["method"] != zipfile.ZIP_STORED:
        raise ValueError(f"compression method {e['method']}")
    if len(data) != e["unpacked"]:
        raise ValueError("wrong length")
    if zlib.crc32(data) != e["crc"]:
        raise ValueError("wrong checksum")
    return data


def dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch; its columns become Python values whole where that keeps them as they are."""

    def values(column: pa.Array) -> list:
        whole = column.null_count == 0 or pa.types.is_string(column.type) or pa.types.is_binary(column.type)
        return column.to_numpy(zero_copy_only=False).tolist() if whole else column.to_pylist()

    names = batch.schema.names
    for row in zip(*[values(c) for c in batch.columns]):
        yield dict(zip(names, row))


def _bodies(rows: Iterator[dict], extensions: list[str]) -> Iterator[tuple[dict, bytes | None]]:
    """(listing row, body) of listed entries, as ``read_entries`` hands them on."""

    def nested(e: dict, body: bytes) -> Iterator[tuple[dict, bytes | None]]:
        with zipfile.ZipFile(io.BytesIO(body)) as inner:
            for k, name in enumerate(inner.infolist()):
                if extension(name.filename) in extensions:
                    own = {**e, "entry": name.filename, "inner_pos": k, "extension": extension(name.filename)}
                    try:
                        yield own, inner.read(name)
                    except Exception as error:
                        yield {**own, "reject": f"entry: {error}"}, None

    handle, opened = None, None
    for e in rows:
        if e["reject"] is not None:
            yield e, None
            continue
        try:
            if opened != e["archive"]:
                handle, opened = open_file(e["archive"]), e["archive"]
            body = inflate(handle, e)
            if e["nested"]:
                yield from nested(e, body)
                continue
        except Exception as error:
            opened = None
            yield {**e, "reject": f"entry: {error}"}, None
            continue
        yield e, body


def read_entries(listing: DataFrame, convert: Callable, ddl: str, extensions: list[str]) -> DataFrame:
    """Rows that ``convert`` makes of listed entries.

    ``convert`` takes an iterator of (listing row, body) and yields Arrow batches of the schema ``ddl``. It runs where
    the entry is unpacked, so bodies never leave the task. A row with a reject reason comes without a body. The entries
    of a nested archive come one after the other, those with one of the extensions.
    """
    dealt = spread(listing, "archive", F.floor(F.col("pos") / ENTRIES_PER_TASK))
    return dealt.mapInArrow(lambda batches: convert(_bodies((e for b in batches for e in dicts(b)), extensions)), ddl)


def read_archives(paths: DataFrame, convert: Callable, ddl: str, extensions: list[str]) -> DataFrame:
    """What ``read_entries`` gives of all that ``list_entries`` finds in the archives of column ``path``.

    Neighbours that stay together are one row between the two: most of what a small entry's listing costs is the way there.
    """
    schema = pa.schema([("archive", pa.string()), ("block", pa.int64()), ("entries", pa.binary())])

    def block(row: tuple) -> int | None:
        return None if row[2] is None else row[2] // ENTRIES_PER_TASK

    def run(batches):
        for incoming in batches:
            for path in incoming.column("path").to_pylist():
                blocks = ((path, n, pickle.dumps(list(rows))) for n, rows in groupby(_directory(path, extensions), block))
                while some := list(islice(blocks, ROWS_PER_LISTING // ENTRIES_PER_TASK)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    def rows(batches):
        for b in batches:
            for packed in b.column("entries"):
                for row in pickle.loads(packed.as_py()):
                    yield dict(zip(ENTRY_NAMES, row))

    listing = spread(paths.select("path"), "path").mapInArrow(run, "archive string, block long, entries binary")
    dealt = spread(listing, "archive", "block").select("entries")
    return dealt.mapInArrow(lambda batches: convert(_bodies(rows(batches), extensions)), ddl)


def _first_entry(z: zipfile.ZipFile, extensions: tuple[str, ...], any_entry: bool) -> str | None:
    names = z.namelist()
    for name in names:
        if name.lower().endswith(extensions):
            return name
    return names[0] if any_entry and names else None


def _line_blocks(stream) -> Iterator[list[bytes]]:
    """Lines of a stream without their ends, in blocks of about BLOCK_BYTES; a line may be of any length."""
    parts: list[bytes] = []
    while data := stream.read(BLOCK_BYTES):
        cut = data.rfind(b"\n") + 1
        if not cut:
            parts.append(data)
            continue
        yield b"".join([*parts, data[: cut - 1]]).split(b"\n")
        parts = [data[cut:]]
    rest = b"".join(parts)
    if rest:
        yield rest.split(b"\n")


def _texts(lines: list[bytes]) -> tuple[list[str | None], list[str | None]]:
    """The lines as texts, and a reason for those that are none."""
    try:
        return b"\n".join(lines).decode().split("\n"), [None] * len(lines)
    except UnicodeDecodeError:
        texts, reasons = [], []
        for line in lines:
            try:
                texts.append(line.decode())
                reasons.append(None)
            except UnicodeDecodeError as error:
                texts.append(None)
                reasons.append(f"line: {error}")
        return texts, reasons


def read_lines(paths: DataFrame, extensions: tuple[str, ...] = (".json", ".txt")) -> DataFrame:
    """Lines of the first entry with one of the extensions, else of the first entry; a line that is not UTF-8 is a reject."""
    schema = to_arrow_schema(T.StructType.fromDDL(LINES))

    def batch(archive, entry, first, lines, rejects):
        n = len(lines)
        data = [[archive] * n, [entry] * n, range(first, first + n), lines, rejects]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(data, schema)], schema=schema)

    def run(batches):
        for incoming in batches:
            for path in incoming.column("path").to_pylist():
                try:
                    with open_file(path) as f, zipfile.ZipFile(f) as z:
                        name = _first_entry(z, extensions, any_entry=True)
                        if name is None:
                            raise ValueError("no entry")
                        first = 0
                        with z.open(name) as stream:
                            for lines in _line_blocks(stream):
                                yield batch(path, name, first, *_texts([x.rstrip(b"\r") for x in lines]))
                                first += len(lines)
                except Exception as error:
                    yield batch(path, None, 0, [None], [f"archive: {error}"])

    return spread(spread(paths.select("path"), "path").mapInArrow(run, LINES), "archive", "line_no")


class _Records:
    """CSV records from lines. Blocks of plain lines go through Arrow's reader, lines it stumbles over one by one."""

    def __init__(self, header: list[str], mapping: dict[str, str]):
        self.columns = [h if header.index(h) == i else f"_repeat_{i}" for i, h in enumerate(header)]
        self.header, self.mapping = header, mapping
        self.wanted = [h for h in dict.fromkeys(header) if h in mapping]
        self.first = 0  # number of the next record
        self.open = False  # was a line set aside whose quote stays open, with no whole record since?
        self.scanned, self.quotes = 0, 0  # lines at the start of the next block that leave the first one's quote open, their quotes
        csv.field_size_limit(sys.maxsize)

    def blocks(self, lines: list[bytes], last: bool) -> tuple[list[tuple], list[bytes]]:
        """(record numbers, rejects, columns) of the lines' records, and lines to be read with the next block."""
        out: list[tuple] = []
        lines = [x.rstrip(b"\r") for x in lines]
        rest = self._read([x for x in lines if x], out, last)
        return out, rest

    def _read(self, lines: list[bytes], out: list[tuple], last: bool) -> list[bytes]:
        if not lines or (not self.open and not self.scanned and self._plain(lines, out)):
            return []
        half = len(lines) // 2
        if len(lines) > LINES_BY_ONE and not self.scanned:
            rest = self._read(lines[:half], out, False)
            if len(rest) < half:
                return self._read(rest + lines[half:], out, last)
        return self._each(lines, out, last)

    def _plain(self, lines: list[bytes], out: list[tuple]) -> bool:
        """Read lines that are a record each; false, and nothing read, if they are not."""
        data, odd = b"\n".join(lines) + b"\n", []

        def set_aside(row):
            odd.append((row.number, row.expected_columns, row.actual_columns, row.text))
            return "skip"

        try:
            data.decode()
            table = pacsv.read_csv(
                pa.BufferReader(data),
                read_options=pacsv.ReadOptions(use_threads=False, column_names=self.columns, block_size=len(data) + 1),
                parse_options=pacsv.ParseOptions(newlines_in_values=False, invalid_row_handler=set_aside),
                convert_options=pacsv.ConvertOptions(
                    column_types={c: pa.string() for c in self.columns}, include_columns=self.wanted, null_values=[""],
                    strings_can_be_null=True, quoted_strings_can_be_null=True,
                ),
            )
            breaks = b'"' in data and any(pa.compute.any(pa.compute.match_substring(c, "\n")).as_py() for c in table.columns)
        except (pa.ArrowInvalid, UnicodeDecodeError):
            return False
        if table.num_rows + len(odd) != len(lines) or breaks or any(o[3].count('"') % 2 for o in odd):
            return False
        aside = {o[0] - 1: o for o in odd}
        numbers = [self.first + k for k in range(len(lines)) if k not in aside]
        out.append((numbers, None, {self.mapping[h]: table.column(h).combine_chunks() for h in self.wanted}))
        for k, (_, expected, actual, text) in sorted(aside.items()):
            self._aside(self.first + k, text, expected, actual, out)
        self.first += len(lines)
        return True

    def _aside(self, number: int, text: str, expected: int, actual: int, out: list[tuple]) -> None:
        """A record with another number of fields: padded if it has too few, else a reject."""
        if actual < expected:
            self._add(out, [(number, next(csv.reader([text])))], [])
        else:
            self._add(out, [], [(number, f"{actual} fields instead of {expected}: {text}")])

    def _add(self, out: list[tuple], good: list[tuple[int, list[str]]], bad: list[tuple[int, str]]) -> None:
        if good:
            named = [dict(zip(self.header, fields)) for _, fields in good]
            out.append(([n for n, _ in good], None, {self.mapping[h]: pa.array([x.get(h) or None for x in named], pa.string()) for h in self.wanted}))
        if bad:
            out.append(([n for n, _ in bad], [reason for _, reason in bad], {}))

    def _each(self, lines: list[bytes], out: list[tuple], last: bool) -> list[bytes]:
        """One line after the other, for lines that are not all plain records.

        A line whose quote stays open is joined with those that follow, however many, if they close the quote, give the
        right number of fields, and none of them is a record by itself. If not, it is set aside, and so is everything
        after it that is no whole record, up to the next one: nobody knows where such lines belong.
        """
        good, bad, k, width = [], [], 0, len(self.header)

        def set_aside(reason: str) -> None:
            bad.append((self.first, f"line: {reason}: {lines[k].decode('utf-8', 'replace')}"))
            self.first += 1

        def keep(fields: list[str]) -> None:
            good.append((self.first, fields))
            self.first += 1

        while k < len(lines):
            try:
                text = lines[k].decode()
            except UnicodeDecodeError as error:
                set_aside(str(error))
                k += 1
                continue
            even = lines[k].count(b'"') % 2 == 0
            fields = self._fields(text) if even else None
            if fields is not None and (len(fields) == width or not self.open):
                if len(fields) > width:
                    bad.append((self.first, f"{len(fields)} fields instead of {width}: {text}"))
                    self.first += 1
                else:
                    keep(fields)
                self.open = self.open and len(fields) != width
                k += 1
            elif fields is not None:
                set_aside("it follows an open quote")
                k += 1
            elif even and not self.open and self._plain([lines[k]], out):
                k += 1
            else:
                end = self._closing(lines, k, last)
                if end is None:
                    break
                whole = self._fields(b"\n".join(lines[k : end + 1]).decode("utf-8", "replace")) if end > k else None
                if whole is not None and len(whole) == width:
                    keep(whole)
                    self.open, k = False, end + 1
                else:
                    set_aside("a quote stays open")
                    self.open, k = True, k + 1
        self._add(out, good, bad)
        return lines[k:]

    def _closing(self, lines: list[bytes], k: int, last: bool) -> int | None:
        """Place of the line that closes the quote open in line ``k``; ``k`` if there is none, nothing if that is not known yet.

        Lines that were looked at with an earlier block are not looked at again.
        """
        at, quotes = (k + self.scanned, self.quotes) if self.scanned else (k + 1, lines[k].count(b'"'))
        self.scanned = 0
        for j in range(at, len(lines)):
            if self._is_record(lines[j]):
                return k
            own = lines[j].count(b'"')
            quotes += own
            if own and quotes % 2 == 0:
                try:
                    lines[j].decode()
                except UnicodeDecodeError:
                    return k
                return j
        if last:
            return k
        self.scanned, self.quotes = len(lines) - k, quotes
        return None

    def _fields(self, text: str) -> list[str] | None:
        """The fields of one record, nothing if the text is not one."""
        try:
            rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
        except csv.Error:
            return None
        return rows[0] if len(rows) == 1 else None

    def _is_record(self, line: bytes) -> bool:
        try:
            rows = list(csv.reader([line.decode()], strict=True))
        except (csv.Error, UnicodeDecodeError):
            return False
        return len(rows) == 1 and len(rows[0]) == len(self.header) > 1 and line.count(b'"') % 2 == 0


def read_csv(paths: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Records of the first ``.csv`` entry as text columns.

    ``mapping`` gives source column -> target column; header names are trimmed, unmapped columns dropped, missing ones
    NULL, and only the empty text is NULL. A record with too few fields is padded, one with too many goes out with a
    ``reject`` reason and its text, and so does a line that is not UTF-8 or whose quote stays open up to a
    line that is a record of its own or to the end of the entry. After such a line everything is set aside up to the next
    whole record, so that pieces of a broken record never become rows. ``row_no`` is the record's place in the entry.
    """
    ddl = csv_schema(mapping)
    read = paths.select("path").transform(spread, "path").mapInArrow(
        lambda batches: (out for b in batches for path in b.column("path").to_pylist() for out in csv_batches(path, mapping)), ddl
    )
    return spread(read, "archive", "row_no")


def csv_schema(mapping: dict[str, str]) -> str:
    return "archive string, entry string, row_no long, reject string, " + ", ".join(f"`{t}` string" for t in mapping.values())


def csv_batches(path: str, mapping: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The records of one archive's first ``.csv`` entry, as ``read_csv`` describes them."""
    targets = list(mapping.values())
    names = ["archive", "entry", "row_no", "reject", *targets]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.string()] * len(targets)
    schema = pa.schema(list(zip(names, kinds)))

    def batch(archive, entry, row_nos, reject, columns):
        n = len(row_nos)
        data = [pa.array([archive] * n, pa.string()), pa.array([entry] * n, pa.string()), pa.array(row_nos, pa.int64()),
                pa.array(reject or [None] * n, pa.string())]
        data += [columns.get(t, pa.nulls(n, pa.string())) for t in targets]
        return pa.RecordBatch.from_arrays(data, schema=schema)

    def records(stream):
        reader, rest = None, []
        for lines in _line_blocks(stream):
            if reader is None:
                first = lines.pop(0).rstrip(b"\r").decode("utf-8-sig")
                reader = _Records([h.strip() for h in next(csv.reader([first]), [])], mapping)
            out, rest = reader.blocks(rest + lines, last=False)
            yield from out
        if reader is not None:
            yield from reader.blocks(rest, last=True)[0]

    try:
        with open_file(path) as f, zipfile.ZipFile(f) as z:
            name = _first_entry(z, (".csv",), any_entry=False)
            if name is None:
                raise ValueError("no .csv entry")
            with z.open(name) as stream:
                for part in records(stream):
                    yield batch(path, name, *part)
    except Exception as error:
        yield batch(path, None, [0], [f"archive: {error}"], {})


def _new_file(path: str):
    """Stream that writes a file of any file system the path names; a repeated task attempt replaces the file."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    fs, inner = (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(
        path.replace("s3a://", "s3://", 1)
    )
    fs.create_dir(inner.rsplit("/", 1)[0])
    return fs.open_output_stream(inner, buffer_size=BLOCK_BYTES)


def _write(path: str, entries) -> pd.DataFrame:
    """Pack (name, chunks of bytes) pairs into one archive."""
    with _new_file(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, chunks in entries:
            with z.open(name, "w", force_zip64=True) as entry:
                for chunk in chunks:
                    entry.write(chunk)
    return pd.DataFrame({"path": [path]})


def pack(out, entries) -> None:
    """Write (name, body) pairs to a stream as an archive.

    ``zipfile`` takes as long for the frame of a small entry as for its deflation; here an entry is framed by two packed
    structures. Bodies are less than 4 GB each, the archive may be larger and have any number of entries.
    """
    directory, at = [], 0
    for name, body in entries:
        plain, packer = name.encode("utf-8"), zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -zlib.MAX_WBITS)
        data = packer.compress(body) + packer.flush()
        facts = (0 if name.isascii() else 0x800, zipfile.ZIP_DEFLATED, 0, 0x21, zlib.crc32(body), len(data), len(body), len(plain))
        out.write(b"".join((LOCAL.pack(b"PK\3\4", 20, *facts, 0), plain, data)))
        far = struct.pack("<HHQ", 1, 8, at) if at >= zipfile.ZIP64_LIMIT else b""
        version = 45 if far else 20
        directory.append(CENTRAL.pack(b"PK\1\2", version, 3, version, *facts, len(far), 0, 0, 0, 0o600 << 16, 0xFFFFFFFF if far else at) + plain + far)
        at += LOCAL.size + len(plain) + len(data)
    size, count = sum(map(len, directory)), len(directory)
    for k in range(0, count, ROWS_PER_LISTING):
        out.write(b"".join(directory[k : k + ROWS_PER_LISTING]))
    if count > 0xFFFE or at >= zipfile.ZIP64_LIMIT or size >= zipfile.ZIP64_LIMIT:
        out.write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, at))
        out.write(struct.pack("<4sLQL", b"PK\6\7", 0, at + size, 1))
    count, size, at = min(count, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF)
    out.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, count, count, size, at, 0))


def write_lines(df: DataFrame, folder: str, entry: str, header: str | None = None) -> DataFrame:
    """One archive per partition whose single entry holds the partition's ``line`` texts; returns the paths."""

    def run(batches):
        def chunks():
            if header is not None:
                yield f"{header}\n".encode()
            for b in batches:
                yield "".join(line + "\n" for line in b["line"]).encode("utf-8")

        yield _write(f"{folder}/part-{TaskContext.get().partitionId():05d}.zip", [(entry, chunks())])

    return df.select("line").mapInPandas(run, "path string")


def write_filings(df: DataFrame, folder: str) -> DataFrame:
    """One archive per partition with an entry per row (``entry``, ``body`` text); returns the paths."""

    def run(batches):
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.zip"
        with _new_file(path) as out:
            pack(out, ((e, b.encode("utf-8")) for batch in batches for e, b in zip(batch["entry"], batch["body"])))
        yield pd.DataFrame({"path": [path]})

    return df.select("entry", "body").mapInPandas(run, "path string")
