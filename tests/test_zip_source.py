import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firmlake.sources.accounts import records
from firmlake.sources.zip_source import EntryReader, Window, entries, files, register
from tests.test_products import INLINE


def zip_bytes(entries_, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries_:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def outer(folder):
    """An archive with plain entries, a stored and a compressed archive inside, junk and a damaged entry."""
    big = os.urandom(3000)
    inner = zip_bytes([(f"in{k}.html", big + bytes([k])) for k in range(30)])
    packed = zip_bytes([(f"pk{k}.xml", f"<a>{k}</a>") for k in range(5)])
    path = os.path.join(folder, "zips", "a.zip")
    os.makedirs(os.path.dirname(path))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(40):
            z.writestr(f"f{k}.html", f"body {k} ".encode() * 300)
        z.writestr("stored.zip", inner)
        z.writestr("packed.zip", packed, zipfile.ZIP_DEFLATED)
        z.writestr("junk.zip", b"nothing")
        z.writestr("bad.html", b"GOOD CONTENT")
        z.writestr("last.txt", b"end")
    with open(path, "wb") as f:
        f.write(out.getvalue().replace(b"GOOD CONTENT", b"BAD_ CONTENT"))
    with open(os.path.join(folder, "zips", "b.zip"), "wb") as f:
        f.write(b"no archive at all")
    return os.path.dirname(path)


def want():
    return sorted([f"f{k}.html" for k in range(40)] + [f"in{k}.html" for k in range(30)] + [f"pk{k}.xml" for k in range(5)] + ["bad.html", "junk.zip", "last.txt"])


@pytest.mark.parametrize("split", [1000, 20_000, 1 << 30])
def test_ranges_hold_every_entry_once(outer, split):
    path, size = files(outer)[0]
    cuts = [*range(0, size, split), 1 << 62]
    parts = [list(entries(path, a, b, None, True)) for a, b in zip(cuts, cuts[1:])]
    found = [(e, body) for part in parts for e, body in part]
    assert sorted(e["entry"] for e, _ in found) == want()
    assert {e["entry"] for e, _ in found if e["reject"]} == {"bad.html", "junk.zip"}
    bodies = {e["entry"]: body for e, body in found}
    assert bodies["f3.html"] == b"body 3 " * 300 and bodies["in7.html"][-1] == 7 and bodies["pk4.xml"] == b"<a>4</a>"
    if split == 1000:  # the entries of the stored archive are shared by many tasks
        assert sum(any(e["entry"].startswith("in") for e, _ in part) for part in parts) > 20


def test_window_is_a_file():
    w = Window(io.BytesIO(b"0123456789"), 2, 5)
    assert w.read(2) == b"23" and w.tell() == 2 and w.seek(-1, 2) == 4 and w.read() == b"6" and w.read(5) == b"" and w.seek(1, 0) == 1


def test_format_filters_and_columns(spark, outer, monkeypatch):
    register(spark)
    df = spark.read.format("zip_entries").option("splitBytes", 30_000).load(outer)
    rows = df.collect()
    assert sorted(r["entry"] for r in rows if r["entry"]) == want()
    assert [r["archive"].rsplit("/", 1)[1] for r in rows if r["entry"] is None] == ["b.zip"]
    html = df.where("extension = 'html'")
    assert {r["entry"] for r in html.collect()} == {e for e in want() if e.endswith(".html")}
    assert "Filter" not in html._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")  # Spark has nothing left to filter
    assert df.where(F.col("extension").isin("xml", "txt") & (F.col("unpacked") < 8)).count() == 1
    names = spark.read.format("zip_entries").schema("entry string, reject string").option("extensions", "html").load(outer)
    got = {r["entry"]: r["reject"] for r in names.collect()}
    assert got["bad.html"] is None and len([e for e in got if e]) == 71 + 1  # nothing was unpacked, so no damage was met; junk.zip is a reject


def test_planning_reads_no_archive(outer):
    reader = EntryReader({"path": outer, "splitbytes": "10000"}, StructType())
    parts = reader.partitions()
    assert len(parts) > 10 and {p.path.rsplit("/", 1)[1] for p in parts} == {"a.zip", "b.zip"}
    with pytest.raises(FileNotFoundError):
        files(outer + "/nowhere")


def test_filings(spark, folder):
    register(spark)
    place = os.path.join(folder, "filings")
    os.makedirs(place)
    inner = zip_bytes([("Prod223_2125_09652609_20180331.html", INLINE)])
    with open(os.path.join(place, "x.zip"), "wb") as f:
        f.write(zip_bytes([("inner.zip", inner), ("other.txt", b"x"), ("Prod223_1_00000001_20200101.html", b"<html>")], zipfile.ZIP_STORED))
    periods = spark.read.format("accounts_filings").load(place)
    rows = records(periods).collect()
    assert {r["company_number"] for r in rows if r["reject"] is None} >= {"09652609"}
    assert periods.select("company_number", "period").count() == len(rows)


def test_company_records(spark, folder):
    register(spark)
    place = os.path.join(folder, "companies")
    os.makedirs(place)
    with open(os.path.join(place, "c.zip"), "wb") as f:
        f.write(zip_bytes([("a.csv", " CompanyNumber,CompanyName,Other\n1,ONE,x\n2,TWO,y\n3,THREE,z,too much\n")]))
    df = spark.read.format("company_csv").load(place)
    assert sorted((r["company_number"] or "", r["company_name"] or "", r["reject"] is None) for r in df.collect()) == [("", "", False), ("1", "ONE", True), ("2", "TWO", True)]
    slim = spark.read.format("company_csv").schema("company_name string").load(place)
    assert sorted(r["company_name"] or "" for r in slim.collect()) == ["", "ONE", "TWO"]


def test_directories_are_read_a_bounded_number_of_times(outer):
    """Small ranges do not multiply with the archive: each of them would read its directory."""
    from firmlake.sources.zip_source import RANGES

    reader = EntryReader({"path": outer, "splitbytes": "100"}, StructType([]))
    parts = [p for p in reader.partitions() if p.path.endswith("a.zip")]
    assert len(parts) == RANGES and parts[0].start == 0 and parts[-1].stop == 1 << 62
    assert all(a.stop == b.start for a, b in zip(parts, parts[1:]))
    found = [e["entry"] for p in parts for e, _ in entries(p.path, p.start, p.stop, None, True)]
    assert sorted(found) == want()


def test_a_small_entry_is_one_read(folder):
    """Header and data come together; a long extra field or a large entry takes a second read."""
    from firmlake.sources.archives import EXTRA_BYTES, SMALL_BYTES, inflate

    class Counting(io.BytesIO):
        reads = 0

        def read(self, size=-1):
            self.reads += 1
            return super().read(size)

    big = os.urandom(SMALL_BYTES + 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, extra, data in (("small.html", b"", b"abc" * 99), ("extra.html", b"\x99\x99" + bytes([200, 0]) + b"x" * 200, b"abc" * 99), ("big.html", b"", big), ("last.html", b"", b"")):
            info = zipfile.ZipInfo(name)
            info.extra, info.compress_type = extra, zipfile.ZIP_STORED if name == "last.html" else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    assert EXTRA_BYTES < 200
    for info, reads, data in zip(zipfile.ZipFile(out).infolist(), (1, 2, 2, 1), (b"abc" * 99, b"abc" * 99, big, b"")):
        f = Counting(out.getvalue())
        e = {"entry": info.filename, "offset": info.header_offset, "packed": info.compress_size, "unpacked": info.file_size, "crc": info.CRC, "method": info.compress_type}
        assert inflate(f, e) == data and f.reads == reads


def test_rows_of_a_batch_keep_their_values():
    import pyarrow as pa

    from firmlake.sources.archives import dicts

    rows = [{"a": "x", "n": 1 << 60, "m": None, "b": b"\x00\x01", "f": True, "z": None}, {"a": None, "n": -1, "m": (1 << 60) + 1, "b": None, "f": False, "z": None}]
    schema = pa.schema([("a", pa.string()), ("n", pa.int64()), ("m", pa.int64()), ("b", pa.binary()), ("f", pa.bool_()), ("z", pa.string())])
    for own in (rows, []):
        batch = pa.RecordBatch.from_pylist(own, schema=schema)
        assert list(dicts(batch)) == own and [type(v) for r in dicts(batch) for v in r.values()] == [type(v) for r in own for v in r.values()]
