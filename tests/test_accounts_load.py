"""A load of accounts archives: what each of very many small filings costs."""

import io
import zipfile

import pytest

from firmlake.sources import accounts
from firmlake.sources.archives import ENTRIES_PER_TASK, list_entries, pack, read_archives, read_entries

PLAIN = (
    "<html><xbrli:context id='now'><xbrli:endDate>2020-01-31</xbrli:endDate></xbrli:context>"
    "<ix:nonFraction name='uk:Creditors' contextRef='now'><b>1</b>0</ix:nonFraction>"
    "<ix:nonFraction contextRef='now' name='uk:FixedAssets'/>"
    "<ix:nonFraction contextRef='now' name='uk:FixedAssets' sign='-'>2</ix:nonFraction>"
    "<ix:nonNumeric name='uk:ReportTitle' contextRef='now'>Report <i>7</i></ix:nonNumeric></html>"
)
ODD = [
    PLAIN.replace("id='now'", "id='context'"),
    PLAIN.replace("ix:nonFraction", "ix:NONfraction"),
    PLAIN.replace("ix:nonFraction", "nonFraction"),
    PLAIN.replace("</ix:nonFraction>", "", 1),
    PLAIN.replace("</ix:nonFraction>", "</ix:nonFraction >", 1),
    PLAIN.replace("</ix:nonFraction>", ""),
    PLAIN.replace("Report", "Report <ix:nonNumeric name='uk:EntityTradingStatus' contextRef='now'>a</ix:nonNumeric>"),
    PLAIN.replace("Report", "nonNumeric"),
    PLAIN.replace("<b>", "<b x='<ix:nonFraction'>"),
    PLAIN.replace("<xbrli:context ", "<xbrli:contextRef x='y'><xbrli:context "),
    PLAIN.replace("Report", "İ Report"),
    PLAIN.replace("<ix:nonFraction ", "<ix:nonFractions "),
    PLAIN[:-40],
    "<ix:nonFraction",
    "",
]


def by_elements(text, name, closed):
    low = text.lower()
    return list(accounts._elements(text, low if len(low) == len(text) else text.translate(accounts.LOWER), name, closed))


@pytest.mark.parametrize("text", [PLAIN, *ODD])
def test_cut_elements_are_those_that_a_search_finds(text):
    low = text.lower()
    low = low if len(low) == len(text) else text.translate(accounts.LOWER)
    for name, closed in (("context", False), ("nonfraction", True), ("nonnumeric", True)):
        assert list(accounts._cut(text, low, name, closed)) == by_elements(text, name, closed)


def test_a_plain_document_is_not_searched_element_by_element(monkeypatch):
    def search(*_):
        raise AssertionError("searched")

    want = accounts._read_inline(PLAIN.encode())
    assert want == (None, {"now": ("2020-01-31", None)}, [
        (("uk:Creditors", "now", False, 1.0), "10"), (("uk:FixedAssets", "now", False, -1.0), "2"), (("uk:ReportTitle", "now", True, 1.0), "Report 7"),
    ])
    monkeypatch.setattr(accounts, "_elements", search)
    assert accounts._read_inline(PLAIN.encode()) == want


@pytest.mark.parametrize("entries", [
    [], [("a.html", b"")], [("ä/é.html", "ü".encode()), ("b.html", b"x" * 200_000), ("b.html", b"twice")],
    [(f"{k}.html", b"%d" % k) for k in range(65_535)], [(f"{k}.html", b"%d" % k) for k in range(70_000)],
])
def test_packed_archives_hold_their_entries(entries):
    out = io.BytesIO()
    pack(out, iter(entries))
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None
        assert [(i.filename, z.read(i)) for i in z.infolist()] == entries


def test_archives_read_at_once_give_what_their_listing_gives(spark, tmp_path):
    inner = io.BytesIO()
    pack(inner, [("inner.html", PLAIN.encode()), ("inner.txt", b"no filing")])
    some = [(f"Prod223_1_{k:08d}_20200131.html", PLAIN.encode()) for k in range(2 * ENTRIES_PER_TASK + 1)]
    for name, entries in (("a", [*some, ("nested.zip", inner.getvalue()), ("none.zip", b"x"), ("no.txt", b"")]), ("b", some[:1]), ("empty", [])):
        with open(f"{tmp_path}/{name}.zip", "wb") as out:
            pack(out, entries)
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "damaged.zip").write_bytes(b"\0" * 60 + whole[60:])
    (tmp_path / "junk.zip").write_bytes(b"junk")
    paths = [(f"{tmp_path}/{name}.zip",) for name in ("a", "b", "empty", "damaged", "junk", "missing", "a")] + [(None,)]
    paths = spark.createDataFrame(paths, "path string")
    kinds = ["html"]
    convert = accounts.period_converter()

    def rows(df):
        return sorted(str(r.asDict(recursive=True)) for r in df.collect())

    want = rows(read_entries(list_entries(paths, kinds), convert, accounts.PERIODS, kinds))
    got = rows(read_archives(paths, convert, accounts.PERIODS, kinds))
    assert got == want and len(got) > 6 * ENTRIES_PER_TASK
    assert accounts.read_financials(paths).count() == len(got)
