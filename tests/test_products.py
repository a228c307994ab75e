import datetime as dt
import io
import os
import time
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from firmlake.plans.products import ACCOUNTS, COMPANY, PSC, accepted, rejects
from firmlake.sources import archives
from firmlake.sources.accounts import parse_documents, resolve_tags
from firmlake.sources.archives import read_csv, read_lines
from firmlake.sources.company_csv import CSV_COLUMNS
from firmlake.sources.psc_json import parse_lines
from firmlake.sources.tags import load_tag_dictionary, read_tag_dictionary, read_taxonomies, tag_dictionary


def make_zip(path, **entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return str(path)


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def company_line(columns, **values):
    return ",".join('"' + values.get(c, "") + '"' for c in columns)


ALPHA = {
    "CompanyNumber": "00000001", "CompanyName": "ALPHA SOFTWARE LTD", "CompanyStatus": " Active ",
    "CompanyCategory": "Private Limited Company", "RegAddress.PostTown": "LONDON", "RegAddress.PostCode": "EC1A 1AA",
    "RegAddress.AddressLine1": "1 HIGH STREET", "RegAddress.Country": "ENGLAND",
    "SICCode.SicText_1": "62012 - Business software", "SICCode.SicText_2": "70229 - Consultancy",
    "IncorporationDate": "15/01/2018", "Accounts.AccountRefDay": "31", "Accounts.AccountRefMonth": "3",
    "Accounts.NextDueDate": "30/09/2025", "Accounts.LastMadeUpDate": "not-a-date",
    "Accounts.AccountCategory": "SMALL", "Mortgages.NumMortCharges": "2", "Mortgages.NumMortOutstanding": "1",
    "Mortgages.NumMortPartSatisfied": "0", "PreviousName_1.CompanyName": "ALPHA LTD",
    "PreviousName_2.CompanyName": "  ", "PreviousName_3.CompanyName": " OLD ALPHA LTD ",
}


def test_company_csv(spark, folder):
    columns = [*CSV_COLUMNS, "Unmapped"]
    header = ",".join(f" {c}" for c in columns)
    beta = {"CompanyNumber": "00000002", "CompanyName": "BETA, \"X\"\nLTD".replace('"', '""'), "SICCode.SicText_1": "None Supplied"}
    lines = [header, company_line(columns, **ALPHA), company_line(columns, **beta), '"00000003","GAMMA"',
             company_line(columns, CompanyNumber="00000004") + ",extra", company_line(columns, CompanyNumber="00000005", CompanyName="NA")]
    one = make_zip(os.path.join(folder, "BasicCompanyData-2025-01-01-part1_2.zip"), **{"a.csv": "\n".join(lines)})
    two = make_zip(os.path.join(folder, "BasicCompanyData-2025-01-01-part2_2.zip"),
                   **{"b.csv": "CompanyName,CompanyNumber\nBETA LATER,00000002\n"})
    bad = os.path.join(folder, "broken.zip")
    with open(bad, "wb") as f:
        f.write(b"not a zip")
    none = make_zip(os.path.join(folder, "empty.zip"), **{"readme.md": "x"})
    parsed = COMPANY.read(paths(spark, one, two, bad, none)).cache()
    rows = {r["company_number"]: r.asDict() for r in accepted(COMPANY, parsed, None).collect()}
    assert set(rows) == {"00000001", "00000002", "00000003", "00000005"}
    a = rows["00000001"]
    assert a["company_status"] == "active" and a["sic_codes"] == ["62012", "70229"]
    assert a["incorporation_date"] == dt.date(2018, 1, 15) and a["accounts_ref_date"] == "03-31"
    assert a["accounts_next_due_date"] == dt.date(2025, 9, 30) and a["accounts_last_made_up_date"] is None
    assert a["region"] is None and a["address_line_2"] is None and a["returns_next_due_date"] is None
    assert (a["num_mort_charges"], a["num_mort_outstanding"], a["num_mort_part_satisfied"]) == (2, 1, 0)
    assert a["previous_names"] == "ALPHA LTD|OLD ALPHA LTD"
    assert a["data_hash"] == "acf0cf96b84455170109f8b4c9c426aa"
    assert rows["00000002"]["company_name"] == "BETA LATER"  # the later part wins
    assert rows["00000003"]["company_name"] == "GAMMA" and rows["00000003"]["sic_codes"] == []
    assert rows["00000005"]["company_name"] == "NA"  # text, not a missing value
    first = [r for r in parsed.where("company_number = '00000002' and entry = 'a.csv'").collect()][0]
    assert first["company_name"] == 'BETA, "X"\nLTD' and first["sic_codes"] == ["None Supplied"]
    reasons = [(r["archive"].rsplit("/", 1)[1], r["entry"], r["reason"]) for r in rejects(parsed).collect()]
    assert len(reasons) == 3 and {r[0] for r in reasons} == {"broken.zip", "empty.zip", "BasicCompanyData-2025-01-01-part1_2.zip"}
    places = sorted(r["row_no"] for r in parsed.where("entry = 'a.csv'").collect())
    assert places == [0, 1, 2, 3, 4]


def csv_rows(spark, folder, body):
    z = make_zip(os.path.join(folder, "one.zip"), **{"a.csv": body})
    found = read_csv(paths(spark, z), {"A": "a", "B": "b"}).orderBy("row_no").collect()
    return [(r["row_no"], r["a"], r["b"], r["reject"] and r["reject"].split(":")[0]) for r in found]


def test_an_open_quote_costs_one_line(spark, folder):
    body = 'A,B\n1,one\n2,"two\n3,"three"\n4,four\n5,"fi\nve"\n6,six,more\n7\n' + "8,\xff\n".replace("\xff", "z") + '9,"x"" y"\n'
    got = csv_rows(spark, folder, body)
    assert got == [(0, "1", "one", None), (1, None, None, "line"), (2, "3", "three", None), (3, "4", "four", None), (4, "5", "fi\nve", None),
                   (5, None, None, "3 fields instead of 2"), (6, "7", None, None), (7, "8", "z", None), (8, "9", 'x" y', None)]


def test_an_open_quote_in_a_large_entry(spark, folder, monkeypatch):
    rows = [f"{k},name {k}" for k in range(60_000)]
    rows[1] = '1,"name 1'
    rows[59_999] = '59999,"end'
    got = csv_rows(spark, folder, "A,B\n" + "\n".join(rows))
    assert len(got) == 60_000 and [r[0] for r in got if r[3]] == [1, 59_999] and got[2] == (2, "2", "name 2", None)


def parsed_lines(lines, block=10**9):
    """Good records and rejects of CSV lines with three columns, read in blocks of so many lines."""
    reader, out, rest = archives._Records(["a", "b", "c"], {"a": "A", "b": "B", "c": "C"}), [], []
    for k in range(0, len(lines), block):
        found, rest = reader.blocks(rest + lines[k : k + block], False)
        out += found
    out += reader.blocks(rest, True)[0]
    good = [(n, tuple(c[x][i].as_py() for x in "ABC")) for numbers, bad, c in out if not bad for i, n in enumerate(numbers)]
    return sorted(good), sorted((n, x.split(":")[1].strip()) for numbers, bad, _ in out if bad for n, x in zip(numbers, bad))


def test_no_rows_out_of_an_open_quote():
    good, bad = parsed_lines([b"0,0,0", b'x,"y', *[b"free text"] * 2000, b"1,2,3", b"4"])
    assert [g[1] for g in good] == [("0", "0", "0"), ("1", "2", "3"), ("4", None, None)]
    assert len(bad) == 2001 and bad[0] == (1, "a quote stays open") and {b[1] for b in bad[1:]} == {"it follows an open quote"}


def test_blocks_do_not_change_what_is_read():
    lines = [b'1,"a', b'b","c', b'd"', b"2,,", b"4", b'x,"open', b"5", b'6,"m', b'n",7', b"8", b"9,8,7,6", b'9,"q""r",s', b"\xff,1,2", b'"x" y,z,w']
    whole = parsed_lines(lines)
    assert whole[0][:4] == [(0, ("1", "a\nb", "c\nd")), (1, ("2", None, None)), (2, ("4", None, None)), (5, ("6", "m\nn", "7"))]
    for block in (1, 2, 3, 5):
        assert parsed_lines(lines, block) == whole


@pytest.mark.parametrize("lines", [[b'x,"y'], [b'x,"y', b"1,2,3"], [b'x,"y', b"loose", b'"'], [b"1,2,3", b'a "b" c,"d']])
def test_many_damaged_lines_cost_little(lines):
    began = time.process_time()
    good, bad = parsed_lines(lines * (100_000 // len(lines)), 20_000)
    assert len(good) + len(bad) >= 50_000 and time.process_time() - began < 20
    good, bad = parsed_lines([b'x,"y', *[b"no quote here"] * 100_000], 1000)
    assert (len(good), len(bad)) == (0, 100_001)


def test_a_quoted_value_over_very_many_lines(spark, folder):
    for n in (21, 400_000):  # the second runs over several blocks
        value = "\n".join(f"line {k} of a note" for k in range(n))
        got = csv_rows(spark, folder, f'A,B\n1,one\n2,"{value}"\n3,three\n4,"open\nnote\n')
        assert got[:3] == [(0, "1", "one", None), (1, "2", value, None), (2, "3", "three", None)]
        assert got[3] == (3, None, None, "line")


def test_a_record_longer_than_any_block(spark, folder):
    long = "x" * (archives.BLOCK_BYTES * 3)
    got = csv_rows(spark, folder, f'A,B\n1,one\n2,"{long}, y"\n3,three\n')
    assert [(r[1], len(r[2]), r[3]) for r in got] == [("1", 3, None), ("2", len(long) + 3, None), ("3", 5, None)]


def test_bytes_that_are_no_text(spark, folder):
    z = make_zip(os.path.join(folder, "b.zip"), **{"a.csv": b"A,B\n1,one\n2,\xff\xfe\n3,three\n"})
    found = read_csv(paths(spark, z), {"A": "a", "B": "b"}).orderBy("row_no").collect()
    assert [(r["a"], r["reject"] is None) for r in found] == [("1", True), (None, False), ("3", True)]
    z = make_zip(os.path.join(folder, "l.zip"), **{"a.json": b"{}\n\xff\n[]"})
    found = read_lines(paths(spark, z)).orderBy("line_no").collect()
    assert [(r["line"], r["reject"] is None) for r in found] == [("{}", True), (None, False), ("[]", True)]


def test_the_rows_of_one_archive_are_shared(spark, folder):
    z = make_zip(os.path.join(folder, "one.zip"), **{"a.csv": "A,B\n" + "".join(f"{k},x\n" for k in range(4000)), "a.json": "{}\n" * 4000})
    for df in (read_csv(paths(spark, z), {"A": "a", "B": "b"}), read_lines(paths(spark, z), (".json",))):
        tasks = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 8 and max(r["count"] for r in tasks) < 800


def test_damaged_entries_cost_themselves(spark, folder):
    path = make_zip(os.path.join(folder, "d.zip"), **{f"Prod_1_{k:08d}_20180331.html": INLINE for k in range(4)})
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(4):
            z.writestr(f"Prod_1_{k:08d}_20180331.html", INLINE)
    data = bytearray(open(path, "rb").read())
    at = data.index(b"1,234", data.index(b"Prod_1_00000002"))
    data[at] = ord("9")  # another digit in a stored entry: only the checksum tells
    open(path, "wb").write(data)
    odd = {"odd.xml": "<?xml version='1.0' encoding='foo'?><a/>", "wide.xml": XBRL.replace("?>", " encoding='utf-16'?>", 1)}
    second = make_zip(os.path.join(folder, "e.zip"), **odd)
    parsed = ACCOUNTS.read(paths(spark, path, second)).collect()
    assert sorted(r["company_number"] for r in parsed if r["reject"] is None) == ["00000000", "00000001", "00000003"]
    assert sorted(r["entry"] for r in parsed if r["reject"]) == ["Prod_1_00000002_20180331.html", "odd.xml", "wide.xml"]


def test_a_dictionary_of_one_s_own(spark, folder):
    with open(os.path.join(folder, "own.json"), "w") as f:
        f.write('{"turnover": ["Creditors"], "debtors": ["Turnover_Revenue"]}')
    own = load_tag_dictionary(spark, os.path.join(folder, "own.json"))
    r = parse_documents(documents(spark, ("Prod223_2125_09652609_20180331.html", INLINE)), dictionary=own).first()
    assert (r["turnover"], r["debtors"], r["creditors"], r["n_facts"]) == (Decimal("500.00"), Decimal("1234.00"), None, 2)
    facts = [(1, 1, "uk:Creditors", "creditors", "5", Decimal(5)), (1, 2, "uk:TurnoverRevenue", "turnoverrevenue", "7", Decimal(7))]
    df = spark.createDataFrame(facts, "id int, n int, tag string, local string, raw string, value decimal(38,6)")
    got = resolve_tags(df, ["id"], read_tag_dictionary(spark, os.path.join(folder, "own.json"))).collect()
    assert {(x["column"], x["raw"]) for x in got} == {("turnover", "5"), ("debtors", "7")}


def test_facts_are_not_dealt_by_their_tags(spark, capsys):
    facts = spark.range(10).selectExpr("id", "id as n", "concat('uk:Creditors', id) as tag", "concat('creditors', id) as local", "'5' as raw", "cast(5 as decimal(38,6)) as value")
    resolve_tags(facts, ["id"], tag_dictionary(spark)).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning(local" not in plan


def test_no_shuffle_before_the_rows_are_made_unique(spark, capsys):
    parse_documents(documents(spark, ("Prod223_2125_09652609_20180331.html", INLINE))).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_latest_file_wins(spark, folder):
    names = ["BasicCompanyData-2025-01-01-part2_10.zip", "BasicCompanyData-2025-01-01-part10_10.zip",
             "a/BasicCompanyData-2024-12-01-part1_1.zip"]
    os.makedirs(os.path.join(folder, "a"))
    files = [make_zip(os.path.join(folder, n), **{"c.csv": f"CompanyNumber,CompanyName\n00000001,{n}\n"}) for n in names]
    rows = accepted(COMPANY, COMPANY.read(paths(spark, *files)), None).collect()
    assert [r["company_name"] for r in rows] == [names[1]]


PSC_LINES = [
    '{"company_number":"00000001","data":{"name_elements":{"title":"Ms","forename":"Ann","surname":"Example"},"address":{"address_line_1":"1 High Street","locality":"London","postal_code":"EC1A 1AA","country":"England"},"date_of_birth":{"year":1980,"month":5},"kind":"individual-person-with-significant-control","nationality":"British","notified_on":"2018-01-15","natures_of_control":["ownership-of-shares-25-to-50-percent",null,"voting-rights-25-to-50-percent"]}}',
    '{"data":{"name":"No Company"}}',
    '{"company_number":"00000002","data":{"name":"Beta Holdings"}}',
    '{"company_number":"00000003","data":{"name":"X","date_of_birth":{"year":1970,"month":1,"day":null}}}',
    "not json",
    '{"company_number":"99999999","data":{"name":"Orphan"}}',
    '{"company_number":"00000002","data":{"name":"Odd","date_of_birth":{"year":"x","month":1}}}',
]


def test_psc(spark, folder):
    z = make_zip(os.path.join(folder, "psc-snapshot-2025-01-03_1of1.zip"), **{"snapshot.txt": "\n".join(PSC_LINES)})
    parsed = PSC.read(paths(spark, z)).cache()
    companies = spark.createDataFrame([("00000001",), ("00000002",), ("00000003",)], "company_number string")
    rows = {r["officer_name"]: r for r in accepted(PSC, parsed, companies).collect()}
    assert set(rows) == {"Ms Ann Example", "Beta Holdings", "X", "Odd"}
    ann = rows["Ms Ann Example"]
    assert ann["date_of_birth"] == dt.date(1980, 5, 1) and ann["appointed_on"] == dt.date(2018, 1, 15)
    assert ann["resigned_on"] is None
    assert ann["nature_of_control"] == "ownership-of-shares-25-to-50-percent|voting-rights-25-to-50-percent"
    assert ann["data_hash"] == "17580fa17ffdadd0ce01c132c4a95e97" and ann["raw_data"] == PSC_LINES[0]
    assert rows["Beta Holdings"]["officer_role"] == "person-with-significant-control"
    assert rows["X"]["date_of_birth"] == dt.date(1970, 1, 1) and rows["Odd"]["date_of_birth"] is None
    bad = {r["place"]: r["reason"] for r in rejects(parsed).collect()}
    assert set(bad) == {1, 4} and bad[1].startswith("no company number") and bad[4].startswith("unreadable")


def test_psc_first_entry_when_no_json(spark, folder):
    z = make_zip(os.path.join(folder, "x.zip"), **{"data.bin": PSC_LINES[2]})
    assert [r["officer_name"] for r in PSC.read(paths(spark, z)).collect()] == ["Beta Holdings"]


INLINE = """<html><xbrli:context id="c1"><xbrli:entity><xbrli:identifier>09652609</xbrli:identifier></xbrli:entity>
 <xbrli:period><xbrli:startDate>2017-04-01</xbrli:startDate><xbrli:endDate>2018-03-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c0"><xbrli:period><xbrli:instant>2017-03-31</xbrli:instant></xbrli:period></xbrli:context>
<ix:nonFraction name="uk:TurnoverRevenue" contextRef="c1" sign="-" scale="3">1,234</ix:nonFraction>
<ix:nonFraction contextRef="c1" name="uk:Creditors"><b>50</b>0</ix:nonFraction>
<ix:nonFraction name="uk:TurnoverRevenue" contextRef="c0">999</ix:nonFraction>
<ix:nonFraction name="uk:Debtors" contextRef="c1">-</ix:nonFraction>
<ix:nonFraction name="uk:FixedAssets" contextRef="c1"/>
<ix:nonFraction name="uk:CurrentAssets" contextRef="c1">12 000</ix:nonFraction>
<ix:nonFraction name="uk:AverageNumberEmployeesDuringPeriod" contextRef="c1">431.0</ix:nonFraction>
<ix:nonNumeric name="uk:StartDateForPeriodCoveredByReport" contextRef="c1">1 April 2017</ix:nonNumeric>
<ix:nonNumeric name="uk:versionProductionSoftware" contextRef="c1">2.0</ix:nonNumeric></html>"""

XBRL = """<?xml version="1.0"?><xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:uk="http://example.org/uk">
<context id="c1"><entity><identifier scheme="x">01234567</identifier></entity><period><startDate>2017-04-01</startDate><endDate>2018-03-31</endDate></period></context>
<context id="c2"><entity><identifier scheme="x">01234567</identifier></entity><period><startDate>2016-04-01</startDate><endDate>2017-03-31</endDate></period></context>
<uk:TurnoverGrossOperatingRevenue contextRef="c1">5</uk:TurnoverGrossOperatingRevenue>
<uk:TurnoverRevenue contextRef="c1">100</uk:TurnoverRevenue>
<uk:TurnoverRevenue contextRef="c1">200</uk:TurnoverRevenue>
<uk:ProfitLoss contextRef="c2">-7.5</uk:ProfitLoss>
<uk:versionProductionSoftware contextRef="c1">2.0</uk:versionProductionSoftware>
<uk:NoContext>9</uk:NoContext></xbrl>"""


def documents(spark, *entries):
    rows = [("z.zip", name, i, 0, name.rsplit(".", 1)[1], body.encode(), None) for i, (name, body) in enumerate(entries)]
    return spark.createDataFrame(rows, "archive string, entry string, pos long, inner_pos long, extension string, body binary, reject string")


def test_inline_filing(spark):
    row = parse_documents(documents(spark, ("Prod223_2125_09652609_20180331.html", INLINE))).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["company_number"], r["period_end"], r["period_start"]) == ("09652609", dt.date(2018, 3, 31), dt.date(2017, 4, 1))
    assert r["turnover"] == Decimal("1234.00") and r["creditors"] == Decimal("500.00") and r["debtors"] is None
    assert r["current_assets"] == Decimal("12000.00") and r["fixed_assets"] is None
    assert r["average_number_employees_during_period"] == 431 and r["production_software_version"] == "2.0"
    assert r["source"] == "bulk_xbrl" and r["reject"] is None
    scaled = parse_documents(documents(spark, ("Prod223_2125_09652609_20180331.html", INLINE)), apply_sign_scale=True)
    assert scaled.first()["turnover"] == Decimal("-1234000.00")


def test_inline_periods_from_contexts(spark):
    rows = parse_documents(documents(spark, ("Prod223_2125_09652609_20181399.html", INLINE))).collect()
    got = {r["period_end"]: r["turnover"] for r in rows}
    assert got == {dt.date(2018, 3, 31): Decimal("1234.00"), dt.date(2017, 3, 31): Decimal("999.00")}


def test_xbrl_filing(spark):
    rows = parse_documents(documents(spark, ("filing.xml", XBRL), ("broken.xml", "<a>"), ("none.html", "<p>x</p>"),
                                     ("Prod_1_00000009_20180331.htm", "<p>no facts</p>"))).collect()
    good = {(r["company_number"], r["period_end"]): r for r in rows if r["reject"] is None}
    assert set(good) == {("01234567", dt.date(2018, 3, 31)), ("01234567", dt.date(2017, 3, 31)), ("00000009", dt.date(2018, 3, 31))}
    this = good["01234567", dt.date(2018, 3, 31)]
    assert this["turnover"] == Decimal("200.00")  # better tag wins, then the last value
    assert this["period_start"] == dt.date(2017, 4, 1) and this["production_software_version"] == "2.0"
    assert good["01234567", dt.date(2017, 3, 31)]["profit_loss"] == Decimal("-7.50")
    empty = good["00000009", dt.date(2018, 3, 31)]
    assert empty["n_facts"] == 0 and empty["turnover"] is None
    bad = {r["entry"]: r["reject"] for r in rows if r["reject"] is not None}
    assert set(bad) == {"broken.xml", "none.html"} and bad["none.html"] == "no company number"


def test_accounts_archive(spark, folder):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("Prod_1_00000007_20180331.xml", XBRL)
    z = make_zip(os.path.join(folder, "Accounts_Bulk_Data-2025-01-20.zip"), **{
        "dir/": "", "Prod223_2125_09652609_20180331.html": INLINE, "nested.zip": inner.getvalue(), "bad.zip": b"junk",
        "notes.txt": "x"})
    parsed = ACCOUNTS.read(paths(spark, z)).cache()
    assert {r["company_number"] for r in parsed.where("reject is null").collect()} == {"09652609", "00000007"}
    assert [r["entry"] for r in rejects(parsed).collect()] == ["bad.zip"]
    companies = spark.createDataFrame([("09652609",)], "company_number string")
    assert [r["company_number"] for r in accepted(ACCOUNTS, parsed, companies).collect()] == ["09652609"]


def test_every_entry_of_a_large_archive(spark, folder):
    z = make_zip(os.path.join(folder, "many.zip"), **{f"Prod_1_{i:08d}_20180331.html": INLINE for i in range(400)})
    parsed = ACCOUNTS.read(paths(spark, z))
    assert parsed.where("turnover = 1234").select("company_number").distinct().count() == 400


def test_tag_sources(spark, folder):
    rows = tag_dictionary(spark).collect()
    assert len({r["column"] for r in rows}) == 52 and len(rows) == 56
    with open(os.path.join(folder, "d.json"), "w") as f:
        f.write('{"turnover": ["A", "b-c"], "debtors": ["D"]}')
    got = sorted(tuple(r) for r in read_tag_dictionary(spark, os.path.join(folder, "d.json")).collect())
    assert got == [("debtors", "d", 0, True), ("turnover", "a", 0, True), ("turnover", "b-c", 1, True), ("turnover", "bc", 1, True)]
    with open(os.path.join(folder, "tax.csv"), "w") as f:
        f.write(",Element Count,Element Name,Of Which are Numerical,source\n86,4.0,fixedassets,4.0,all\n")
    assert tuple(read_taxonomies(spark, os.path.join(folder, "tax.csv")).first()) == ("tax", "fixedassets", 4.0, 4.0)


def test_blank_lines_are_no_rejects(spark):
    lines = spark.createDataFrame([("  ",), (PSC_LINES[2],)], "line string")
    assert [r["reject"] for r in parse_lines(lines).collect()] == [None]


if __name__ == "__main__":
    pytest.main([__file__])


def test_wide_rows_run_compiled(spark):
    """A session built by others gets the limit that HotSpot has, unless it has one of its own."""
    from firmlake.session import tune

    key = "spark.sql.codegen.hugeMethodLimit"
    own = spark.newSession()
    own.conf.unset(key)
    tune(own)
    assert own.conf.get(key) == "8000"
    own.conf.set(key, "7000")
    tune(own)
    assert own.conf.get(key) == "7000"


def test_openings_are_read_once():
    """Openings that filings repeat come from the cache, with the order of their attributes and their factor."""
    from firmlake.sources import accounts

    accounts._heading.cache_clear()
    body = b"<xbrli:context id='n'><endDate>2020-12-31</endDate></xbrli:context><ix:nonFraction contextRef='n' name='uk:Creditors' sign='-'>1,0</ix:nonFraction><ix:nonFraction name='uk:Creditors' contextRef='n'>7</ix:nonFraction>"
    for signs, raw, factor in ((False, "1,0", 1.0), (True, "1,0", -1.0)):
        e = {"archive": "a", "entry": "Prod1_1_00000001_20201231.html", "pos": 0, "inner_pos": 0, "extension": "html", "reject": None}
        rows = [r for b in accounts.period_converter(signs)((e, body) for _ in range(50)) for r in b.to_pylist()]
        assert len(rows) == 50 and all(dict(r["found"])["creditors"] == {"raw": raw, "factor": factor} for r in rows)
    assert accounts._heading.cache_info().misses == 2
    rejected = [r for b in accounts.period_converter()([({**e, "reject": "bad"}, None)]) for r in b.to_pylist()]
    assert rejected[0]["found"] is None and rejected[0]["reject"] == "bad"


def test_elements_without_a_closing_cost_one_look():
    """Each of them was looked for to the end of the document: their cost grew with the square of the document."""
    import time

    from firmlake.sources import accounts

    head = b"<xbrli:context id='n'><endDate>2020-12-31</endDate></xbrli:context><ix:nonNumeric name='uk:ReportTitle' contextRef='n'>a <IX:nonFraction name='uk:Creditors' contextRef='n'>1 0,0</ix:nonFraction> b</ix:nonNumeric>"
    body = head + b"<ix:nonFraction name='uk:Debtors' contextRef='n'>" * 10_000 + "İ".encode()
    e = {"archive": "a", "entry": "Prod1_1_00000001_20201231.html", "pos": 0, "inner_pos": 0, "extension": "html", "reject": None}
    began = time.perf_counter()
    rows = [r for b in accounts.period_converter()([(e, body)]) for r in b.to_pylist()]
    assert time.perf_counter() - began < 5
    assert len(rows) == 1 and {c: f["raw"] for c, f in rows[0]["found"]} == {"creditors": "1 0,0", "report_title": "a 1 0,0 b"}


def test_a_small_table_gives_many_archives(spark, folder):
    """Rows that come in one partition are dealt first: an archive's entry is written and read by one task."""
    from checks.loads import csv_archives

    raw = spark.createDataFrame([(f"{k:08d}", f"NAME {k}") for k in range(400)], "` CompanyNumber` string, ` CompanyName` string").coalesce(1)
    paths = csv_archives(raw, f"{folder}/many", F.array(F.lit('1,"open'))).collect()
    sizes = []
    for p in paths:
        rows = read_csv(spark.createDataFrame([tuple(p)], "path string"), {"CompanyNumber": "company_number"})
        sizes.append(rows.where("reject is null").count())
    assert len(paths) == 8 and sum(sizes) == 400 and max(sizes) < 100
