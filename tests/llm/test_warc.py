import hashlib

from firmlake.llm import warc

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def write(spark, folder, rows, extra=""):
    df = spark.createDataFrame(rows, SCHEMA + extra)
    warc.write_archives(df, f"{folder}/archives")
    found = warc.captures(spark, f"{folder}/archives")
    warc.write_index(found, f"{folder}/index")
    return df, found


def test_round_trip(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 7)
    monkeypatch.setattr(warc, "LINES", 5)
    copy = "copy \r\n\r\nWARC/1.0\r\n\r\n é" * 10
    rows = [(k, f"http://www.h{k % 4}.example.com/p{k}?q=1", f"page {k}" if k % 3 else copy) for k in range(60)]
    df, found = write(spark, folder, rows)
    back = {r.page_id: r for r in warc.read_index(spark, f"{folder}/index").collect()}
    for k, u, h in rows:
        r = back[k]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(h.encode()), digest(h), u)
        assert (r.record_type, r.refers_to) == (("revisit", 0) if h == copy and k else ("response", None))
    asked = spark.createDataFrame([(rows[5][1],), (rows[6][1],), (rows[5][1].replace("http", "https"),), ("http://none.example/",), (None,)], "url string")
    hits = warc.look_up(spark, f"{folder}/index", asked)
    assert sorted(r.page_id for r in hits.collect()) == [5, 6]
    got = {r.page_id: r.payload for r in warc.fetch(spark, f"{folder}/archives", found).collect()}
    assert all(got[k] == ("" if h == copy and k else h) for k, _, h in rows)


def test_revisits_are_read_where_they_refer_to(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 4)
    monkeypatch.setattr(warc, "BATCH_BYTES", 500)
    copies = ["copy \r\n\r\nWARC/1.0\r\n\r\n é" * 10, "other ß " * 30]
    rows = [(k, None if k == 0 else f"http://h{k % 4}.example.com/p {k // 2}", f"page {k}" if k % 3 == 2 else copies[k % 3]) for k in range(60)]
    _, found = write(spark, folder, rows + [(0, "http://z.example/", "another page of this id " * 9)])
    asked = spark.createDataFrame([("http://h3.example.com/p%201",), ("http://h0.example.com/p%203",)], "url string")
    hits = warc.look_up(spark, f"{folder}/index", asked)
    got = {r.page_id: r.payload for r in warc.payloads(spark, f"{folder}/index", hits).collect()}
    assert got and all(got[k] == rows[k][2] for k in got)
    every = warc.payloads(spark, f"{folder}/index", found).collect()
    assert sorted((r.page_id, r.payload) for r in every) == sorted([(k, h) for k, _, h in rows] + [(0, "another page of this id " * 9)])


def test_archives_are_not_held_whole(spark, folder):
    write(spark, folder, [(1, "http://a.example/", "x")])
    assert warc.archives(spark, f"{folder}/archives").columns == ["path"]


def test_a_key_over_many_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    write(spark, folder, [(k, "http://one.example/", str(k)) for k in range(50)] + [(99, "http://two.example/", "x")])
    asked = spark.createDataFrame([("http://one.example/",)], "url string")
    assert sorted(r.page_id for r in warc.look_up(spark, f"{folder}/index", asked).collect()) == list(range(50))


def test_odd_rows(spark, folder):
    long = "ä" * 200_000
    rows = [(None, None, None, 1), (1, "", "", 1), (2, "a b\r\nX: y", "x" * 99, 1), (3, None, "x" * 99, 1), (4, "u", "y" * 100, 1), (5, "u", "y" * 100, 1),
            (5, "u", "y" * 100, 1), (4, "u", "y" * 100, 1), (None, "u", "y" * 100, 1), (6, "v", long, 1)]
    df, _ = write(spark, folder, rows, ", payload int")
    back = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_index(spark, f"{folder}/index").collect()]
    want = [(i, len((h or "").encode()), digest(h), *(("revisit", 4) if h == "y" * 100 and i != 4 else ("response", None))) for i, _, h, _ in rows]
    assert sorted(map(str, back)) == sorted(map(str, want))


def test_empty_table(spark, folder):
    write(spark, folder, [])
    assert warc.read_index(spark, f"{folder}/index").collect() == []


def test_surt():
    assert warc.surt("HTTPS://user@www.Sub.Example.com:8080/Path?q#f") == "com,example,sub)/Path?q"
    assert warc.surt("http://a.b") == "b,a)/" and warc.surt(None) == "" and warc.surt("odd") == "odd"
