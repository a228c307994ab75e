from firmlake.llm.html_template import blocks, extract, main_text, parse

SCHEMA = "page_id long, url string, html string"


def page(k, body, box="article", extra=""):
    return (f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
            f"<nav><ul><li><a href=/a>Menu {k}</a><li>More</ul></nav><!-- x > y --><div class='ad'>Buy {k} now</div>"
            f"<{box}><h1>Head {k}</h1>{body}</{box.split()[0]}>{extra}<footer>&copy; host</footer></body></html>")  # fmt: skip


def run(spark, rows):
    return {r.page_id: (r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_article(spark):
    rows = [(k, f"http://H.example/{k}", page(k, f"<p>First <b>part</b>\n of {k}.<br>Tom{k} &amp; co<p>Second{k}, &quot;x&quot;</p>")) for k in range(12)]
    got = run(spark, rows)
    assert got[3] == ('Head 3 First part of 3. Tom3 & co Second3, "x"', len('Head 3 First part of 3. Tom3 & co Second3, "x"'))


def test_main_element_is_deduced_without_its_name(spark):
    body = "<p>" + " ".join(f"word{i}" for i in range(40)) + "</p><div class='comments'><p>I disagree strongly</p></div><p>Share this page</p>"
    side = "<div class=x9>Latest: other stories of the day</div>"
    rows = [(k, "https://user@a.example:80/x", page(k, body.replace("word7", f"only{k}"), "div id=q17", side)) for k in range(20)]
    text = run(spark, rows)[4][0]
    assert "only4" in text and "disagree" not in text and "Latest" not in text and "Menu" not in text
    assert text.startswith("Head 4 word0") and "Share this page" not in text  # the same on every page: part of the template


def test_copies_are_no_template(spark):
    copy = page(0, "<p>One article under many addresses</p>")
    rows = [(k, f"http://c.example/{k}", copy) for k in range(80)] + [(80 + k, f"http://c.example/{80 + k}", page(k + 1, f"<p>own {k}</p>")) for k in range(10)]
    got = run(spark, rows + rows[:3])
    assert all(got[k][0] == "Head 0 One article under many addresses" for k in range(80))
    assert got[83][0] == "Head 4 own 3"


def test_a_menu_text_stays_in_the_article(spark):
    rows = [(k, f"http://m.example/{k}", page(k, f"<h2>More</h2><p>text {k}</p><p>&copy; host</p>" if k == 3 else f"<p>text {k}</p>")) for k in range(12)]
    assert run(spark, rows)[3][0] == "Head 3 More text 3 © host"


def test_headline_and_lead_outside_the_body_stay(spark):
    rows = [(k, f"http://l.example/{k}", page(k, f"<div class=lead>Lead {k}</div><div class=body><p>{f'word{k} ' * 40}</p></div>")) for k in range(12)]
    assert run(spark, rows)[3][0] == "Head 3 Lead 3 " + " ".join(["word3"] * 40)


def test_names_mark_small_parts_only(spark):
    words = " ".join(f"w{i}" for i in range(30))
    inner = f"<form id=aspnet><div class='post no-comments'><h1>Head</h1><p>{words}</p><div class='comments'>I disagree</div></div></form>"
    assert main_text(f"<body class='has-sidebar'>{inner}<div class='sidebar'>side</div></body>", None, frozenset()) == f"Head {words}"
    assert main_text(f"<div class='page-widget !mt-0'><p>{words}</p></div>", None, frozenset()) == words
    assert main_text(f"<article><header class=entry-header><h1>Head</h1></header><p>{words}</p></article>", None, frozenset()) == f"Head {words}"
    assert main_text("<div class=ad>a long text to buy it</div><article>short</article>", None, frozenset()) == "short"
    rows = [(k, f"http://n.example/{k}", f"<body class=has-sidebar><div class='post widget'><p>own{k} {words}</p></div><div class=ad>a{k}</div></body>") for k in range(12)]
    assert run(spark, rows)[3][0] == f"own3 {words}"


def test_a_name_counts_as_a_whole():
    words = " ".join(f"w{i}" for i in range(30))
    for name in ("share-of-market", "comments-on-policy", "adhesive", "related-rates-theorem", "no-comments"):
        assert main_text(f"<article><p>{words}</p><section id='{name}'><p>a part of it</p></section></article>", None, frozenset()) == f"{words} a part of it"
    for name in ("comments", "comments-list", "reader-comments", "ad", "adContainer", "social share", "cookie-banner", "notice"):
        assert main_text(f"<article><p>{words}</p><div class='{name}'><p>beside it</p></div></article>", None, frozenset()) == words
    assert main_text(f"<article><p>{words}</p><figure><img src=x><figcaption>What it shows</figcaption></figure></article>", None, frozenset()) == f"{words} What it shows"


def test_a_list_of_links_is_a_menu_where_there_is_no_template():
    menu = "<div><a href=/a>Home</a> <p><a href=/b>News</a><p><a href=/c>About us</a></div>"
    assert main_text(f"<body>{menu}<div><p>The text with <a href=x>a link</a></p></div></body>", None, frozenset()) == "The text with a link"
    flat = "<div><a href=/a>Home</a> | <a href=/b>News</a> | <a href=/c>About us</a></div>"
    assert main_text(f"<body>{flat}<p>The text</p></body>", None, frozenset()) == "The text"
    assert main_text(f"<body>{menu}</body>", None, frozenset()) == "Home News About us"  # nothing else is there
    roundup = "<article><p><a href=1>one</a><p><a href=2>two</a><p><a href=3>three</a></article><p>x</p>"
    assert main_text(roundup, None, frozenset()) == "one two three x"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://b.example/", "plain   words &lt;b"), (4, "http://b.example/", "<p>open <div><p>a<b>c"),
            (5, "x", "<script>never closed <p>text"), (6, "x", "text <!-- open comment"), (7, "x", "end <a href='x"), (None, "x", "nn"),
            (8, "x", "<article>" + "long " * 60_000 + "</article>"), (8, "x", "<article>" + "long " * 60_000 + "</article>")]
    df = spark.createDataFrame([(*r, "y", 1) for r in rows], SCHEMA + ", text string, n_chars int")
    got = [tuple(r) for r in extract(df).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[2] for r in got}
    assert by[1] == by[2] == by[5] == "" and by[3] == "plain words <b" and by[4] == "open ac" and by[6] == "text" and by[7] == "end"
    assert by[None] == "nn" and all(r[3] == len(r[2]) for r in got) and len(by[8]) == 60_000 * 5 - 1
    assert extract(df.limit(0)).collect() == []


def test_parse():
    assert blocks(parse("<p>a<i>b</i> c</p>d &am e&ampf")) == [("", "ab c"), ("", "d &am e&f")]
    assert main_text("<body><header>h</header><main><p>m m m</main></body>", None, frozenset()) == "m m m"
