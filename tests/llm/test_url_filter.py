import datetime as dt
import random

from firmlake.llm.url_filter import evaluate

CAPTURES, ENTRIES = "page_id long, url string, fetched_at timestamp", "scope string, value string, listed boolean, at timestamp"


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def keys(url):
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].lower()
    labels = host.split(".")
    return {f"url:{url.split('#')[0]}", f"host:{host}", *(f"domain:{'.'.join(labels[k:])}" for k in range(len(labels) - 1))}


def test_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.example.com", "b.example.com", "x.y.example.org", "hot.example.net"]
    url = lambda: f"http://{rng.choice(hosts + ['hot.example.net'] * 4)}/p{rng.randint(0, 5)}"
    captures = [(i, url() + rng.choice(["", "#top"]), day(rng.randint(-100, 500), rng.randint(0, 3))) for i in range(600)]
    entries = []
    for _ in range(150):
        u = url()
        scope, value = rng.choice([("url", u), ("host", u.split("/")[2].upper()), ("domain", ".".join(u.split("/")[2].split(".")[-2:]))])
        entries.append((scope, value, rng.random() < 0.5, day(rng.randint(-150, 520), rng.randint(0, 2))))
    state = {}
    for scope, value, listed, at in entries:
        key = f"{scope}:{value if scope == 'url' else value.lower()}"
        state.setdefault(key, {})[at] = state.get(key, {}).get(at, False) or listed
    got = {r.page_id: r for r in evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()}
    for i, u, t in captures:
        want = sorted(k for k in keys(u) if (past := [a for a in state.get(k, {}) if a <= t]) and state[k][max(past)])
        assert got[i].reasons == " ".join(want) and got[i].n_reasons == len(want) and got[i].blocked == bool(want), (u, t)


def test_odd_rows(spark):
    captures = [(None, "http://h.example/", day(1)), (1, None, day(1)), (2, "", day(1)), (3, "http://h.example/", None), (4, "no url", day(1)),
                (5, "http://h.example/", day(1)), (5, "http://h.example/", day(1)), (6, "http://h.example/" + "x" * 100_000, day(1))]
    entries = [("host", "h.example", True, day(0)), (None, "h.example", True, day(0)), ("host", None, True, day(0)), ("host", "h.example", None, day(0)),
               ("host", "h.example", False, None), ("other", "h.example", False, day(0)), ("host", "h.example", False, day(0))]
    df = spark.createDataFrame([(*c, "k", 3) for c in captures], CAPTURES + ", key string, month int")
    listed = spark.createDataFrame(entries, ENTRIES)
    got = evaluate(df, listed).collect()
    assert len(got) == len(captures)
    assert sorted(str(r.page_id) for r in got if r.blocked) == ["5", "5", "6", "None"]
    assert not any(r.blocked for r in evaluate(df, listed.limit(0)).collect())
    assert evaluate(df.limit(0), listed).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, "http://h.example/", day(1))], CAPTURES)
    entries = spark.createDataFrame([("host", "h.example", True, day(0))], ENTRIES)
    evaluate(df, entries).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))
