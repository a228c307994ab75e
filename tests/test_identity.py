import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from firmlake.operators.identity import Weights, connected, groups, learn, officer_block, pattern_counts

FIELDS = ["nation", "town", "post"]
SCHEMA = "id long, name string, born string, nation string, town string, post string"


def block():
    return [F.col("name"), F.col("born")]


def people(n, seed=1, hot=0):
    rng = random.Random(seed)
    pick = lambda values: rng.choice([*values, None])
    rows = [(k, pick("ABC"), pick(["80", "81"]), pick("xy"), pick("pqr"), pick("12345")) for k in range(n)]
    return rows + [(n + k, "Z", "99", "x", f"t{k}", "1") for k in range(hot)]


def brute_pairs(rows):
    for a, b in combinations(rows, 2):
        if a[1] is not None and a[2] is not None and a[1:3] == b[1:3]:
            yield a, b, frozenset(f for f, x, y in zip(FIELDS, a[3:], b[3:]) if x is not None and x == y)


def brute_groups(rows, weights, threshold):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, own in brute_pairs(rows):
        if sum(weights.agree[f] if f in own else weights.differ[f] for f in FIELDS) >= threshold:
            x, y = find(a[0]), find(b[0])
            root[max(x, y)] = min(x, y)
    return {r[0]: find(r[0]) for r in rows}


def test_patterns_against_all_pairs(spark):
    rows = people(150)
    got = pattern_counts(spark.createDataFrame(rows, SCHEMA), block(), FIELDS)
    want = Counter(own for _, _, own in brute_pairs(rows))
    assert {k: v for k, v in got.items() if v} == dict(want) and len(got) == 8


@pytest.mark.parametrize("threshold", [-10.0, 0.0, 2.0, 4.0, 99.0])
def test_groups_against_all_pairs(spark, threshold):
    rows = people(150, 2, hot=60)
    weights = Weights({"nation": 1.0, "town": 2.0, "post": 3.0}, {"nation": -0.5, "town": -1.0, "post": -1.0})
    got = groups(spark.createDataFrame(rows, SCHEMA), "id", block(), FIELDS, weights, threshold).collect()
    assert {r["key"]: r["group_id"] for r in got} == brute_groups(rows, weights, threshold) and len(got) == len(rows)


def test_smallest_sets():
    weights = Weights({"a": 3.0, "b": 2.0, "c": 2.0}, {"a": -1.0, "b": -1.0, "c": -1.0})
    assert set(weights.enough(1.0)) == {frozenset("a"), frozenset("bc")}
    assert weights.enough(-3.0) == [frozenset()] and weights.enough(50.0) == []


def test_weights_are_learned(spark):
    """Twins of one person agree in town and post far more often than strangers of one name do; nation says little."""
    rng = random.Random(4)
    rows, truth = [], {}
    for person in range(400):
        home = (rng.choice("xy"), f"town{rng.randrange(30)}", f"p{rng.randrange(200)}")
        for _ in range(rng.choice((1, 2, 3))):
            own = [v if rng.random() < 0.92 else f"other{rng.randrange(50)}" for v in home]
            truth[len(rows)] = person
            rows.append((len(rows), f"N{person % 40}", "80", rng.choice("xy"), own[1], own[2]))
    df = spark.createDataFrame(rows, SCHEMA)
    weights = learn(df, block(), FIELDS)
    assert weights.agree["post"] > weights.agree["town"] > 1 > weights.agree["nation"] and weights.differ["post"] < 0
    got = {r["key"]: r["group_id"] for r in groups(df, "id", block(), FIELDS, weights, 3.0).collect()}
    together = [(a, b) for a, b in combinations(range(len(rows)), 2) if truth[a] == truth[b]]
    linked = [(a, b) for a, b in combinations(range(len(rows)), 2) if got[a] == got[b]]
    right = len(set(together) & set(linked))
    assert right / len(together) > 0.8 and right / len(linked) > 0.8


def test_chains_and_odd_rows(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected(chain).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}
    df = spark.createDataFrame([(1, None, "80", "x", "y", "z"), (2, "A", None, "x", "y", "z"), (None, "A", "80", "x", "y", "z"), (3, "A", "80", None, None, None)], SCHEMA)
    w = Weights(dict.fromkeys(FIELDS, 1.0), dict.fromkeys(FIELDS, 0.0))
    assert {(r["key"], r["group_id"]) for r in groups(df, "id", block(), FIELDS, w, 1.0).collect()} == {(1, 1), (2, 2), (3, 3)}
    empty = df.limit(0)
    assert groups(empty, "id", block(), FIELDS, w, 1.0).collect() == [] and learn(empty, block(), FIELDS).agree == dict.fromkeys(FIELDS, 0.0)


def test_officer_block(spark):
    df = spark.createDataFrame([("Ann  O'Hara", "1970-05-01"), ("ANN OHARA", "1970-05-20")], "officer_name string, date_of_birth string")
    assert df.withColumn("date_of_birth", F.col("date_of_birth").cast("date")).select(*officer_block()).distinct().count() == 1


def test_groups_that_are_done_are_not_read_again(spark, monkeypatch):
    """What a round settles shrinks with what is left to join: many finished pairs beside a long chain cost their first round."""
    from firmlake.operators import identity

    settled = []

    def counted(df, purpose="settled"):
        out = plain(df, purpose)
        settled.append(out.count())
        return out

    plain = identity.settle
    monkeypatch.setattr(identity, "settle", counted)
    pairs, chain = [(10_000 + 2 * k, 10_001 + 2 * k) for k in range(3000)], [(k, k + 1) for k in range(200)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs + chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{v: u for u, v in pairs}, **{u: u for u, _ in pairs}}
    assert sum(settled) < 4 * (len(pairs) + len(chain))


def test_the_block_is_made_once(spark, monkeypatch):
    """A row's block is costly text: a filter on it would have Spark make it a second time."""
    from firmlake.operators import identity

    plans = []

    def seen(df, purpose="settled"):
        if purpose == "identity":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, purpose)

    plain = identity.settle
    monkeypatch.setattr(identity, "settle", seen)
    df = spark.createDataFrame([(1, "Ann", "1970-05-01", "x"), (2, "ANN", "1970-05-09", "x")], "id long, officer_name string, date_of_birth string, town string")
    weights = Weights({"town": 1.0}, {"town": 0.0})
    got = groups(df, "id", officer_block(), ["town"], weights, 1.0).collect()
    assert {r["key"]: r["group_id"] for r in got} == {1: 1, 2: 1}
    assert len(plans) == 1 and plans[0].count("regexp_replace") == 2
