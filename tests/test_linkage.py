import random

import pytest

from firmlake.operators import linkage
from firmlake.operators.linkage import count_links, link_names, ordered


def grams(text):
    out = set()
    for word in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split():
        padded = f"  {word} "
        out |= {padded[k : k + 3] for k in range(len(padded) - 2)}
    return frozenset(out)


def brute(rows, threshold):
    """Every pair of rows compared."""
    sets = [(k, grams(t)) for k, t in rows]
    least = {}
    for k, g in sets:
        if g and k is not None:
            least[g] = min(k, least.get(g, k))
    out = []
    for n, (k, g) in enumerate(sets):
        links = sum(1 for m, (_, h) in enumerate(sets) if m != n and g and h in least and len(g & h) / len(g | h) >= threshold)
        out.append((k, least.get(g), links if g in least else 0))
    return sorted(out, key=str)


def names(n, seed=3):
    rng = random.Random(seed)
    words = ["limited", "holdings", "north", "northern", "trade", "trading", "ltd", "a", "io", "metal", "metals", "uk"]
    out = []
    for k in range(n):
        text = " ".join(rng.sample(words, rng.randint(1, 4)))
        if rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz é") + text[at + 1 :]
        out.append((k, text))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 1.0])
def test_against_all_pairs(spark, threshold):
    rows = names(160) + [(1000 + k, "Common Name Ltd") for k in range(80)] + [(500, None), (501, ""), (502, " -- "), (None, "north"), (None, "nobody else")]
    df = spark.createDataFrame(rows, "id long, title string")
    got = sorted((tuple(r) for r in count_links(df, "id", "title", threshold).collect()), key=str)
    assert got == brute(rows, threshold)


def test_pairs_come_once(spark):
    rows = names(120, 5)
    members, pairs = link_names(spark.createDataFrame(rows, "id long, title string"), "id", "title", 0.4)
    found = [(r["class_a"], r["class_b"]) for r in pairs.collect()]
    assert len(found) == len(set(found)) > 0 and all(a < b for a, b in found)
    texts = dict(rows)
    for r in pairs.collect():
        a, b = grams(texts[r["class_a"]]), grams(texts[r["class_b"]])
        assert r["similarity"] == len(a & b) / len(a | b)
    assert members.count() == 120


def test_a_gram_of_every_name_is_in_no_prefix(spark):
    """What all names share stands last in the order, so names meet on what sets them apart."""
    rows = [(k, f"company {k:04d}") for k in range(300)]
    from firmlake.operators.linkage import name_classes

    _, classes = name_classes(spark.createDataFrame(rows, "id long, title string"), "id", "title")
    for r in ordered(classes).collect():
        assert set(r["grams"][-9:]) >= {"com", "omp", "mpa", "pan", "any"}


def test_hot_grams_are_dealt_in_cells(spark, monkeypatch):
    """Rows of one gram meet in many cells, each pair in one of them."""
    monkeypatch.setattr(linkage, "BLOCK", 4)
    rows = names(160, 9) + [(2000 + k, f"company {k:03d}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, title string")
    got = sorted((tuple(r) for r in count_links(df, "id", "title", 0.6).collect()), key=str)
    assert got == brute(rows, 0.6)
    left = spark.range(50).selectExpr("1 AS k", "id AS a", "0 AS x")
    right = spark.range(30).selectExpr("1 AS k", "id AS b", "0 AS y")
    left, right = linkage.cells(left, right, ["k"], "a", "b")
    assert left.select("row", "column").distinct().count() > 50
    met = left.join(right, ["k", "row", "column"])
    assert met.count() == met.select("a", "b").distinct().count() == 1500
    assert max(r["count"] for r in met.groupBy("row", "column").count().collect()) < 300


def test_letters_beyond_the_basic_plane(spark):
    rows = [(1, "\U00010400\U00010401\U00010402 uno"), (2, "\U00010400\U00010401\U00010402 unos"), (3, "\U00010400\U00010401 duo"), (4, "uno")]
    df = spark.createDataFrame(rows, "id long, title string")
    assert sorted((tuple(r) for r in count_links(df, "id", "title", 0.5).collect()), key=str) == brute(rows, 0.5)


def test_empty(spark):
    assert count_links(spark.createDataFrame([], "id long, title string"), "id", "title", 0.5).collect() == []
    with pytest.raises(ValueError):
        link_names(spark.createDataFrame([(1, "a")], "id long, title string"), "id", "title", 0)
