import random
import re

import numpy as np

from firmlake.llm import minhash
from firmlake.llm.components import components
from firmlake.llm.minhash import BINS, drop_near_duplicates, near_duplicates, shingles, signature

SCHEMA = "doc_id long, text string"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                group[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        ids = [x for x in (d, least.get(find(i))) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)]


def made(n, rng):
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.55 or not rows:
            own = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 8, 20, 60, 150]))]
        else:  # a copy of a copy with changed words: all degrees of likeness
            own = rows[rng.randrange(max(0, len(rows) - 40), len(rows))][1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own) if rng.random() < 0.9 else " \n".join(own).upper()))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = made(700, rng)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_links_that_a_star_misses(spark):
    """Borderline pairs around hubs that are unlike both, and blocks of two rows."""
    rng = random.Random(11)
    words = [f"v{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            own[rng.randrange(40)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    old = minhash.BLOCK
    minhash.BLOCK = 40
    try:
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        minhash.BLOCK = old
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(7, None), (8, ""), (9, " \n"), (3, "one two"), (2, "ONE  two"), (2, "ONE  two"), (6, long), (5, long + " y"), (None, "a b c d e f")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA + ", component_id int, _id int")
    got = sorted(map(str, map(tuple, near_duplicates(df).collect())))
    want = [(7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (3, 1, 2, False), (2, 1, 2, True), (2, 1, 2, True),
            (6, 29_996, 5, False), (5, 29_997, 5, True), (None, 2, None, True)]
    assert got == sorted(map(str, want))
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "7", "8", "9", "None"]
    assert near_duplicates(df.limit(0)).collect() == []


def test_signatures_estimate_likeness():
    rng = random.Random(1)
    for size in (8, 60, 500):
        share = []
        for _ in range(60):
            common = [rng.getrandbits(64) for _ in range(size * 6 // 7)]
            a, b = (np.unique(np.array(common + [rng.getrandbits(64) for _ in range(size - len(common))], np.uint64)) for _ in range(2))
            share.append((signature(a) == signature(b)).mean())
        want = (size * 6 // 7) / (2 * size - size * 6 // 7)
        assert abs(np.mean(share) - want) < 0.05
    assert signature(shingles("a b c")).shape == (BINS,)


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (300, 300)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), len(links)).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100, **{1000 + k: 1000 for k in range(300)}}
