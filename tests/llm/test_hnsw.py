import numpy as np
import pytest

from firmlake.llm.hnsw import build_index, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows
              if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q, a in usable:
        if q in queries:
            found = {}
            for i, b in usable:
                if i != q and len(a) == len(b):
                    found[i] = max(found.get(i, -2), float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))
            best = sorted(found.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
            out.update((q, n, i) for n, (i, _) in enumerate(best, 1))
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 24))
    rows = [(i, (centres[i % 8 if i > 800 else 0] + rng.normal(size=24)).astype(np.float32).tolist(), 0) for i in range(2400)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = search(build_index(df, 700), df.where("vec_id % 20 = 0"), query_rows=50).collect()
    want = brute(rows, set(range(0, 2400, 20)), 5)
    assert len(found) == len(want) == 600
    assert len({(r.query_id, r.vec_id) for r in found} & {(q, i) for q, _, i in want}) >= 0.95 * len(want)
    vectors = {i: np.array(v) for i, v, _ in rows}
    for r in found[:50]:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)


def test_ties_nulls_and_odd_vectors(spark):
    same = [(i, [1.0, 2.0, 2.0], 0) for i in range(40)]
    odd = [(100, None, 0), (101, [], 0), (102, [0.0, 0.0, 0.0], 0), (103, [1.0, None, 2.0], 0), (104, [float("nan"), 1.0, 1.0], 0),
           (105, [float("inf"), 1.0, 1.0], 0), (None, [1.0, 2.0, 2.0], 0), (106, [1.0, 2.0], 0), (107, [2.0, 1.0], 0),
           (0, [1.0, 2.0, 2.0], 9), (7, [2.0, 4.0, 4.0], 0)]
    rows = same + odd
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.query_id, r["rank"], r.vec_id) for r in search(build_index(df, 16), df).collect()}
    assert {x for x in found if x[0] == 0} == {(0, n, n) for n in range(1, 6)}
    assert {x for x in found if x[0] == 106} == {(106, 1, 107)}
    assert found == brute(rows, set(range(200)), 5)


def test_repeated_rows(spark):
    """Every row six times, and equal vectors under several ids: neighbours are other ids, each once."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(40)]
    rows += [(40 + i, rows[i % 3][1], 1) for i in range(9)]
    df = spark.createDataFrame(rows * 6, SCHEMA)
    for size in (1000, 64):
        found = search(build_index(df, size), df)
        assert {(r.query_id, r["rank"], r.vec_id) for r in found.collect()} == brute(rows, set(range(60)), 5)


def test_many_vectors_of_one_id(spark):
    """An id whose hundreds of vectors lie nearest does not hide the ids behind it."""
    rng = np.random.default_rng(5)
    near = [(1, [1.0, float(x), 0.0], 0) for x in rng.uniform(0, 0.01, 300)]
    rows = [(0, [1.0, 0.0, 0.0], 0), *near, *[(i, [1.0, 1.0, float(i)], 0) for i in range(2, 9)]]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r["rank"], r.vec_id) for r in search(build_index(df, 1000), df.where("vec_id = 0")).collect()}
    assert found == {(n, i) for _, n, i in brute(rows, {0}, 5)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert search(build_index(df), df).collect() == []
