import os
import random
import zlib

import pytest

from firmlake.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def made(n):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioubdst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 7 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["vrakk", "vrakken", "zmuk"])
        docs.append((i, " ".join(own)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out(spark):
    docs, labels = made(900)
    got = toxicity.scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 900
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_accuracy_on_the_test_tables(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = toxicity.scores(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    table = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert table.get((0, 1), 0) <= 0.01 * table[0, 0] and table.get((1, 0), 0) <= 0.2 * table[1, 1]


def test_odd_rows(spark):
    docs, labels = made(300)
    rows = [(i, t, 1.0, "z") for i, t in docs] + [(None, None, 1.0, "z"), (5, "", None, None), (5, "", None, None), (6, "vrakk " * 50_000, 0.0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _toxicity double, _text string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (4, None, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(df, known).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    kept = toxicity.drop_toxic(df, known)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.scores(docs, labels).collect()] == [0.5]
    assert toxicity.scores(docs.limit(0), labels).collect() == []
    one = spark.createDataFrame([(1, 1, 0)], labels.schema)
    assert toxicity.scores(docs, one).collect()[0].predicted == 0
