"""Every stage of the pipeline against brute force, on its own input."""

import hashlib
import os

import numpy as np
import pytest

import corpus_pipeline
from firmlake.llm.fm_index import cut_words, words_of
from firmlake.llm.line_dedup import MIN_WORDS
from firmlake.llm.queries import vocabulary
from firmlake.session import settle
from tests.llm import test_line_dedup, test_minhash

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], FOLDER)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(df.dtypes == stages[0].dtypes for df in stages[1:-1])
    assert [len({r.doc_id for r in df.collect()}) for df in stages] == [df.count() for df in stages]


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = texts(stages[0]), texts(stages[1])
    assert all(after[i] == before[i] for i in after)
    gone = set(before) - set(after)
    assert sum(labels.get(i) == 0 for i in gone) <= 1 and sum(labels.get(i) == 1 for i in gone) >= 0.7 * sum(labels.get(i) == 1 for i in before)


def test_repeated_runs_go(stages):
    rows = [(i, t) for i, t in texts(stages[1]).items()]
    want = test_line_dedup.brute(rows, MIN_WORDS)
    expected = {i: want[i, t][0] if t else t for i, t in rows if not t or want[i, t][2] == 0 or want[i, t][2] < want[i, t][1]}
    assert texts(stages[2]) == expected
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if r.doc_id in expected and expected[r.doc_id] != dict(rows)[r.doc_id])


def test_one_of_each_group_stays(stages):
    rows = list(texts(stages[2]).items())
    assert set(texts(stages[3])) == {d for d, _, _, kept in test_minhash.brute(rows) if kept}


def test_benchmark_words_go(spark, stages):
    items = [words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(max(len(w) - 9, 1))}
    sizes = {len(g) for g in grams}
    expected = {}
    for i, t in texts(stages[3]).items():
        words = words_of(t)
        hit = sorted({j for n in sizes for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in grams for j in range(k, k + n)})
        runs = [(int(x[0]), int(x[-1]) + 1) for x in np.split(np.array(hit, int), np.flatnonzero(np.diff(hit) > 1) + 1) if len(x)]
        if len(hit) < len(words) or not words:
            expected[i] = cut_words(t, runs) if runs else t
    assert texts(stages[4]) == expected


def test_tokens(stages):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts(stages[4]).items()}
    got = stages[5].collect()
    assert {r.doc_id: list(r.token_ids) for r in got} == want
    for r in got[:40]:
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want[r.doc_id], skip_special_tokens=False).encode()).hexdigest()


def test_odd_documents(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, a very long text, columns with names that the stages use."""
    folder = str(tmp_path)
    docs = [(None, None, None, None, None, 1, "f"), (1, "", "en", "s", 0, 1, "f"), (2, "a b c " * 60_000, "en", None, 360_000, None, None),
            (3, "one two three", "en", "s", 13, 1, "f"), (3, "one two three", "en", "s", 13, 1, "f"), (4, None, "de", "s", None, 1, "f")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text int, n_tokens string"
    for rows, name in ((docs, "documents"), ([], "empty")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
        spark.createDataFrame([(1, "x y z"), (None, "q"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{folder}/documents").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "None"]
    assert {r.doc_id: r.n_tokens for r in got} == {None: 0, 1: 0, 2: 180_000, 3: 3, 4: 0}
    assert corpus_pipeline.run(spark, f"{folder}/empty").collect() == []
