import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlake.llm import fm_index
from firmlake.llm.fm_index import FMIndex, contamination, cut_words, items_digest, remove_phrases, words_of

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.mark.parametrize("seed", range(6))
def test_counts_and_places(seed):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(0, rng.integers(2, 9), size=rng.integers(1, 600)), 0).astype(np.int32)
    index = FMIndex(text, sample=5)
    for size in (1, 2, 4):
        phrases = rng.integers(1, 9, size=(40, size))
        low, high = index.find(phrases)
        for k, p in enumerate(phrases):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def brute(text, items, window=10):
    words, hit, found = words_of(text), set(), []
    for i, t in items:
        own = words_of(t)
        size = min(window, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        at = [k for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in grams] if grams else []
        hit.update(k + j for k in at for j in range(size))
        if at:
            found.append(i)
    return len(words), len(hit), len(found), items_digest(found), bool(hit)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fm_index, "SHARD_SYMBOLS", 500)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 10, 25])))) for k in range(40)]
    items += [(40, None), (41, "..."), (42, items[3][1]), (42, items[3][1])]
    docs = []
    for i in range(200):
        words = [rng.choice(vocabulary + ["Ünique", "zzz"]) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            k = rng.randint(0, len(words))
            words[k:k] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    docs += [(None, None), (5, ""), (5, ""), (500, docs[0][1] * 2), (501, " ".join(t for _, t in docs))]
    got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    known = {k: v for k, v in items}
    want = sorted((str(i), *brute(t, known.items())) for i, t in docs)
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == want


def test_several_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    items = [(k, " ".join(rng.choice("abcdef") for _ in range(12))) for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdef") for _ in range(3000))) for i in range(20)], DOCS)
    whole = sorted(contamination(docs, spark.createDataFrame(items, ITEMS)).collect())
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", 800)
    benchmark = spark.createDataFrame(items, ITEMS)
    assert len(fm_index.benchmark_blocks(benchmark)) > 1
    assert sorted(contamination(docs, benchmark).collect()) == whole
    kept = sorted(remove_phrases(docs, benchmark).collect())
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", 1 << 20)
    assert sorted(remove_phrases(docs, benchmark).collect()) == kept


def test_no_phrase_comes_to_the_driver(spark, monkeypatch):
    """The driver neither collects items nor builds phrases, and a plan does not carry them."""
    items = spark.range(400).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * 7 + k).cast("string")) for k in range(40)])).toDF("item_id", "text")
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(fm_index, "Phrases", None)  # workers import the module afresh
    blocks = fm_index.benchmark_blocks(items)
    assert len(blocks) > 2
    from pyspark import cloudpickle

    assert len(cloudpickle.dumps(fm_index._searcher(blocks[0], 10))) < 5_000


def test_removal_and_odd_columns(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"Before, {item.title()}. After!", 3, "x"), (2, item, 3, "x"), (3, "clean text", 10, "x"), (4, None, None, None), (5, "", 0, "x")]
    df = spark.createDataFrame(rows, DOCS + ", n_chars long, _found string")
    out = remove_phrases(df, spark.createDataFrame([(1, item)], ITEMS))
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("Before, . After!", 16), 3: ("clean text", 10), 4: (None, None), 5: ("", 0)}
    assert remove_phrases(df, spark.createDataFrame([], ITEMS)).count() == 5
    assert remove_phrases(df.limit(0), spark.createDataFrame([(1, item)], ITEMS)).count() == 0


def test_cut_words():
    assert cut_words("a, b c; d", [(1, 3)]) == "a, ; d" and cut_words("é a", [(0, 1)]) == " a"
