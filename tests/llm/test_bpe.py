import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from firmlake.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(2)
    out = ["", " ", "\n\t", "Hello's WORLD'LL 123 <|endoftext|>x<|startoftext|>", "ΣΑΣ İstanbul é \x1c a\x85b ", "aaaaaaaaaaaaaaaaaaaa",
           "😀😃 日本語 ١٢٣ ½ ǅ ß", "a" * 20_000, "<|ENDOFTEXT|> \x00\x01", "don't!!! they've 'S"]
    spans = [(32, 126), (160, 0x24F), (0x370, 0x52F), (0x4E00, 0x4EFF), (0x1F600, 0x1F64F)]
    for _ in range(500):
        out.append("".join(chr(rng.randint(*rng.choice(spans))) if rng.random() < 0.4 else rng.choice("etaoin shrdlu'") for _ in range(60)))
    return out


def test_ids_and_decoding_are_the_library_s(own, library):
    for text, (ids, decoded) in zip(texts(), own.encode(texts())):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(ids)


def test_speculation_and_exact_merging_agree(own):
    v = own.vocabulary
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abehinorstu") for _ in range(rng.randint(1, 14))) for _ in range(4000)})
    merged = v.merged if hasattr(v, "merged") else 0
    assert v.encode_words(words) == [tuple(v.merge(w)) for w in words]
    assert 0 < v.merged - merged < len(words)  # some words fail and many pass


def test_long_words_are_merged_alike(own):
    v, rng = own.vocabulary, random.Random(7)
    for alphabet in ("a", "ab", "theinr"):
        word = "".join(rng.choice(alphabet) for _ in range(700))
        parts = [v.ids[c] for c in word[:-1]] + [v.ids[word[-1] + bpe.WORD_END]]
        assert v._merge_short(list(parts)) == v._merge_long(list(parts))
    assert len(v.merge("a" * 300_000)) < 300_000


def test_ids_decode_by_themselves(spark, library):
    """The decoder gets ids and nothing else, and gives the text that the library gives."""
    rows = [(k, library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts()[:60])] + [(100, None), (101, [])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, token_ids array<int>").selectExpr("*", "1 as DECODED"), PATH)
    assert got.columns == ["doc_id", "token_ids", "DECODED", "_decoded"]
    assert {r["doc_id"]: r["_decoded"] for r in got.collect()} == {k: library.decode(x, skip_special_tokens=False) if x else "" for k, x in rows}
    own = bpe.Encoder(PATH)
    own.known["cat"] = np.array([1, 2], "<u4").tobytes()  # a wrong encoding shows in what is decoded
    assert next(own.encode(["cat"]))[1] == library.decode([1, 2], skip_special_tokens=False)


def test_query_columns(spark):
    rows = [(None, None), (1, None), (1, ""), (2, "the cat"), (2, "the cat"), (3, "long " * 100_000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(df, PATH).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (None, 0, empty) in got and (1, 0, empty) in got and any(r[:2] == (3, 100_000) for r in got)
    full = bpe.encode(df, PATH)
    assert full.columns[:3] == df.columns and full.columns[3] == "_n_tokens" and full.count() == 6
    assert bpe.digests(df.limit(0), PATH).collect() == []
    assert [r.n_tokens for r in bpe.tokens(df.where("doc_id = 2"), PATH).collect()] == [2, 2]
