import random

import numpy as np
import pytest

from firmlake.llm.periodic import collapsed, runs_of, split_words, with_runs
from firmlake.llm.queries import looped


def brute(words):
    """Every run, by comparing all places at all distances; a stretch with a shorter period that divides its own is none."""
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x, out = np.array([numbers[w] for w in words]), []
    for q in range(1, len(x) // 2 + 1):
        same = np.concatenate(([False], x[:-q] == x[q:], [False])).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            length = int(e - s + q)
            if length >= max(12, 2 * q) and not any(q % p == 0 and s_ <= s and s_ + n_ >= s + length for s_, n_, p in out):
                out.append((int(s), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def odd_texts():
    rng = random.Random(3)
    out = ["", "a", "a" * 11, "a" * 12, "ab" * 6, "ab" * 5, "a" * 700, fibonacci(900), thue_morse(700), ("a" * 150 + "b") * 4, "a" * 200 + "b" + "a" * 200 + "c"]
    out += ["ab" * 60 + "a" + "ab" * 80, "c" + "ab" * 100 + "a" + "ab" * 100 + "a" + "d", "aab" * 70 + "ab" * 90 + "aab" * 70, "abcab" * 50 + "bcaba" * 60]
    for _ in range(150):
        text = ""
        while len(text) < rng.choice((60, 200, 500, 900)):
            root = "".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.choice((1, 2, 3, 5, 9, 17, 34, 70, 130))))
            times = rng.choice((1, 2, 2, 3, 5, 20))
            text += (root * times)[: rng.randint(1, len(root) * times)] if rng.random() < 0.5 else root * times
            if len(text) > 1500:
                break
        out.append(text + text[: rng.choice((0, 0, len(text)))])
    return out


def test_runs_against_all_pairs():
    texts = odd_texts()
    found = runs_of([[c.encode() for c in t] for t in texts])
    for text, own in zip(texts, found):
        assert own == brute(text), text
    assert max(p for own in found for _, _, p in own) > 200


def test_short_texts():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(40, 120))) * rng.randint(1, 3) for _ in range(200)]
    texts += ["x" * k + "ab" * 40 + "a" * j + "ab" * 40 for k in range(3) for j in range(3)]
    for text, own in zip(texts, runs_of([[c.encode() for c in t] for t in texts])):
        assert own == brute(text), text


def test_long_text():
    """Hundreds of thousands of words, of one kind and of a long period, are searched in seconds."""
    rng = random.Random(1)
    root = [str(rng.randrange(5000)).encode() for _ in range(50_001)]
    assert runs_of([root * 4])[0] == [(0, 200_004, 50_001)]
    assert runs_of([[b"a"] * 300_000])[0] == [(0, 300_000, 1)]
    mixed = ([b"a"] * 20_000 + [b"b"]) * 4
    assert (0, 80_004, 20_001) in runs_of([mixed])[0] and len(runs_of([mixed])[0]) == 5
    both = [b"a", b"b"] * 3000 + [b"a"] + [b"a", b"b"] * 3000
    assert len(runs_of([both])[0]) > 1400  # one for every odd period on the border


def test_equal_documents_side_by_side():
    words = [str(k).encode() for k in range(100)]
    assert runs_of([words, words, words, words * 2, []]) == [[], [], [], [(0, 200, 100)], []]


def test_collapse():
    words = split_words("x a b a b a b a b a b a b y")
    assert collapsed(words, runs_of([words])[0]) == [b"x", b"a", b"b", b"y"]


def test_words_are_cut_at_ascii_space_only():
    assert split_words("a b\x1cc \t\n\x0b\x0c\rd") == ["a b\x1cc".encode(), b"d"] and split_words(None) == []


SCHEMA = "doc_id long, text string, _RUNS int, `odd name` string"


def test_frame(spark):
    rows = [(1, "a " * 20, 1, "x"), (1, "a " * 20, 2, "x"), (None, "b c " * 8, 3, None), (2, None, 4, None), (3, "", None, None), (4, " \n ", 4, None)]
    out = with_runs(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "_RUNS", "odd name", "_words", "__runs", "_collapsed"]
    got = sorted((r["_RUNS"] or -1, r["_words"], [tuple(x) for x in r["__runs"]], r["_collapsed"]) for r in out.collect())
    assert got == [(-1, 0, [], ""), (1, 20, [(0, 20, 1)], "a"), (2, 20, [(0, 20, 1)], "a"), (3, 16, [(0, 16, 2)], "b c"), (4, 0, [], ""), (4, 0, [], "")]
    assert with_runs(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("doc_id", [0, 3, 19, 31, 40, 55])
def test_planting(doc_id):
    """The contract's loops: some ids get one, and it is among the runs."""
    import zlib

    words = [str(k).encode() for k in range(300)]
    h = zlib.crc32(str(doc_id).encode())
    got = looped(doc_id, words)
    if h % 10:
        assert got == words
    else:
        g = h // 10
        a = g % 300
        p = 1 + (300 - a) // (3 + g % 8)
        assert got == words[:a] + [words[a + (i - a) % p] for i in range(a, 300)]
    assert looped(None, words) == words and looped(doc_id, []) == []
