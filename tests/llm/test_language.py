import zlib

import numpy as np
import pytest

from firmlake.llm import language
from firmlake.llm.language import PAD, Network, fit, language_spans, predict, with_language

SOUNDS = {"aa": ("ka", "lo", "mi", "än"), "bb": ("str", "eng", "ock"), "cc": ("oui", "él", "ça", "que")}


def corpus(n):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(n):
        lang = list(SOUNDS)[k % 3]
        words = ["".join(rng.choice(SOUNDS[lang], rng.integers(1, 4))) for _ in range(rng.integers(3, 60))]
        rows.append((k, " ".join(words), lang))
    return rows


def one_by_one(network, data):
    """Probabilities per byte of one segment, a step after the other, by the textbook's formulas."""
    s = lambda x: 1 / (1 + np.exp(-x))
    both = []
    for d in (0, 1):
        h, out = np.zeros(network.out.shape[1]), []
        for byte in data if d == 0 else data[::-1]:
            g, u = network.inputs[d][:, byte].astype(float), network.steps[d].astype(float)
            update, reset = s(2 * (g[0] + h @ u[0])), s(2 * (g[1] + h @ u[1]))
            new = np.tanh(g[2] + reset * (h @ u[2]))
            h = update * h + (1 - update) * new
            out.append(h)
        both.append(out if d == 0 else out[::-1])
    z = np.array(both[0]) @ network.out[0] + np.array(both[1]) @ network.out[1] + network.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_pooled_probabilities_against_the_formulas():
    network = Network(["x", "y", "z"])
    texts = [b"", b"a", "héllo wörld".encode() * 9, bytes(range(32, 127)) * 3, b"q" * language.SEGMENT]
    got = network.pool(texts)
    assert np.allclose(got[0], 1 / 3)
    for text, own in zip(texts[1:], got[1:]):
        parts = [one_by_one(network, text[k : k + language.SEGMENT]) for k in range(0, len(text), language.SEGMENT)]
        assert np.allclose(own, np.concatenate(parts).mean(axis=0), atol=1e-5)
    assert np.allclose(network.pool([texts[2]])[0], got[2], atol=1e-6)  # whatever stands beside it


def test_gradients_against_differences():
    network = Network(["x", "y", "z"], hidden=5)
    for name in ("inputs", "steps", "out", "bias"):
        setattr(network, name, getattr(network, name).astype(float))
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (7, 4))
    x[4:, 2] = PAD
    y = np.array([0, 2, 1, 1])
    _, slopes = network.gradients(x, y)
    for p, g in zip(network.parameters(), slopes):
        used = np.argwhere(np.abs(g) > 1e-6)
        for at in map(tuple, used[rng.permutation(len(used))[:12]]):
            old = p[at]
            p[at] = old + 1e-5
            above = network.gradients(x, y)[0]
            p[at] = old - 1e-5
            below = network.gradients(x, y)[0]
            p[at] = old
            assert g[at] == pytest.approx((above - below) / 2e-5, rel=1e-3, abs=1e-7)


def test_held_out_accuracy(spark):
    rows = corpus(900)
    df = spark.createDataFrame([*rows, (None, "kalo", "aa")], "doc_id long, text string, lang string")
    got = predict(df).collect()
    assert len(got) == 901 and {r["held_out"] for r in got if r["doc_id"] is None} == {True}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None]
    assert {r["doc_id"] for r in held} == {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held]) > 0.97
    assert all(1 / 3 <= r["score"] <= 1 for r in got)


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, t, lang if zlib.crc32(str(k).encode()) % 3 != 1 else "zz") for k, t, lang in corpus(60)]
    assert fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).labels == list(SOUNDS)


def test_odd_texts_and_columns(spark):
    free = next(k for k in range(9) if zlib.crc32(str(k).encode()) % 3 != 1)
    one = [(free, "hello", "en"), (free, "hallo", "de"), (free, "hola", None)]
    df = spark.createDataFrame(one, "doc_id long, text string, lang string")
    network = fit(df)
    assert network.labels == ["de"]
    odd = spark.createDataFrame([(None, "a", 1), ("é", "b", 2), ("12 ?!", "c", 3), ("", "d", 4), ("abc" * 5000, "e", 5)], "text string, _LANGUAGE string, _text int")
    out = with_language(odd, network)
    assert out.columns == ["text", "_LANGUAGE", "_text", "__language", "_certainty"]
    got = {r["_text"]: (r["__language"], r["_certainty"]) for r in out.collect()}
    assert got == {1: ("und", 0.0), 2: ("de", 1.0), 3: ("und", 0.0), 4: ("und", 0.0), 5: ("de", 1.0)}
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert fit(none).labels == [] and predict(none).collect() == []
    assert {r["lang_pred"] for r in predict(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_spans(spark):
    rows = corpus(300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(1, " ".join(["kalomi"] * 30) + " " + " ".join(["strengock"] * 30)), (2, None), (3, "")], "doc_id long, text string")
    spans = sorted(tuple(r)[1:] for r in language_spans(mixed, fit(df)).collect())
    assert spans[0][0] == 0 and spans[-1][1] == 6 * 30 + 29 + 1 + 9 * 30 + 29 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    size = {lang: sum(b - a for a, b, own in spans if own == lang) for lang in SOUNDS}
    assert size["aa"] > 150 and size["bb"] > 250
