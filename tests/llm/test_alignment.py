import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmlake.llm.alignment import _library, _ranked, align, align_texts, byte_letters

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", "The lazy dog.", None, "", " ", "  two  spaces ",
    "tabs\tand\nlines\r\n", "<|endoftext|> and <s> and </s> <0x41>", "café naïve 你好 \U0001f600‍", "ﬁne ligature", "a▁b",
    "x" * 300, "0123456789 " * 40, "\x00\x01", "Ein Satz mit Umlauten: äöüß.", "é combining",
]


def brute():
    """Per text: groups, links and numbers, by walking through both lists of token bytes."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letters = byte_letters()
    out = []
    for text in TEXTS:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not (b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode()):
            out.append(([], [], [], []))
            continue
        ends_a, ends_b, n = [], [], 0
        for x in bytes_a:
            ends_a.append(n := n + len(x))
        n = 0
        for x in bytes_b:
            ends_b.append(n := n + len(x))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(f"{','.join(map(str, ids_a[i:k]))}|{','.join(map(str, ids_b[j:m]))}")
            i, j = k, m
        links = [(x, y) for x, e in zip(ids_a, ends_a) for y, f in zip(ids_b, ends_b) if e == f]
        out.append((ids_a, ids_b, groups, links))
    count = Counter(link for row in out for link in row[3])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (len(x), len(y), len(g), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), ";".join(g))
        for x, y, g, links in out
    ]


def contents():
    with open(A_PATH, encoding="utf-8") as f, open(B_PATH, "rb") as g:
        return f.read(), g.read()


@pytest.mark.parametrize("broadcast_pairs", [0, 10_000])
def test_against_both_libraries(spark, broadcast_pairs):
    rows = [(k, t, k, "x") for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEY int, n_a string")
    got = align(df, *contents(), broadcast_pairs=broadcast_pairs).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(brute())) and len(got) == len(TEXTS)
    want = brute()
    assert want[0] == want[1] and want[0][0]
    assert sum(w[0] > 0 for w in want) > 8


def test_ranks_encode_as_the_library_does():
    """Over odd and random texts: letters, marks, digits, spaces of all kinds, strings of special tokens, bytes of no letter."""
    own = Tokenizer.from_file(A_PATH)
    own.encode_special_tokens = True
    names, encode = _ranked(contents()[0])
    plain, library = _library(contents()[0])
    assert names == plain[: len(names)]
    rng = random.Random(2)
    alphabet = "abcdeé ñ\u0301\u200d\u00a0\u3000\t\n\r 0123٣½'sREve<|endoftext|>.,!你好\U0001f600\x00\x7f\u2028"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    texts += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(30)) if not 0xD800 <= c < 0xE000) for _ in range(300)]
    want = [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    assert encode(texts) == want == library(texts)


def test_other_vocabularies_go_through_the_library(spark):
    """A vocabulary whose ids do not follow its merges gives the same groups."""
    import json

    a, b = contents()
    other = json.loads(a)
    vocab = other["model"]["vocab"]
    x, y = (next(n for n, i in vocab.items() if i == k) for k in (300, 400))
    vocab[x], vocab[y] = 400, 300
    assert _ranked(json.dumps(other)) is None
    df = spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[2])], "doc_id long, text string")
    sizes = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    assert sorted(align(df, json.dumps(other), b).select(*sizes).collect()) == sorted(align(df, a, b).select(*sizes).collect())


def test_digest_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"), (None, None), (2, "")], "doc_id long, text string")
    got = align(df, *contents(), keep=lambda g: F.sha2(g.cast("binary"), 256)).collect()
    plain = align_texts(df, *contents()).collect()
    assert len(got) == 5 and len(plain) == 1 and plain[0]["times"] == 3
    digest = hashlib.sha256(plain[0]["groups"].encode()).hexdigest()
    assert sorted(r["groups"] for r in got) == ["", "", digest, digest, digest]
    full = [r for r in got if r["groups"]]
    assert all(r["count_sum"] == 3 * r["n_links"] and r["n_best"] == r["n_links"] == r["n_groups"] for r in full)
    assert align(df.limit(0), *contents()).collect() == []
