import random
import re

import numpy as np

from firmlake.llm.line_dedup import SPACE, deduplicate, drop_repeated_lines, windows

SCHEMA = "doc_id long, text string"


def lines(text):
    parts = [re.split(rb"(?<=[.!?]) ", x) for x in text.encode().split(b"\n")]
    return [[y.strip(SPACE) for y in x if y.strip(SPACE)] for x in parts]


def brute(rows, least):
    """(kept text, lines, lines lost) per row, by trying every run of lines."""
    order = sorted({(i is None, i or 0, t) for i, t in rows if t})
    docs = [sum(lines(t), []) for _, _, t in order]
    first, runs = {}, {}
    for d, own in enumerate(docs):
        size = [len(x.split()) for x in own]
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += size[b]
                if total >= least:
                    run = tuple(own[a : b + 1])
                    first.setdefault(run, (d, a))
                    runs.setdefault(d, []).append((run, a, b))
                    if total >= least + 3 * max(size):  # longer runs are made of these
                        break
    out = {}
    for d, (null, i, t) in enumerate(order):
        lost = {k for run, a, b in runs.get(d, []) if first[run] < (d, a) for k in range(a, b + 1)}
        kept, k = [], 0
        for raw, parts in zip(t.split("\n"), lines(t)):
            left = [x.decode() for n, x in enumerate(parts, k) if n not in lost]
            k += len(parts)
            if len(left) == len(parts):
                kept.append(raw)
            elif left:
                kept.append(" ".join(left))
        out[None if null else i, t] = ("" if lost and len(lost) == len(docs[d]) else "\n".join(kept), len(docs[d]), len(lost))
    return out


def test_windows_of_several_documents():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = rng.integers(0, 9, size=6)
        words, ends = rng.integers(1, 12, size=counts.sum()), np.repeat(np.cumsum(counts), counts)
        want, base = set(), 0
        for c in counts.tolist():
            own = words[base : base + c]
            for i in range(c):
                for j in range(i, c):
                    if own[i : j + 1].sum() >= 15 and (own[i:j].sum() < 15 or own[i + 1 : j + 1].sum() < 15):
                        want.add((base + i, base + j))
            base += c
        assert set(zip(*(x.tolist() for x in windows(words, ends, 15)))) == want


def test_a_glued_passage(spark):
    passage = " ".join(f"Word{k} is here, and so it goes." for k in range(9))
    rows = [(1, f"Own text one. {passage}"), (2, f"Own text two, with\nmore. {passage}"), (3, f"No full stop {passage} Rest of it."), (4, "Clean. Text.")]
    got = {r.doc_id: r.text for r in deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "Own text two, with\nmore.", 3: "No full stop Word0 is here, and so it goes. Rest of it.", 4: "Clean. Text."}


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["a", "b", "c", "d", "e.", "f!"]) for _ in range(rng.choice([1, 3, 9, 20]))) for _ in range(12)]
    rows = []
    for i in range(150):
        picked = [rng.choice(pool) if rng.random() < 0.8 else f"own line {i} {k}" for k in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(x if rng.random() < 0.9 else f"  {x}\t\r" if rng.random() < 0.5 else "" for x in picked)))
    rows += [(151, "\n".join(pool)), (152, "\n".join(pool)), (153, "\n".join(pool[:6] + ["new"] + pool[6:]))]
    want = brute(rows, 20)
    got = deduplicate(spark.createDataFrame(rows, SCHEMA), 20).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        assert (r.text, r._lines, r._removed) == (want[r.doc_id, text] if text else ("", 0, 0))


def test_odd_rows(spark):
    long = "word " * 60
    rows = [(None, None, 1), (1, None, 1), (1, "", 1), (2, long, 1), (2, long, 1), (None, long, 1), (3, "\n\n" + long + "\n \n", 1), (4, "x. " * 100_000, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", _lines int")
    got = deduplicate(df).collect()
    assert len(got) == len(rows) and set(df.columns) < set(got[0].asDict())
    by = [(r.doc_id, r.text, r._removed) for r in got]
    assert by.count((2, long, 0)) == 2  # equal rows are one document
    assert (None, "", 1) in by and (3, "", 1) in by and (1, None, 0) in by and (1, "", 0) in by
    kept = drop_repeated_lines(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "2", "4", "None"]
    assert deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []
