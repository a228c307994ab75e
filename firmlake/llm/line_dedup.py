"""Line deduplication by winnowing over line hashes.

A line is a line of the text, cut after a full stop, exclamation or question mark that a blank follows: passages are
often glued to other text of their line. A window is a run of consecutive non-blank lines with at least MIN_WORDS words
that falls below it when its first or its last line is left out. The line with the least hash in a window is its
fingerprint: two runs that are equal over a window hold the same fingerprint at the same place, so no repeated run of
MIN_WORDS words goes without one. Fingerprints that occur once are dropped at once. At the others, matches are extended
both ways over the windows around them: a window that occurred before, in an earlier document or further up, is a repeat,
and repeats that adjoin or overlap make up a repeated run. All lines of repeated runs go; the first occurrence of every
line stays.

The result is exact: a line is deleted if and only if it lies in a run of at least MIN_WORDS words that occurs earlier.
Earlier means by ``doc_id`` (nulls last), then by the hash of the text, then by line. Rows that are equal in both are
one document for this purpose and get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.llm.common import fresh, kinds, slices
from firmlake.session import discard, settle

MIN_WORDS = 30
SPACE = b" \t\r\x0b\x0c"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cut_sentences(text: bytes) -> list[bytes]:
    """Lines without white space at their ends, blank ones too."""
    for mark in (b".", b"!", b"?"):
        text = text.replace(mark + b" ", mark + b"\n")
    return [x.strip(SPACE) for x in text.split(b"\n")]


def lines_of(text: str) -> list[bytes]:
    return [x for x in cut_sentences(text.encode("utf-8", "replace")) if x]


def windows(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of all windows of a batch: the shortest that begins with a line, the shortest that ends with it.

    ``words`` of the lines of several documents one after the other; ``ends[i]`` is where the document of line i ends.
    """
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words)))
    starts = np.concatenate(([0], ends[:-1])) if n else ends
    starts = np.maximum.accumulate(np.where(starts <= np.arange(n), starts, 0))
    last = np.searchsorted(total[1:], total[:-1] + least, side="left")
    forward = np.flatnonzero(last < ends)
    first = np.searchsorted(total[:-1], total[1:] - least, side="right") - 1
    backward = np.flatnonzero(first >= starts)
    code = np.unique(np.concatenate((forward * (n + 1) + last[forward], first[backward] * (n + 1) + backward)))
    return code // (n + 1), code % (n + 1)


def _packed(codes: np.ndarray, first: np.ndarray, last: np.ndarray, base: np.ndarray):
    """Windows by fingerprint: (places of the fingerprints, offsets into, bytes of the packed windows).

    A fingerprint's bytes are a record per window: its first and last line in the document, and a hash of its lines.
    """
    least, place = codes[first].copy(), first.copy()
    content = np.zeros(len(first), np.uint64)
    size, k = last - first, 0
    live = np.arange(len(first))
    while len(live):
        now = codes[first[live] + k]
        lower = now < least[live]
        least[live[lower]], place[live[lower]] = now[lower], first[live[lower]] + k
        mixed = (content[live] + now) * _MIX
        content[live] = mixed ^ (mixed >> np.uint64(29))
        k += 1
        live = live[size[live] >= k]
    order = np.argsort(place, kind="stable")
    rows = np.zeros(len(first), np.dtype([("s", "<u4"), ("e", "<u4"), ("c", "<i8")]))
    rows["s"], rows["e"] = (first - base[first])[order], (last - base[first])[order]
    rows["c"] = (content ^ size.astype(np.uint64)).view(np.int64)[order]
    where, begin = np.unique(place[order], return_index=True)
    return where, np.concatenate((begin, [len(rows)])).astype(np.int32) * 16, rows.tobytes()


def _marks(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(marks, slices(batches))

    def marks(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, words, counts = [], [], []
        for text in batch.column(2).to_pylist():
            lines = lines_of(text or "")
            counts.append(len(lines))
            codes += map(xxhash.xxh3_64_intdigest, lines)
            words += [len(x.split()) for x in lines]
        counts = np.array(counts, np.int64)
        base = np.repeat(np.cumsum(counts) - counts, counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        codes = np.array(codes, np.uint64)
        first, last = windows(np.array(words, np.int64), np.repeat(np.cumsum(counts), counts), least)
        where, offsets, data = _packed(codes, first, last, base)
        rows = pa.array(owner[where])
        packed = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pa.record_batch(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(codes[where].view(np.int64)), packed],
            names=["doc_id", "_h", "_print", "_windows"],
        )

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = batch.column(2).to_pylist()
        rows = np.frombuffer(b"".join(packed), np.dtype([("s", "<u4"), ("e", "<u4"), ("c", "<i8")]))
        owner = pa.array(np.repeat(np.arange(len(packed)), [len(x) // 16 for x in packed]), pa.int64())
        yield pa.record_batch(
            [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(rows["s"].astype(np.int32)),
             pa.array(rows["e"].astype(np.int32)), pa.array(rows["c"])], names=["doc_id", "_h", "_start", "_end", "_content"],
        )


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, _h, spans``: for each document with repeated runs, their spans of non-blank lines, ends included.

    ``_h`` is the hash of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), F.col("text").cast("string"))
    marks = settle(rows.mapInArrow(_marks(min_words), "doc_id long, _h long, _print long, _windows binary"), "fingerprints")
    again = marks.groupBy("_print").agg(F.count("*").alias("_n")).where("_n > 1").select("_print")
    again = settle(again, "again")
    matched = marks.join(again.hint("merge"), "_print").select("doc_id", "_h", "_windows")
    found = settle(matched.mapInArrow(_unpack, "doc_id long, _h long, _start int, _end int, _content long"), "matches")
    place = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("_h").alias("h"), F.col("_start").alias("s"))
    first = found.groupBy("_content").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = settle(first.select("_content", "_first"), "first")
    later = found.join(first.hint("merge"), "_content").where(place != F.col("_first"))
    spans = later.groupBy("doc_id", "_h").agg(
        F.sort_array(F.collect_set(F.struct(F.col("_start").alias("s"), F.col("_end").alias("e")))).alias("spans")
    )
    spans = settle(spans, "spans")
    discard(marks, again, found, first)
    return spans


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines of the spans, its non-blank lines and those it lost.

    A line of the text that loses a part keeps its other parts, joined by blanks; one that loses all goes.
    """
    gone: set[int] = set()
    for a, b in spans:
        gone.update(range(a, b + 1))
    kept, k = [], 0
    for raw in text.split("\n"):
        parts = [x for x in cut_sentences(raw.encode("utf-8", "replace")) if x]
        left = [x for n, x in enumerate(parts, k) if n not in gone]
        k += len(parts)
        if len(left) == len(parts):
            kept.append(raw)
        elif left:
            kept.append(b" ".join(left).decode("utf-8", "replace"))
    return ("\n".join(kept) if len(gone) < k else ""), k, len(gone)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are the text and the spans; they become the text left, and the lines that it had and lost."""
    for batch in slices(batches):
        width = batch.num_columns
        texts, had, lost = [], [], []
        for text, spans in zip(batch.column(width - 2).to_pylist(), batch.column(width - 1).to_pylist()):
            if spans:
                text, n, m = without(text, [(s["s"], s["e"]) for s in spans])
            else:
                n, m = len(lines_of(text or "")), 0
            texts.append(text)
            had.append(n)
            lost.append(m)
        yield pa.record_batch(
            [*batch.columns[: width - 2], pa.array(texts, pa.string()), pa.array(had, pa.int64()), pa.array(lost, pa.int64())],
            names=[*batch.schema.names[: width - 2], "\x00text", "\x00lines", "\x00removed"],  # by place
        )


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that is left, and last columns ``_lines, _removed`` (non-blank lines it had and lost).

    Lines are compared without ASCII white space at their ends. A null text stays null, an empty one empty; blank lines
    stay, but a document that loses all other lines becomes empty; see ``without``. All other columns are kept as they are; if some have
    the new columns' names, the new ones get another underscore in front.
    """
    names = docs.columns
    lines, removed, code, own, id_ = (fresh(names, n) for n in ("_lines", "_removed", "_hash", "_spans", "_id"))
    spans = repeats(docs, min_words).toDF(id_, code, own)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(code))
    others = [F.col(f"`{c}`") for c in names if c.lower() != "text"]
    # The same join at every size: without the hint a small list is broadcast, and texts move only beyond some size.
    joined = docs.join(spans.hint("merge"), same, "left").select(*others, F.col("text").cast("string").alias("text"), own)
    before = joined.drop("text", own)
    kept = fresh(names, "_kept")
    out = joined.mapInArrow(_cut, ", ".join(x for x in (kinds(before), f"`{kept}` string, `{lines}` long, `{removed}` long") if x))
    order = [F.col(kept).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names]
    return out.select(*order, lines, removed)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with the text that is left, all columns; a document goes if it had lines and lost all of them.

    ``n_chars``, where there is one, follows the text.
    """
    out = deduplicate(docs)
    lines, removed = (F.col(c) for c in out.columns[-2:])
    columns = [
        F.when(removed > 0, F.length("text")).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c)
        if c.lower() == "n_chars" else F.col(f"`{c}`") for c in docs.columns
    ]
    return out.where((removed == 0) | (removed < lines)).select(columns)
