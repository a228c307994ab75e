"""Periodic runs of words: stretches that repeat with some period, found by multi-scale minimizers.

A run is a stretch of words with smallest period q and a length of at least ``max(12, 2 * q)`` that cannot be made longer
on either side. Documents are searched many at a time: their words become numbers, one after the other in an array, with
a number of its own after each document, so that nothing repeats across a border.

* Periods below 2 * BASE: the array is compared with itself shifted by each of them.
* Scale t (16, 32, 64, ...) covers periods in [2t, 4t). Each stretch of t words has a hash; of every t neighbouring ones
  the least is selected. Inside a run of period q the windows at its start and one period on hold the same words, so both
  select the same place in them: two equal minima at distance q. Those pairs are extended both ways, word by word.
* A stretch of t words that has itself a period of at most t / 3 is no candidate for a minimum: it recurs too often. Equal
  candidates are therefore more than t / 3 apart, and a minimum has at most a dozen partners. If this leaves a run without
  any minimum, its first period lies in a run R of a short period p, and the second one in another run R' of period p that
  begins where R ends, or before (else the whole would have period p). So pairs of neighbouring runs of equal period give
  the seeds that are missing: the distances at which they are in step.

Nothing is capped, and only equal words make a run: hashes lead to seeds, never to results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from firmlake.llm.common import fresh, kinds, slices

BASE = 16  # words in the stretches of the smallest scale: a power of two, not below LEAST
LEAST = 12  # words in a run, at least
BLOCK = 1 << 17  # words that are searched together
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

RUN = "struct<start:long,length:long,period:long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extreme(x: np.ndarray, width: int, least: bool, pad: np.uint64) -> np.ndarray:
    """The least (or largest) of every ``width`` neighbours."""
    take = np.minimum if least else np.maximum
    blocks = np.full(-(-len(x) // width) * width, pad)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = take.accumulate(blocks, axis=1).ravel()
    back = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(x) - width + 1
    return take(back[:count], ahead[width - 1 : width - 1 + count])


def minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some ``width`` neighbours; NONE is never selected."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    low = _extreme(hashes, width, True, NONE)
    # A place is a minimum if the largest of the least values of the windows that hold it is its own.
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    return np.flatnonzero((_extreme(padded, width, False, np.uint64(0)) == hashes) & (hashes != NONE))


def _matched(words: np.ndarray, at: int, shift: int, forward: bool) -> int:
    """How many words from ``at`` on (or before it) equal those ``shift`` places further."""
    done, step, size = 0, 32, len(words)
    while True:
        if forward:
            first = at + done
            n = min(step, size - shift - first)
            unlike = words[first : first + n] != words[first + shift : first + shift + n]
        else:
            last = at - done
            n = min(step, last)
            unlike = (words[last - n : last] != words[last - n + shift : last + shift])[::-1]
        if n <= 0:
            return done
        k = int(unlike.argmax())
        if unlike[k]:
            return done + k
        done += n
        step *= 2


def _factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def _smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Has the stretch of one period from ``start`` no period that divides its length?"""
    for f in _factors(period):
        d = period // f
        if (words[start : start + period - d] == words[start + d : start + period]).all():
            return False
    return True


class _Found:
    """Runs found so far, as (start, length, period); a stretch that a seed leads to again is not extended again."""

    def __init__(self, words: np.ndarray):
        self.words, self.runs = words, []

    def add(self, start: int, length: int, period: int) -> None:
        if length >= max(LEAST, 2 * period) and _smallest(self.words, start, period):
            self.runs.append((start, length, period))

    def short(self, period: int) -> None:
        words = self.words
        same = np.flatnonzero(words[:-period] == words[period:])
        if not len(same):
            return
        cuts = np.flatnonzero(np.diff(same) > 1) + 1
        starts = same[np.concatenate(([0], cuts))]
        sizes = np.diff(np.concatenate(([0], cuts, [len(same)])))
        for k in np.flatnonzero(sizes + period >= max(LEAST, 2 * period)):
            self.add(int(starts[k]), int(sizes[k]) + period, period)

    def extend(self, places: np.ndarray, periods: np.ndarray) -> None:
        order = np.lexsort((places, periods))
        period, end = -1, -1
        for at, q in zip(places[order].tolist(), periods[order].tolist()):
            if q == period and at < end:
                continue
            left, right = _matched(self.words, at, q, False), _matched(self.words, at, q, True)
            period, end = q, at + right
            self.add(at - left, left + right + q, q)


def _next_to_each_other(found: _Found, scale: int) -> tuple[list[int], list[int]]:
    """Seeds from neighbouring runs of one short period: distances in [2 * scale, 4 * scale) at which both are in step."""
    places, periods = [], []
    short = sorted((p, s, n) for s, n, p in found.runs if 3 * p <= scale)
    for (p, start, length), (p_, next_, length_) in zip(short, short[1:]):
        end = start + length
        if p != p_ or next_ > end or min(length, length_) < 2 * scale:
            continue
        words = found.words
        root, other = np.tile(words[end - p : end], 2), words[next_ : next_ + p]
        turns = np.flatnonzero(root[:p] == other[0])
        turn = next((int(k) for k in turns if (root[k : k + p] == other).all()), None)
        if turn is None:
            continue
        q = np.arange(2 * scale + (next_ - end - turn - 2 * scale) % p, 4 * scale, p)
        first = np.maximum(start, next_ - q)
        q, first = (x[np.minimum(end, next_ + length_ - q) - first >= q] for x in (q, first))
        places += first.tolist()
        periods += q.tolist()
    return places, periods


def find(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` in the array of words of documents, the longest document first.

    ``sizes`` are the documents' lengths; after each stands one number that no other place of the array has.
    """
    found = _Found(words)
    bounds = np.cumsum(sizes + 1)
    longest = int(sizes.max(initial=0))
    for period in range(1, min(2 * BASE, longest // 2 + 1)):
        count = int((sizes >= max(LEAST, 2 * period)).sum())
        if count:
            found.words = words[: bounds[count - 1]]
            found.short(period)
    hashes, known, scale = _mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, BASE
    while 4 * scale <= longest:
        count = int((sizes >= 4 * scale).sum())
        found.words = words[: bounds[count - 1]]
        hashes = hashes[: len(found.words) - known + 1]
        while known < scale:
            hashes = _mixed(hashes[:-known] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[known:])
            known *= 2
        own = np.minimum(hashes, NONE - np.uint64(1))
        for start, length, period in found.runs:
            if 3 * period <= scale <= length and start < len(own):
                own[start : start + length - scale + 1] = NONE
        at = minima(own, scale)
        order = np.lexsort((at, own[at]))
        at, values = at[order], own[at][order]
        doc = np.searchsorted(bounds, at, side="right")
        places, periods = _next_to_each_other(found, scale)
        seeds, shifts = [np.array(places, np.int64)], [np.array(periods, np.int64)]
        for lag in range(1, len(at)):
            far = at[lag:] - at[:-lag]
            near = (values[lag:] == values[:-lag]) & (far < 4 * scale)
            if not near.any():
                break
            near &= (far >= 2 * scale) & (doc[lag:] == doc[:-lag])
            seeds.append(at[:-lag][near])
            shifts.append(far[near])
        found.extend(np.concatenate(seeds), np.concatenate(shifts))
        scale *= 2
    return sorted(set(found.runs), key=lambda r: (r[0], r[2]))


def _blocks(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Documents ``(row, words)``, the longest first, in blocks of about BLOCK words."""
    rows = sorted(rows, key=lambda r: -len(r[1]))
    block, size = [], 0
    for row in rows:
        if block and size + len(row[1]) > BLOCK:
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row[1])
    if block:
        yield block


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for block in _blocks([(k, words) for k, words in enumerate(documents) if len(words) >= LEAST]):
        numbers: dict[bytes, int] = {}
        sizes = np.array([len(words) for _, words in block])
        bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        array = np.empty(bounds[-1], np.int32)
        for (_, words), start in zip(block, bounds):
            array[start : start + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
        array[bounds[1:] - 1] = len(numbers) + np.arange(len(block))
        runs = find(array, sizes)
        of = np.searchsorted(bounds, [r[0] for r in runs], side="right") - 1
        for k, own in groupby(zip(of.tolist(), runs), key=lambda x: x[0]):
            out[block[k][0]] = [(s - int(bounds[k]), n, p) for _, (s, n, p) in own]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _runs(prepare: Callable[[object, list[bytes]], list[bytes]] | None, id_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            words = [split_words(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            if prepare is not None and id_at is not None:
                words = [prepare(i, w) for i, w in zip(batch.column(id_at).to_pylist(), words)]
            runs = runs_of(words)
            kept = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs)]
            flat = [x for own in runs for x in own]
            bounds = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32())
            values = pa.StructArray.from_arrays(
                [pa.array([x[f] for x in flat], pa.int64()) for f in range(3)], names=["start", "length", "period"]
            )
            made = [pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(bounds, values), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.record_batch([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "\x00n", "\x00runs", "\x00kept"])  # by place

    return run


def with_runs(docs: DataFrame, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``docs`` with ``_words`` (their number), ``_runs`` (by start, then period) and ``_collapsed`` (the words left, one space between).

    Null and empty texts have no words and no runs. Rows are looked at one by one: repeated rows, null ids and other
    columns stay as they are; if a column has one of the new names, the new one gets another underscore in front.
    ``prepare`` may change a document's words before the search, given its ``doc_id``. A task holds 512 rows of a batch
    and searches up to BLOCK words, or one longer document, at a time.
    """
    names = []
    for name in ("_words", "_runs", "_collapsed"):
        names.append(fresh([*docs.columns, *names], name))
    at = {c.lower(): k for k, c in enumerate(docs.columns)}.get("doc_id")
    plain = docs.withColumn(fresh([*docs.columns, *names], "_text"), docs["text"].cast("string"))
    made = f"`{names[0]}` long, `{names[1]}` array<{RUN}>, `{names[2]}` string"
    return plain.mapInArrow(_runs(prepare, at), f"{kinds(docs)}, {made}")
