"""Benchmark decontamination: an FM-index per shard of training text, searched for the benchmark's phrases.

Documents are read where they lie. A task gathers whole documents until the shard is full, builds one FM-index over it
(suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions), searches all phrases in it
backwards at once, locates every occurrence and merges the spans. Nothing is shuffled.

Words outside the phrases' vocabulary cannot be part of an occurrence: they end a run, and only runs at least as long
as the shortest phrase enter the index. This leaves out no occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.llm.common import fresh, slices
from firmlake.session import discard, settle, work_path
from firmlake.sources.archives import files_of, open_file
from firmlake.sources.tables import folders

WINDOW = 10
SHARD_SYMBOLS = 1 << 19  # an index is built once so many symbols are gathered,
SHARD_BYTES = 32 << 20  # or texts of so many bytes
SAMPLE = 16  # every so many positions are kept with the index
BLOCK_BYTES = 2 << 20  # of benchmark text are searched for in one pass; a worker holds the windows of so much, about a hundred times its size

#: Words are runs of ASCII digits, ASCII letters (in lower case) and bytes of non-ASCII characters.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


class FMIndex:
    """Counts and locates phrases in a sequence of symbols; 0 separates runs, and the last symbol is 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        order = self._suffixes(symbols)
        before = symbols[order - 1]  # the symbol before each suffix; the one before the first is the last, a 0
        top = int(symbols.max(initial=0))
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        kept = (order % sample == 0) | (before == 0)  # a walk back ends at a run's start at the latest
        self.kept, self.kept_before = kept, np.concatenate(([0], np.cumsum(kept)))
        self.kept_at = order[kept]
        self.levels = []  # wavelet matrix: the bits of a level, how many are set before each row, where ones begin
        row = before
        for shift in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (row >> shift) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, bit.astype(bool), ones, n - int(ones[-1])))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.base = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        """Suffix array by doubling; separators differ from each other, so no comparison runs over a run's end."""
        n = len(symbols)
        ends = symbols == 0
        rank = symbols.astype(np.int64) + int(ends.sum())
        rank[ends] = np.arange(int(ends.sum()))
        width = 1
        while True:
            beyond = np.zeros(n, np.int64)
            beyond[:-width] = rank[width:] + 1
            key = rank * (int(rank.max()) + 2) + beyond
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.concatenate(([False], key[order][1:] != key[order][:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
            if int(new[-1]) == n - 1 or width >= n:
                return order

    def _descend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for shift, _, ones, zeros in self.levels:
            up = ones[row]
            row = np.where((symbol >> shift) & 1, zeros + up, row - up)
        return row

    def _rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        return self._descend(symbol, row) - self.base[symbol]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases of one length, a row each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), int(self.starts[-1]), np.int64)
        known = len(self.base)
        live = (phrases < known).all(axis=1)
        high[~live] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            at = np.flatnonzero(low < high)
            c = phrases[at, k]
            low[at] = self.starts[c] + self._rank(c, low[at])
            high[at] = self.starts[c] + self._rank(c, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each row's suffix: walk back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        at, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(at):
            hit = self.kept[row]
            out[at[hit]] = self.kept_at[self.kept_before[row[hit]]] + steps
            at, row = at[~hit], row[~hit]
            symbol, place = np.zeros(len(row), np.int64), row
            for shift, bit, ones, zeros in self.levels:
                b, up = bit[place], ones[place]
                symbol |= b.astype(np.int64) << shift
                place = np.where(b, zeros + up, place - up)
            row = self.starts[symbol] + place - self.base[symbol]
            steps += 1
        return out


class Phrases:
    """The distinct windows of benchmark items, by length, and the items that each belongs to."""

    def __init__(self, items: list[tuple], window: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            own = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                owners.setdefault(tuple(own[k : k + size]), set()).add(item)
        by_size: dict[int, list] = {}
        for phrase, owned in owners.items():
            by_size.setdefault(len(phrase), []).append((phrase, sorted(owned, key=str)))
        self.sizes = {n: (np.array([p for p, _ in x], np.int64), [o for _, o in x]) for n, x in sorted(by_size.items())}

    @property
    def shortest(self) -> int:
        return min(self.sizes, default=0)


class Shard:
    """Documents that are searched together."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.symbols, self.runs = phrases, [], []
        self.filled, self.docs, self.text_bytes = 0, 0, 0
        self.words: list[int] = []

    def add(self, text: str | None) -> None:
        words = words_of(text)
        self.words.append(len(words))
        self.text_bytes += len(text or "")
        least = self.phrases.shortest
        if least and len(words) >= least:
            ids = np.fromiter(map(self.phrases.words.get, words, repeat(0)), np.int32, len(words))
            inside = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
            edge = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
            for a, b in edge[edge[:, 1] - edge[:, 0] >= least].tolist():
                self.runs.append((self.filled, self.docs, a))
                self.symbols += (ids[a:b], np.zeros(1, np.int32))
                self.filled += b - a + 1
        self.docs += 1

    @property
    def full(self) -> bool:
        return self.filled >= SHARD_SYMBOLS or self.text_bytes >= SHARD_BYTES

    def search(self) -> tuple[list[list[tuple[int, int]]], list[list]]:
        """Merged word spans and the items found, per document."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(self.docs)]
        items: list[set] = [set() for _ in range(self.docs)]
        if self.runs:
            text = np.concatenate(self.symbols)
            starts, owner, offset = (np.array(x, np.int64) for x in zip(*self.runs))
            index = FMIndex(text)
            cover = np.zeros(len(text) + 1, np.int64)
            for size, (phrases, owners) in self.phrases.sizes.items():
                low, high = index.find(phrases)
                found = np.flatnonzero(high > low)
                times = (high - low)[found]
                rows = np.repeat(low[found], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                at = index.locate(rows)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                doc = owner[np.searchsorted(starts, at, side="right") - 1]
                pairs = np.unique(np.stack([doc, np.repeat(found, times)], axis=1), axis=0) if len(at) else np.empty((0, 2), int)
                for d, k in pairs.tolist():
                    items[d].update(owners[k])
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0])))).reshape(-1, 2)
            for a, b in edge.tolist():
                k = int(np.searchsorted(starts, a, side="right")) - 1
                spans[owner[k]].append((a - int(starts[k]) + int(offset[k]), b - int(starts[k]) + int(offset[k])))
        return spans, [sorted(x, key=str) for x in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap; spans that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


FOUND = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.int64())),
])
FOUND_SQL = "struct<n_words:bigint,spans:array<struct<begin:bigint,end:bigint>>,items:array<bigint>>"


@lru_cache(maxsize=1)
def _phrases(folder: str | None, window: int) -> Phrases:
    """The phrases of a block of the benchmark, which a worker reads once."""
    rows: list[tuple] = []
    for path in files_of(folder) if folder else ():
        with open_file(path) as f:
            part = pq.read_table(f)
            rows += zip(part.column("i").to_pylist(), part.column("t").to_pylist())
    return Phrases(sorted(rows), window)


def _searcher(folder: str | None, window: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(folder, window)
        shard, held = Shard(phrases), []

        def flush() -> Iterator[pa.RecordBatch]:
            spans, items = shard.search()
            k = 0
            for batch in held:
                out = []
                last = batch.num_columns - 1
                for old in batch.column(last).to_pylist():
                    out.append({
                        "n_words": shard.words[k],
                        "spans": [{"begin": a, "end": b} for a, b in merged(
                            spans[k] + [(s["begin"], s["end"]) for s in (old or {}).get("spans") or []])],
                        "items": sorted({*items[k], *((old or {}).get("items") or [])}, key=str),
                    })
                    k += 1
                yield batch.set_column(last, batch.schema.names[last], pa.array(out, FOUND))

        for batch in slices(batches):
            held.append(batch)
            for text in batch.column(batch.num_columns - 2).to_pylist():
                shard.add(text)
            if shard.full:
                yield from flush()
                shard, held = Shard(phrases), []
        if held:
            yield from flush()

    return search


def benchmark_blocks(items: DataFrame) -> list[str | None]:
    """Folders with about BLOCK_BYTES of the benchmark's items each, written by Spark to the shared folder.

    The driver gets their number only. Without items there is one block, of nothing.
    """
    items = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    items = items.where("i is not null and t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    if not blocks:
        return [None]
    place = work_path(items.sparkSession, "benchmark")
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).alias("block")
    items.select("i", "t", block).repartition(blocks, "block").write.partitionBy("block").parquet(place)
    return [f"{place}/{name}" for name in sorted(folders(items.sparkSession, place)) if name.startswith("block=")]


def find_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` with a last column ``_found``: number of words, merged word spans [begin, end) and item ids.

    A phrase is each run of ``window`` words of an item, or the whole item if it has fewer; items without words, with a
    null id or a null text have none. A null or empty text has no words. Repeated rows are searched each. Benchmarks
    above BLOCK_BYTES are searched in several passes over the documents, each with the phrases of one block, which tasks read
    from the shared folder; the driver holds none of them. If the
    documents have a column of that name, the new one gets another underscore in front.
    """
    found, plain, passes = _passes(docs, items, window, text)
    return found.mapInArrow(passes[-1], found.schema).drop(plain)


def _passes(docs: DataFrame, items: DataFrame, window: int, text: str) -> tuple[DataFrame, str, list]:
    """The documents with a column for the plain text and one for what all blocks but the last found, the former's name, the searches.

    What a pass found is written out before the next one, so that a worker holds the phrases of one block.
    """
    found = fresh(docs.columns, "_found")
    plain = fresh([*docs.columns, found], "_text")
    out = docs.withColumn(plain, F.col(text).cast("string")).withColumn(found, F.lit(None).cast(FOUND_SQL))
    passes = [_searcher(folder, window) for folder in benchmark_blocks(items)]
    for k, search in enumerate(passes[:-1]):
        before, out = out, settle(out.mapInArrow(search, out.schema), "found")
        if k:
            discard(before)
    return out, plain, passes


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between words of one span."""
    raw = text.encode("utf-8", "replace")
    plain = np.frombuffer(b" " + raw.translate(WORD_BYTES) + b" ", np.uint8) != 32
    edge = np.flatnonzero(np.diff(plain.astype(np.int8))).reshape(-1, 2)  # begin and end of each word
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : edge[a, 0]])
        last = int(edge[b - 1, 1])
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def remove_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the benchmark's words, all columns; a document that loses all its words goes.

    ``n_chars``, where there is one, follows the text.
    """
    names = docs.columns
    at = [n.lower() for n in names].index("text")
    size = next((k for k, n in enumerate(names) if n.lower() == "n_chars"), None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keep = batch.column(at).to_pylist(), []
            sizes = batch.column(size).to_pylist() if size is not None else []
            for k, f in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spans = [(s["begin"], s["end"]) for s in f["spans"]]
                if spans:
                    texts[k] = cut_words(texts[k], spans)
                    if sizes:
                        sizes[k] = len(texts[k])
                keep.append(f["n_words"] > sum(b - a for a, b in spans) or not spans)
            columns = list(batch.columns[:-2])
            columns[at] = pa.array(texts, columns[at].type)
            if sizes:
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.record_batch(columns, names=names).filter(pa.array(keep, pa.bool_()))

    found, _, passes = _passes(docs, items, window, "text")
    last = passes[-1]
    # The last search and the cut share a worker.
    return found.mapInArrow(lambda batches: cut(last(batches)), docs.schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every document.

    The digest is that of the item ids, sorted as strings and joined by commas; without items, of the empty text.
    """
    found = find_phrases(docs.select("doc_id", "text"), items, window)
    ids = F.array_sort(F.transform("_found.items", lambda x: x.cast("string")))
    hit = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
