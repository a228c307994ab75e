"""BPE encoding by speculation and verification, and decoding.

A text is normalized and cut into words; a task keeps the words it has encoded, up to a bound. Speculate: a greedy longest
match over the vocabulary proposes tokens for all new words of a batch. Verify: all distinct pairs of adjacent tokens
are tested together in numpy. A sequence is what merging yields exactly when every token of it is what its own
characters merge to, and no two neighbours would have merged across their border; whether they would depends on the two
tokens alone. Only words with a token or a pair that fails are merged exactly, step by step.

Whether a border is crossed follows from the pieces that touch it. While the left token grows from its last character,
the piece that ends at the border is replaced at the ranks of its right spine; likewise the left spine of the right
token. Two touching pieces merge across the border if their merge ranks before the next growth of the left one, and not
after that of the right one (of equal merges the leftmost goes first).

Vocabularies of the ``tokenizers`` library with word ends are read from their JSON file; the path is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.llm.common import fresh, kinds, slices

NEVER = np.int64(1 << 40)
TOKEN_BITS = 24
TOKEN_MASK, NO_MERGE = (1 << TOKEN_BITS) - 1, 1 << 60  # a merge is a rank above the token it makes
LONG = 256  # symbols above which words are merged with a heap
MOST_WORDS = 1 << 17  # encoded words of a generation; a task keeps two generations

#: Fixed values of the vocabulary's kind: how it cuts a text into words, and its word end.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
WORD_END = "</w>"
_WORD = regex.compile(WORD_PATTERN)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or spec.get("decoder"):
            raise ValueError("this reader is for BPE vocabularies with word ends and without a decoder")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letter_table = {b: letter for b, letter in enumerate(byte_letters()) if chr(b) != letter}
        self.longest = max(map(len, self.ids))
        self.reach: dict[str, int] = {}  # length of the longest token that begins with two letters
        for token in self.ids:
            if not token.endswith(WORD_END):
                self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 1))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._tables(merges)

    def _tables(self, merges: list[tuple[str, str]]) -> None:
        size = max(self.strings) + 1
        left, right, rank = np.full(size, -1), np.full(size, -1), np.full(size, NEVER)
        self.width = np.int64(size)
        self.merge_rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair, whole = (self.ids[a], self.ids[b]), self.ids[a + b]
            if pair not in self.merge_rank:
                self.merge_rank[pair] = (r, whole)
                if rank[whole] == NEVER:
                    left[whole], right[whole], rank[whole] = *pair, r
        self.merge_code = {pair: r << TOKEN_BITS | whole for pair, (r, whole) in self.merge_rank.items()}
        keys = np.array([a * size + b for a, b in self.merge_rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.merge_rank.values()], np.int64)[order]
        self.rank = rank
        self.left_spine, self.right_spine = self._spine(left), self._spine(right)
        # A token is what its characters merge to if that holds for its parts and nothing crosses between them earlier.
        self.sound = np.ones(size, bool)
        made = np.argsort(rank, kind="stable")[: int((rank < NEVER).sum())]
        early = self.crossed(left[made], right[made], rank[made])
        for token, bad in zip(made.tolist(), early.tolist()):
            self.sound[token] = not bad and self.sound[left[token]] and self.sound[right[token]]

    @staticmethod
    def _spine(child: np.ndarray) -> np.ndarray:
        """For each token, the pieces at one of its edges from the smallest to the whole, the whole repeated at the end."""
        rows = [np.arange(len(child))]
        while True:
            down = np.where(child[rows[-1]] >= 0, child[rows[-1]], rows[-1])
            if (down == rows[-1]).all():
                break
            rows.append(down)
        spine = np.stack(rows[::-1], axis=1)
        depth = (spine[:, 1:] != spine[:, :-1]).sum(axis=1)
        shift = np.minimum(spine.shape[1] - 1 - depth[:, None] + np.arange(spine.shape[1] + 1), spine.shape[1] - 1)
        return np.take_along_axis(spine, shift, axis=1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def crossed(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For pairs of tokens: does a merge cross the border (if ``before`` is given, one of a lower rank)?"""
        out = np.zeros(len(a), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        at = np.arange(len(a))
        while len(at):
            x, y = self.right_spine[a[at], i[at]], self.left_spine[b[at], j[at]]
            up, over = self.right_spine[a[at], i[at] + 1], self.left_spine[b[at], j[at] + 1]
            grow_x = np.where(up == x, NEVER, self.rank[up])
            grow_y = np.where(over == y, NEVER, self.rank[over])
            r = self.pair_ranks(x, y)
            if before is not None:
                r = np.where(r < before[at], r, NEVER)
            out[at] = (r < NEVER) & (r < grow_x) & (r <= grow_y)
            step_x = grow_x <= grow_y
            i[at] += step_x
            j[at] += ~step_x
            at = at[~out[at] & (np.minimum(grow_x, grow_y) < NEVER)]
        return out

    def greedy(self, symbols: str) -> list[int]:
        """Longest match first; ``symbols`` is a word in byte letters. The word's last token carries the word end."""
        get, reach, out, at, n = self.ids.get, self.reach.get, [], 0, len(symbols)
        while at < n:
            if n - at <= self.longest and (token := get(symbols[at:] + WORD_END)) is not None:
                out.append(token)
                break
            end = min(n - 1, at + reach(symbols[at : at + 2], 1))
            while (token := get(symbols[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def merge(self, symbols: str) -> list[int]:
        """Exact merging: the lowest rank first, of equal ones the leftmost."""
        ids = self.ids
        parts = [ids[c] for c in symbols[:-1]] + [ids[symbols[-1] + WORD_END]]
        return self._merge_short(parts) if len(parts) <= LONG else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        get = self.merge_code.get
        codes = [get(p, NO_MERGE) for p in zip(parts, parts[1:])]
        while codes and (least := min(codes)) < NO_MERGE:
            k = codes.index(least)
            parts[k : k + 2] = [least & TOKEN_MASK]
            del codes[k]
            if k:
                codes[k - 1] = get((parts[k - 1], parts[k]), NO_MERGE)
            if k < len(codes):
                codes[k] = get((parts[k], parts[k + 1]), NO_MERGE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        get, n = self.merge_code.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, k) for k, p in enumerate(zip(parts, parts[1:])) if (c := get(p, NO_MERGE)) < NO_MERGE]
        heapq.heapify(heap)
        while heap:
            code, k = heapq.heappop(heap)
            m = after[k]
            if parts[k] < 0 or m >= n or get((parts[k], parts[m]), NO_MERGE) != code:
                continue  # one of the two has been merged since
            parts[k], parts[m], after[k] = code & TOKEN_MASK, -1, after[m]
            if after[k] < n:
                before[after[k]] = k
                if (c := get((parts[k], parts[after[k]]), NO_MERGE)) < NO_MERGE:
                    heapq.heappush(heap, (c, k))
            if before[k] >= 0 and (c := get((parts[before[k]], parts[k]), NO_MERGE)) < NO_MERGE:
                heapq.heappush(heap, (c, before[k]))
        return [p for p in parts if p >= 0]

    def symbols(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letter_table)

    def propose(self, words: list[str]) -> list[list[int]]:
        """Token ids of distinct words: greedy proposals, of which those that fail the test are merged exactly."""
        symbols = [self.symbols(w) for w in words]
        proposed = [self.greedy(x) for x in symbols]
        flat = np.array([t for p in proposed for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), [len(p) for p in proposed])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inside] * self.width + flat[inside + 1], return_inverse=True)
        bad = self.crossed(pairs // self.width, pairs % self.width)
        failing = np.union1d(owner[inside][bad[back]], owner[~self.sound[flat]]).tolist()
        for k in failing:
            proposed[k] = self.merge(symbols[k])
        self.verified, self.merged = getattr(self, "verified", 0) + len(words), getattr(self, "merged", 0) + len(failing)
        return proposed

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        return [tuple(p) for p in self.propose(words)]


def normalize(text: str) -> str:
    """NFC and lower case of each character by itself. White space stays: no word holds any, so its form has no effect."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


class Encoder:
    """Encodes and decodes whole texts; keeps the words it has seen, up to a bound."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.names = [self.vocabulary.strings.get(i, "") for i in range(max(self.vocabulary.strings) + 1)]
        self.known: dict[str, bytes] = {}  # ids of words
        self.older: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Have all words in ``known``. When it is full it becomes the older generation, from which used words come back."""
        if len(self.known) > MOST_WORDS:
            self.known, self.older = {}, self.known
        missing = words.difference(self.known)
        new, older = [], self.older
        for word in missing:
            if (kept := older.get(word)) is None:
                new.append(word)
            else:
                self.known[word] = kept
        if not new:
            return
        found = self.vocabulary.propose(new)
        packed = np.array([t for ids in found for t in ids], "<u4").tobytes()
        at = 0
        for word, ids in zip(new, found):
            end = at + 4 * len(ids)
            self.known[word] = packed[at:end]
            at = end

    def split(self, text: str | None) -> list[tuple[str, bool]]:
        """Words and special tokens (marked) of a text, in order."""
        if not text:
            return []
        special = self.vocabulary.cut_special
        if special is None or not any(s in text for s in self.vocabulary.special):
            return [(w, False) for w in _WORD.findall(normalize(text))]
        out = []
        for k, part in enumerate(special.split(text)):
            out += [(part, True)] if k % 2 else [(w, False) for w in _WORD.findall(normalize(part))]
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers of each text, and the text that these ids decode to."""
        special = self.vocabulary.special
        plain = [None if t and special and any(s in t for s in special) else _WORD.findall(normalize(t)) if t else [] for t in texts]
        split = {k: self.split(texts[k]) for k, p in enumerate(plain) if p is None}
        words = set().union(*[p for p in plain if p is not None]) if plain else set()
        words.update(w for s in split.values() for w, marked in s if not marked)
        self._learn(words)
        known = self.known
        for k, p in enumerate(plain):
            if p is None:
                ids = b"".join([np.array([special[w]], "<u4").tobytes() if marked else known[w] for w, marked in split[k]])
            else:
                ids = b"".join([known[w] for w in p])
            yield ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings joined by spaces, as a vocabulary without a decoder does; nothing but the ids is looked at."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str) -> Encoder:
    """The file may have been sent with ``addFile`` or lie on every machine."""
    return Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


PART = 64  # texts that are encoded together


def _encoding(path: str, names: list[str] | None):
    """Per row ``n_tokens, ids, decoded``, after the columns named; without names, digests after ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)  # of this task: a worker that goes on with other stages does not keep its words
        for batch in slices(batches, PART):
            found = own.encode(batch.column(batch.num_columns - 1).to_pylist())
            if names is None:
                rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(),
                         hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest()) for i, d in found]
                n, one, two = zip(*rows)
                yield pa.record_batch(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                ids, decoded = zip(*found)
                yield pa.record_batch(
                    [*batch.columns[:-1], pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())),
                     pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(decoded, pa.string())],
                    names=names,
                )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with last columns ``n_tokens, token_ids, ids_sha256, decoded``.

    A null or empty text has no tokens and decodes to the empty text. If the documents have columns of these names, the
    new ones get an underscore in front.
    """
    new = [fresh(docs.columns, n) for n in ("n_tokens", "token_ids", "ids_sha256", "decoded")]
    plain = docs.withColumn(fresh([*docs.columns, *new], "_text"), F.col("text").cast("string"))
    added = ", ".join(f"`{n}` {t}" for n, t in zip(new, ("long", "array<int>", "string", "string")))
    return plain.mapInArrow(_encoding(path, [*docs.columns, *new]), f"{kinds(docs)}, {added}")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row's whole text."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _encoding(path, None), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def decode(rows: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``rows`` with a last column ``decoded``, from the ids alone; null and empty lists decode to the empty text.

    If the rows have a column of that name, the new one gets an underscore in front. An id outside the vocabulary is an error.
    """
    new, plain = fresh(rows.columns, "decoded"), fresh(rows.columns, "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches):
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = [own.decode(np.array(x, "<u4").tobytes()) if x else "" for x in lists]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "\x00decoded"])  # by place

    return rows.withColumn(plain, F.col(ids).cast("array<long>")).mapInArrow(run, f"{kinds(rows)}, `{new}` string")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256`` of every row's whole text."""
    out = encode(docs.select("doc_id", "text"), path)
    return out.select("doc_id", "n_tokens", "token_ids", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
