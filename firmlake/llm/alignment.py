"""Alignment of two tokenizers over a corpus: which tokens of one end where tokens of the other end, and how often.

Equal texts are tokenised once: documents are shuffled by their full text and counted. For each distinct text the byte
offsets at which tokens of A (byte-level) and of B (pieces) both end cut the tokens into groups; the last tokens of a
group are linked. Links of a text are added up by pair of ids there, and then over the corpus, each text as often as
documents have it. What a document's links count for is joined to each text, and the texts' measures to the documents by
SHA-256 of the text, which spares a second shuffle of the texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlake.llm.common import fresh, slices
from firmlake.session import settle

PAIRS = 500_000  # rows of the table of pair counts (17 bytes each) up to which it is broadcast; larger ones are joined by a shuffle
# Fixed value: how byte-level vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ALIGNED = "key binary, times long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, links array<long>"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Bytes:
    """The bytes of every token of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        return self.all[np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Tokens:
    """Both tokenizers, and the bytes of each of their tokens. ``a`` is a vocabulary in JSON, ``b`` a piece model."""

    def __init__(self, a: str, b: bytes):
        from sentencepiece import SentencePieceProcessor

        names, encode = _ranked(a) or _library(a)
        self.encode_a, self.a = encode, Bytes(names)
        self.b_model = SentencePieceProcessor(model_proto=b)
        pieces = [(self.b_model.id_to_piece(i), self.b_model.is_byte(i)) for i in range(self.b_model.get_piece_size())]
        self.b = Bytes([bytes([int(p[3:-1], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B for each text; none at all if the tokens' bytes do not add up to a space and the text."""
        whole = [b" " + t.encode() for t in texts]
        all_a = [np.array(x, np.int64) for x in self.encode_a([" " + t for t in texts])]
        all_b = [np.array(x, np.int64) for x in self.b_model.encode(texts, num_threads=1)]
        for k, (text, a, b) in enumerate(zip(whole, all_a, all_b)):
            size = len(text)
            if not (size == self.a.sizes[a].sum() == self.b.sizes[b].sum() and self.a.joined(a).tobytes() == text == self.b.joined(b).tobytes()):
                all_a[k] = all_b[k] = np.empty(0, np.int64)
        return all_a, all_b

    def align(self, all_a: list[np.ndarray], all_b: list[np.ndarray]) -> list[pa.Array]:
        """Columns from ``n_a`` to ``links`` of ALIGNED for texts with these ids, all texts in one pass.

        The texts are laid end to end: a text's tokens of A and of B have as many bytes, so both end together there.
        """
        n_a, n_b = (np.array([len(x) for x in own], np.int64) for own in (all_a, all_b))
        a, b = (np.concatenate([np.empty(0, np.int64), *own]) for own in (all_a, all_b))
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        total = int(ends_a[-1]) + 1 if len(a) else 1
        in_a, in_b = np.zeros(total, bool), np.zeros(total, bool)
        in_a[ends_a], in_b[ends_b] = True, True
        last_a, last_b = np.flatnonzero(in_b[ends_a]), np.flatnonzero(in_a[ends_b])  # the last tokens of each group
        doc = np.repeat(np.arange(len(n_a)), n_a)[last_a]
        n_groups = np.bincount(doc, minlength=len(n_a))
        sides = []
        for ids, last in ((a, last_a), (b, last_b)):
            cuts = pa.array(np.concatenate(([0], last + 1)), pa.int32())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(cuts, pa.array(ids).cast(pa.string())), ","))
        cuts = pa.array(np.concatenate(([0], np.cumsum(n_groups))), pa.int32())
        groups = pc.binary_join(pa.ListArray.from_arrays(cuts, pc.binary_join_element_wise(*sides, "|")), ";")
        space = len(self.a.sizes) * len(self.b.sizes)
        found, times = np.unique(doc * space + a[last_a] * len(self.b.sizes) + b[last_b], return_counts=True)
        pair = found % space
        pair = (pair // len(self.b.sizes)) << 32 | pair % len(self.b.sizes)
        cuts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(found // space, minlength=len(n_a))))), pa.int32())
        return [pa.array(n_a), pa.array(n_b), pa.array(n_groups), groups, pa.ListArray.from_arrays(cuts, pa.array(pair)), pa.ListArray.from_arrays(cuts, pa.array(times))]


def _library(a: str) -> tuple[list[bytes], Callable]:
    """Token bytes and encoder of a byte-level vocabulary, by the library it was written for."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(a)
    own.encode_special_tokens = True  # their strings in a text are text
    own.no_truncation()
    own.no_padding()
    letters = byte_letters()
    special = {i for i, t in own.get_added_tokens_decoder().items() if t.special}
    names = {i: name for name, i in own.get_vocab(with_added_tokens=True).items()}
    tokens = [names.get(i, "").encode() if i in special else bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
    return tokens, lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def _ranked(a: str) -> tuple[list[bytes], Callable] | None:
    """The same by ranks, several times as fast, where ids follow the order of merges and nothing else shapes the text."""
    import tiktoken

    whole = json.loads(a)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    special = {t["content"] for t in whole.get("added_tokens", []) if t.get("special")}
    vocabulary = {n: i for n, i in model["vocab"].items() if n not in special}
    plain = (
        model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and whole.get("normalizer") is None and all(t.get("special") for t in whole.get("added_tokens", []))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and sorted(vocabulary.values()) == list(range(256 + len(merges)))
        and [vocabulary.get(x + y) for x, y in merges] == list(range(256, 256 + len(merges)))
    )
    if not plain:
        return None
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in n): i for n, i in vocabulary.items()}
    own = tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
    return tokens, lambda texts: [own.encode_ordinary(t) for t in texts]


@lru_cache(maxsize=1)
def _tokens(a: str, b: bytes) -> Tokens:
    return Tokens(a, b)


def _aligner(a: str, b: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokens = _tokens(a, b)
        for batch in slices(batches, 64):
            made = tokens.align(*tokens.encode(batch.column(1).to_pylist()))
            yield pa.record_batch([batch.column(0), batch.column(2), *made], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def align_texts(docs: DataFrame, a: str, b: bytes) -> DataFrame:
    """A row per distinct text: ``key`` (its SHA-256), ``times`` (documents with it), numbers of tokens and groups, ``groups``
    (``a1,a2|b1;a3|b2,b3``), ``pairs`` (linked ids, ``A * 2**32 + B``) and ``links`` (how often each).

    ``a`` is the text of a byte-level vocabulary, ``b`` the content of a piece model. Null and empty texts have no row.
    Texts that either tokenizer changes have no tokens.
    """
    text = docs["text"].cast("string")
    distinct = docs.select(text.alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("times"))
    return distinct.select(text_key(F.col("text")).alias("key"), "text", "times").mapInArrow(_aligner(a, b), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: links of all documents that hold the pair, and whether no other pair of its B id has more."""
    each = aligned.select("times", F.explode(F.arrays_zip("pairs", "links")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.links") * F.col("times")).alias("count"))
    counts = settle(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row per id of B's vocabulary
    return settle(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, a: str, b: bytes, keep: Callable[[Column], Column] = lambda groups: groups, broadcast_pairs: int = PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for every row of ``docs``.

    ``n_best`` are the links whose pair is the most frequent one of its B id, ties included; ``count_sum`` adds up the
    frequencies of all links. Documents without tokens (see ``align_texts``) have zeros and an empty text. Repeated rows
    count each, and each has its row. ``keep`` says what to keep of ``groups``, such as a digest: it is written out once.
    """
    aligned = align_texts(docs, a, b)
    aligned = settle(aligned.withColumn("groups", F.when(F.col("n_groups") > 0, keep(F.col("groups"))).otherwise("")), "aligned")
    counts = pair_counts(aligned)
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    sums = links.join(counts, "pair").groupBy("key").agg(
        F.sum("links").alias("n_links"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("count")).alias("count_sum"),
    )
    measures = aligned.select("key", "n_a", "n_b", "n_groups", "groups").join(sums, "key", "left")
    # Rows without a text are dealt by their id: no text has a key of eight bytes or fewer.
    text = docs["text"].cast("string")
    key = fresh(measures.columns, "_key")
    rows = docs.select("doc_id", F.when(text != "", text_key(text)).otherwise(F.unhex(F.hex(F.col("doc_id").cast("long")))).alias(key))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.join(measures, F.col(key) == F.col("key"), "left").select("doc_id", *numbers, F.coalesce("groups", F.lit("")).alias("groups"))
