"""Language of a text: a bidirectional gated recurrent network over bytes labels every position, documents pool the labels.

A text's UTF-8 bytes are cut into segments of SEGMENT bytes. One recurrence reads a segment forwards, another one
backwards; from both states a linear layer gives every byte a probability per language. A document's probabilities are the
means over all its bytes; whole texts are read. The network is trained by backpropagation through time on a bounded
sample: up to SAMPLE documents in all, the same number of each language, chosen by the hash of their id, with up to PIECES
segments from all over each. Documents whose crc32(doc_id) leaves HELD_OUT when divided by FOLDS are never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlake.llm.common import fresh, kinds, slices
from firmlake.session import discard, settle

SAMPLE = 1200  # documents the network is trained on, at most (one of each language at least)
PIECES = 6  # segments of each of them, at most
SEGMENT = 64
HIDDEN = 12  # numbers in the state of either direction
EPOCHS = 4
TRAIN_BATCH = 64
BATCH = 512  # segments that are read in step
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
PAD = 256  # closes both gates: the state after it is zero, as if nothing had been read


class Network:
    """``inputs`` (direction, gate, byte, state), ``steps`` (direction, gate, state, state), ``out`` and ``bias``.

    The gates are update, reset and candidate. The first two are kept at half their size: s(x) = tanh(x / 2) / 2 + 1 / 2.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.inputs = rng.normal(0, 0.3, (2, 3, PAD + 1, hidden)).astype(np.float32)
        self.inputs[:, :2, PAD], self.inputs[:, 2, PAD] = -30, 0
        self.steps = (rng.normal(0, 1, (2, 3, hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.out = (rng.normal(0, 1, (2, hidden, len(labels))) / np.sqrt(2 * hidden)).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.steps, self.out, self.bias]

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, direction, row, state) after each byte of ``x`` (time, row); ``keep`` gets what training needs."""
        time, rows = x.shape
        hidden = self.out.shape[1]
        out = np.empty((time, 2, rows, hidden), self.inputs.dtype)
        gates = np.empty((2, 3, rows, hidden), out.dtype)
        old = np.zeros((2, rows, hidden), out.dtype)
        for t in range(time):
            np.take(self.inputs[0], x[t], axis=1, out=gates[0], mode="clip")
            np.take(self.inputs[1], x[time - 1 - t], axis=1, out=gates[1], mode="clip")
            moved = np.matmul(old[:, None], self.steps)
            both, new = gates[:, :2], gates[:, 2]
            both += moved[:, :2]
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            own = moved[:, 2]
            if keep is not None:
                held = own.copy()
            own *= both[:, 1]
            new += own
            np.tanh(new, out=new)
            state = out[t]
            np.subtract(old, new, out=state)
            state *= both[:, 0]
            state += new
            if keep is not None:
                keep.append((old, gates.copy(), held))
            old = state
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (time, row, label) from the states: the backward ones stand in reverse."""
        z = states[:, 0] @ self.out[0]
        z += states[::-1, 1] @ self.out[1]
        z += self.bias
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=-1, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the bytes of ``x`` (time, row) whose rows have ``labels``, and its gradients, through all time."""
        keep: list = []
        states = self.states(x, keep)
        p = self.probabilities(states)
        real = x != PAD
        count = max(int(real.sum()), 1)
        each = np.arange(x.shape[1])
        loss = -float(np.log(np.maximum(p[:, each, labels], 1e-30))[real].sum()) / count
        p[:, each, labels] -= 1
        p *= (real / count)[:, :, None].astype(p.dtype)
        out = np.stack([np.einsum("trh,trk->hk", states[:, 0], p), np.einsum("trh,trk->hk", states[::-1, 1], p)])
        bias = p.sum(axis=(0, 1))
        steps, time = np.zeros_like(self.steps), len(x)
        slopes = np.empty((time, 2, 3, x.shape[1], self.out.shape[1]), p.dtype)
        back = np.zeros_like(states[0])
        for t in range(time - 1, -1, -1):
            old, gates, held = keep[t]
            update, reset, new = gates[:, 0], gates[:, 1], gates[:, 2]
            back[0] += p[t] @ self.out[0].T
            back[1] += p[time - 1 - t] @ self.out[1].T
            d = slopes[t]
            d[:, 2] = back * (1 - update) * (1 - new * new)
            d[:, 0] = back * (old - new) * update * (1 - update) * 2  # twice, as the gate is kept at half its size
            d[:, 1] = d[:, 2] * held * reset * (1 - reset) * 2
            moved = d.copy()
            moved[:, 2] *= reset
            steps += np.matmul(old[:, None].swapaxes(-1, -2), moved)
            back = back * update + np.matmul(moved, self.steps.swapaxes(-1, -2)).sum(axis=1)
        inputs = np.zeros_like(self.inputs)
        for direction in (0, 1):
            read = (x if direction == 0 else x[::-1]).ravel()
            order = np.argsort(read, kind="stable")
            values, first = np.unique(read[order], return_index=True)
            flat = slopes[:, direction].transpose(1, 0, 2, 3).reshape(3, len(read), -1)
            inputs[direction][:, values] = np.add.reduceat(flat[:, order], first, axis=1)
        inputs[:, :, PAD] = 0
        return loss, [inputs, steps, out, bias]

    def train(self, x: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over batches in an order that the seed settles; the rate falls to zero."""
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        total, step = epochs * -(-len(labels) // TRAIN_BATCH), 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for start in range(0, len(order), TRAIN_BATCH):
                rows = order[start : start + TRAIN_BATCH]
                _, slopes = self.gradients(x[:, rows], labels[rows])
                size = np.sqrt(sum(float((g * g).sum()) for g in slopes))
                step += 1
                speed = rate * (1 - (step - 1) / total)
                for p, g, m, v in zip(self.parameters(), slopes, first, second):
                    g *= min(1.0, 1.0 / max(size, 1e-12))
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def label_positions(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For blocks of segments: their numbers, their lengths and the probabilities (time, segment, label) of their bytes."""
        starts, sizes = segments([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        order = np.argsort(-sizes, kind="stable")
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            yield rows, sizes[rows], self.probabilities(self.states(laid_out(data, starts[rows], sizes[rows])))

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (text, label) over all bytes of each text; of an empty one all the same."""
        sizes = np.array([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), -(-sizes // SEGMENT))
        total = np.zeros((len(texts), len(self.labels)))
        for rows, own, p in self.label_positions(texts):
            read = np.arange(len(p))[:, None] < own
            np.add.at(total, owner[rows], np.einsum("trk,tr->rk", p, read.astype(p.dtype)).astype(float))
        total[sizes == 0] = 1
        return total / total.sum(axis=1, keepdims=True)


def segments(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the texts laid end to end) and lengths of the segments of texts with these numbers of bytes."""
    each = np.array(sizes, np.int64)
    count = -(-each // SEGMENT)
    owner = np.repeat(np.arange(len(each)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(each) - each
    return begin[owner] + number * SEGMENT, np.minimum(each[owner] - number * SEGMENT, SEGMENT)


def laid_out(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes (time, segment) of segments, filled up with PAD to the longest."""
    at = np.arange(int(sizes.max(initial=0)))[:, None]
    x = np.full((len(at), len(starts)), PAD, np.intp)
    inside = at < sizes
    x[inside] = data[(at + starts)[inside]]
    return x


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to PIECES segments from all over each text."""
    for batch in slices(batches, 64):
        out = []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            count = -(-len(data) // SEGMENT)
            for k in sorted({j * count // PIECES for j in range(PIECES)}):
                out.append((label, data[k * SEGMENT : (k + 1) * SEGMENT]))
        yield pa.record_batch([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], names=["lang", "piece"])


def training_pieces(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bytes (time, row), label numbers and labels, languages in alphabetical order.

    The driver gets up to PIECES * SEGMENT bytes of each of ``max(sample, number of languages)`` documents. Of several
    documents with one id, or one with several languages, the least language and text are taken.
    """
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(~held_out() & F.col("lang").isNotNull() & has_letter(F.col("text")))
    ids = settle(known.select("doc_id", "lang").distinct(), "language-ids")
    sizes = ids.groupBy("lang").agg(F.count("*").alias("_size"))
    count = sizes.count()
    if not count:
        return np.empty((0, 0), np.intp), np.empty(0, np.int64), []
    each = max(1, sample // count)
    # Of each language about four times as many ids as are wanted, by their hash: so few meet in the task that ranks them.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20) < F.lit(4.0 * each) / F.col("_size")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    near = ids.join(F.broadcast(sizes), "lang").where(part | (F.col("_size") <= 8 * each))  # a row per learned language is sent
    chosen = near.withColumn("_rank", rank).where(F.col("_rank") <= each).select(F.col("doc_id").alias("_id")).distinct()
    chosen = settle(chosen, "language-sample")
    rows = known.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("least"))
    cut = settle(rows.select("least.lang", "least.text").mapInArrow(_pieces, "lang string, piece binary"), "language-pieces")
    found = sorted((r["lang"], bytes(r["piece"])) for r in cut.collect())
    discard(ids, chosen, cut)
    labels = sorted({lang for lang, _ in found})
    sizes = np.array([len(p) for _, p in found])
    x = laid_out(np.frombuffer(b"".join(p for _, p in found), np.uint8), np.cumsum(sizes) - sizes, sizes)
    return x, np.array([labels.index(lang) for lang, _ in found]), labels


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """A trained network; with one language only, or none, it has nothing to learn and is left as it is."""
    x, y, labels = training_pieces(docs, sample)
    network = Network(labels)
    if len(labels) > 1:
        network.train(x, y)
    return network


def _scorer(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lettered = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(batch.num_columns - 2).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            own = [k for k, ok in enumerate(lettered) if ok and network.labels]
            if own:
                pooled = network.pool([texts[k].encode("utf-8", "surrogatepass") for k in own])
                for k, best, score in zip(own, pooled.argmax(axis=1), pooled.max(axis=1)):
                    langs[k], scores[k] = network.labels[best], round(float(score), 6)
            made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.record_batch([*batch.columns[:-2], *made], names=[*batch.schema.names[:-2], "\x00lang", "\x00score"])  # by place

    return run


def with_language(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with ``_language`` and ``_certainty``: the likeliest language and its pooled probability, six decimals.

    A text that is null or has no letter is ``und`` with 0; so is every text if nothing was learned. With one learned
    language, it is that one with 1. If the documents have columns of those names, the new ones get underscores in front.
    """
    lang = fresh(docs.columns, "_language")
    score = fresh([*docs.columns, lang], "_certainty")
    text = fresh([*docs.columns, lang, score], "_text")
    plain = docs.withColumn(text, docs["text"].cast("string"))
    plain = plain.withColumn(fresh(plain.columns, "_lettered"), has_letter(F.col(text)))
    return plain.mapInArrow(_scorer(network), f"{kinds(docs)}, `{lang}` string, `{score}` double")


def _spans(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            starts, _ = segments([len(t) for t in texts])
            label = np.zeros(sum(map(len, texts)), np.int64)
            for rows, own, p in network.label_positions(texts) if network.labels else ():
                at = np.arange(len(p))[:, None]
                inside = at < own
                label[(at + starts[rows])[inside]] = p.argmax(axis=2)[inside]
            out, base = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                mine = label[base : base + len(text)]
                cuts = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), len(text)]
                if len(text) and network.labels:
                    out += [(doc_id, a, b, network.labels[mine[a]]) for a, b in zip(cuts, cuts[1:])]
                base += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["doc_id", "start", "stop", "lang"]) if out else pa.record_batch(
                [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["doc_id", "start", "stop", "lang"])

    return run


def language_spans(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, start, stop, lang``: stretches of bytes (of the UTF-8 text) with one label, in texts that are not empty."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_spans(network), "doc_id long, start long, stop long, lang string")


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, by a network that is trained on the others. A null id counts as held out."""
    scored = with_language(docs.select("doc_id", "text"), fit(docs))
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), F.col("_language").alias("lang_pred"), F.col("_certainty").alias("score")
    )
