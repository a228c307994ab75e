"""Near-duplicates by one-permutation MinHash with optimal densification.

1. Each document becomes the set of its five-word shingles (64-bit hashes). One hash function deals the shingles to
   BINS bins, a bin keeps its least value, and an empty bin copies the bin that a fixed pseudo-random sequence of its own
   names first among the filled ones. Documents with equal sets form a class; from here on classes are compared.
2. Bins are banded ROWS at a time. In each bucket the least class is the hub, and every other class gets one edge to it:
   a bucket of n classes yields n - 1 candidate edges.
3. Each edge is confirmed on the full sets: 100 * intersection >= 75 * union.
4. Confirmed links give components, by alternating stars.
5. A star can miss a link between two classes that are both unlike the hub. So components that a rejected edge ties
   together (families) are searched once more, in blocks: classes of different components whose signatures agree in
   nearly three quarters of the bins are confirmed on the full sets as well, and their links merge components. Groups of
   copies that are linked already, the usual case, cost nothing here.

With BANDS bands of ROWS rows, a pair at the threshold shares no bucket with probability (1 - 0.75^4)^48 = 1.2e-8; the
agreement asked for in step 5 lies four and a half standard deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.llm.common import fresh, slices
from firmlake.llm.components import components, settle_rows
from firmlake.session import discard, settle

SHINGLE = 5
ROWS, BANDS = 4, 48
BINS = ROWS * BANDS
SHARE = (75, 100)
ATTEMPTS = 1024
AGREE = round(BINS * 0.75 - 4.5 * (BINS * 0.75 * 0.25) ** 0.5)  # equal bins that step 5 asks for
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # classes of a family, and their shingles, that are compared in one task
MOST_WORDS = 1 << 16  # word hashes a worker keeps

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes. ``bytes.lower`` and ``bytes.split`` know ASCII letters and white space only."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:  # the number of words goes in, so that a short text never equals a shingle
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(codes) - SHINGLE + 1
    value = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        value = _mix(value + codes[k : k + n])
    return np.unique(value)


def _probes() -> np.ndarray:
    """For each bin, the bins to copy from, in order; a rule, the same on every machine."""
    bins = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20)
    return (_mix(bins + np.arange(1, ATTEMPTS + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int16)


_PROBES = _probes()


def signature(hashes: np.ndarray) -> np.ndarray:
    """One 16-bit value per bin: the least of the bin's shingles, or a copy from a filled bin."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))  # sorted hashes: the first is the least
    out, filled = np.zeros(BINS, np.uint16), np.zeros(BINS, bool)
    out[bins[first]] = (_mix(hashes[first]) & np.uint64(0xFFFF)).astype(np.uint16)
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    for start in range(0, ATTEMPTS, 64):
        if not len(empty):
            break
        tried = _PROBES[empty, start : start + 64]
        ok = filled[tried]
        done = ok.any(axis=1)
        out[empty[done]] = out[tried[done, ok[done].argmax(axis=1)]]
        empty = empty[~done]
    if len(empty):  # never filled bins of a very small set: the next filled bin in order
        order = np.flatnonzero(filled)
        out[empty] = out[order[np.searchsorted(order, empty) % len(order)]]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys of (n, BINS) signatures."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(1 << 40), parts.shape[:2])
    for k in range(ROWS):
        value = _mix(value + parts[:, :, k])
    return value.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, one, two, signs = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = shingles(text)
            digest = xxhash.xxh3_128_digest(own.tobytes())
            sizes.append(len(own))
            one.append(int.from_bytes(digest[:8], "little", signed=True))
            two.append(int.from_bytes(digest[8:], "little", signed=True))
            signs.append(signature(own).tobytes() if len(own) else None)
        yield pa.record_batch(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
             pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "_c1", "_c2", "_sign"],
        )


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, _c1, _c2, _sign``: size, class and signature of every document's shingle set."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _describe, "doc_id long, n_shingles long, _c1 long, _c2 long, _sign binary"
    )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BINS)
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.record_batch([pa.array(band_keys(signs).ravel()), pa.array(nodes)], names=["key", "node"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the share of common shingles at least SHARE? Both sets sorted and without repeats."""
    least, most = sorted((len(a), len(b)))
    if not least or least * SHARE[1] < most * SHARE[0]:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * SHARE[1] >= (least + most - common) * SHARE[0]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, hub = None, np.empty(0, np.uint64)
    for batch in slices(batches):
        keep = []
        for u, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if u != last:  # rows of one hub often follow each other
                last, hub = u, shingles(a)
            keep.append(linked(hub, shingles(b)))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def confirm(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate edges ``u, v`` that are links; ``texts`` has a row ``node, text`` per class."""
    one = texts.select(F.col("node").alias("v"), F.col("text").alias("_b"))
    two = texts.select(F.col("node").alias("u"), F.col("text").alias("_a"))
    with_one = edges.join(one, "v")
    return with_one.join(two, "u").select("u", "v", "_a", "_b").mapInArrow(_confirm, "u long, v long")


class _Sets(dict):
    """The set that each number stands in, while sets are merged."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def _alike(left, right, same: bool) -> list[tuple[int, int, int]]:
    """(equal bins, i, j) of rows of different components whose sizes and signatures allow a link, most alike first."""
    signs, sizes, component = left
    other_signs, other_sizes, other_component = right
    order = np.argsort(other_sizes, kind="stable")
    sorted_sizes, out = other_sizes[order], []
    for i in range(len(signs)):
        low = np.searchsorted(sorted_sizes, -(-sizes[i] * SHARE[0] // SHARE[1]), side="left")
        high = np.searchsorted(sorted_sizes, sizes[i] * SHARE[1] // SHARE[0], side="right")
        js = order[low:high]
        js = js[other_component[js] != component[i]]
        if same:
            js = js[js > i]
        agree = (other_signs[js] == signs[i]).sum(axis=1)
        near = agree >= AGREE
        out += zip(agree[near].tolist(), [i] * int(near.sum()), js[near].tolist())
    return sorted(out, reverse=True)


def _blocks(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the components of two blocks: enough of them to merge all that are linked."""
    u, v = [], []
    if left.num_rows and right.num_rows:

        def read(t: pa.Table):
            signs = np.frombuffer(b"".join(t.column("_sign").to_pylist()), np.uint16).reshape(-1, BINS)
            return signs, t.column("n_shingles").to_numpy(), t.column("component").to_numpy()

        one, two = read(left), read(right)
        pairs = _alike(one, two, key[1].as_py() == key[2].as_py())
        sets, merged = ({}, {}), _Sets()

        def full(side: int, table: pa.Table, k: int) -> np.ndarray:
            if k not in sets[side]:
                sets[side][k] = shingles(table.column("text")[k].as_py())
            return sets[side][k]

        for _, i, j in pairs:
            a, b = merged.find(int(one[2][i])), merged.find(int(two[2][j]))
            if a != b and linked(full(0, left, i), full(1, right, j)):
                merged[max(a, b)] = min(a, b)
                u.append(one[2][i])
                v.append(two[2][j])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def across(members: DataFrame) -> DataFrame:
    """Links ``u, v`` between components of a family; ``members``: family, component, node, n_shingles, _sign, text.

    A family is cut into blocks of at most about BLOCK classes and BLOCK_SHINGLES shingles by the hash of the class; each
    pair of blocks is one group, so a task holds two blocks whatever the family's size. Only links that merge
    components come out, not the pairs that were compared.
    """
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    counts = settle_rows(members.groupBy("family").agg(parts.alias("_k")), "blocks", 1)
    rows = members.join(counts, "family").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    columns = ["family", "_i", "_j", "component", "n_shingles", "_sign", "text"]
    left = rows.where("_own <= _other").withColumns({"_i": F.col("_own"), "_j": F.col("_other")}).select(columns)
    right = rows.where("_other <= _own").withColumns({"_i": F.col("_other"), "_j": F.col("_own")}).select(columns).toDF(*columns)
    keys = ["family", "_i", "_j"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_blocks, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of the documents.

    Words are runs of anything but ASCII white space, ASCII letters in lower case. A text with fewer than five words is
    one shingle. A null text, an empty one and one without words have no shingles, are linked with nothing, and are
    their own component. Equal rows get equal results. A null ``doc_id`` takes part in linking, but never names a
    component unless no document of it has an id; then ``component_id`` is null and ``kept`` is true. Other columns are
    left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    described = settle(describe(docs), "shingles")
    classes = described.where("n_shingles > 0").groupBy("_c1", "_c2").agg(
        F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles")
    )
    # The numbers of a written table's rows are the same whenever it is read again.
    unnumbered = settle(classes, "classes")
    classes = settle(unnumbered.withColumn("node", F.monotonically_increasing_id()), "classes")
    chosen = (
        described.alias("d").where("n_shingles > 2")  # smaller sets are linked only when they are equal
        .join(classes.select("_c1", "_c2", "first_doc", "node").alias("c"),
              F.expr("d._c1 = c._c1 and d._c2 = c._c2 and d.doc_id <=> c.first_doc"))
        .select("node", "first_doc", "d.n_shingles", "_sign")
    )
    nodes = settle(chosen, "nodes")
    entries = nodes.select("node", "_sign").mapInArrow(_entries, "key long, node long")
    hubs = entries.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub <> _last")
    hubs = settle(hubs.select("key", "hub"), "hubs")
    edges = entries.join(hubs, "key").where("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    edges = settle(edges.distinct(), "edges")
    n_edges = edges.count()
    ends = edges.select("u").union(edges.select("v")).distinct().withColumnRenamed("u", "node")
    needed = nodes.select("node", "first_doc").join(ends, "node").dropDuplicates(["node"])
    needed = settle_rows(needed, "needed", n_edges)
    texts = _texts(docs, needed, classes.select("node", "_c1", "_c2"))
    links = settle(confirm(edges, texts), "links")
    members = settle_rows(components(links, n_edges), "members", n_edges)
    found = settle_rows(_search_families(edges, members, nodes, texts, n_edges), "found", n_edges)

    known = classes.select("node", "_c1", "_c2", "first_doc").join(found, "node", "left").select(
        "_c1", "_c2", "first_doc", F.coalesce("component", "node").alias("component")
    )
    known = settle(known, "known")
    least = known.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    least = settle(least, "least")
    named = settle(known.join(least, "component").select("_c1", "_c2", "component_id"), "named")
    discard(unnumbered, classes, nodes, hubs, edges, needed, texts, links, members, found, known, least)
    out = described.select("doc_id", "n_shingles", "_c1", "_c2").join(named, ["_c1", "_c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _named(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The components of the pairs' nodes, where they differ; a node without links is its own component."""
    one = members.select(F.col("node").alias("_u"), F.col("component").alias("_cu"))
    two = members.select(F.col("node").alias("_v"), F.col("component").alias("_cv"))
    both = pairs.join(one, F.col("u") == F.col("_u"), "left").join(two, F.col("v") == F.col("_v"), "left")
    both = both.select(F.coalesce("_cu", "u").alias("u"), F.coalesce("_cv", "v").alias("v"))
    return both.where("u <> v").distinct()


def _search_families(edges: DataFrame, members: DataFrame, nodes: DataFrame, texts: DataFrame, rows: int) -> DataFrame:
    """``node, component`` after links between components that stars missed."""
    rejected = settle_rows(_named(edges, members), "rejected", rows)
    n_rejected = rejected.count()
    if not n_rejected:
        return members
    family = settle_rows(components(rejected, n_rejected), "families", n_rejected)
    family = family.select(F.col("node").alias("component"), F.col("component").alias("family"))
    own = members.union(family.join(members, family["component"] == members["node"], "left_anti").select(
        family["component"].alias("node"), family["component"].alias("component")))
    own = own.join(family, "component").join(nodes.select("node", "n_shingles", "_sign").dropDuplicates(["node"]), "node")
    more = settle(across(settle(own.join(texts, "node"), "open")), "links")
    root = settle_rows(components(more, n_rejected), "roots", n_rejected)
    root = root.select(F.col("node").alias("_c"), F.col("component").alias("_root"))
    both = members.union(more.select("u", "u").union(more.select("v", "v")).distinct()).distinct()
    return both.join(root, F.col("component") == F.col("_c"), "left").select("node", F.coalesce("_root", "component").alias("component"))


def _texts(docs: DataFrame, needed: DataFrame, named: DataFrame) -> DataFrame:
    """``node, text``: the text of each class that stands in an edge, from its document with the least id."""
    wanted = needed.join(named, "node").select("node", "first_doc", "_c1", "_c2")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for text, one, two in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                digest = xxhash.xxh3_128_digest(shingles(text).tobytes())
                keep.append(int.from_bytes(digest[:8], "little", signed=True) == one
                            and int.from_bytes(digest[8:], "little", signed=True) == two)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["first_doc"])).select("node", "text", "_c1", "_c2")
    rows = rows.mapInArrow(classify, "node long, text string")  # another document may have the same id
    return settle(rows.dropDuplicates(["node"]), "texts")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that name their component, with all columns; equal rows stay once.

    Rows that share a ``doc_id`` stay or go together.
    """
    id_ = fresh(docs.columns, "_id")
    marks = near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("_n"))
    marks = settle(marks, "kept")
    kept = docs.join(marks.select(id_).hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    return kept if marks.where("_n > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])
