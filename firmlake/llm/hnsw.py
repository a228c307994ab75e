"""Nearest neighbours with a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of about SHARD_ROWS rows by the hash of their id. A task builds the graph of one shard: the
distinct vectors as unit vectors in single precision, and per level a flat array of neighbour numbers (a row per node,
-1 where a place is free). Nodes are inserted, and queries answered, in batches that walk the graph in step, so every
step is a handful of numpy calls. The graphs are written out, a row per shard.

Each query visits every shard. Queries come in groups of QUERY_ROWS; a task holds one shard's graph and one group. Found
neighbours are scored again in double precision on the original vectors, and the shards' lists are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlake.session import settle

SHARD_ROWS = 4096
QUERY_ROWS = 8192
DEGREE = 16  # neighbours of a node above level 0; twice as many on it
EF_BUILD = 64
EF_SEARCH = 128
BATCH = 256  # nodes that are inserted, or queries that are answered, in step
EXPAND = 4  # candidates a walk opens in one step


class Graph:
    """``vectors``: unit rows; ``links[l]``: neighbour numbers on level l, a row per node with that level (``at[l]``)."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.vectors, self.levels = vectors, levels
        order = [np.flatnonzero(levels >= l) for l in range(int(levels.max(initial=0)) + 1)]
        self.row = []  # where a node's links on a level stand
        for nodes in order:
            where = np.full(len(vectors), -1, np.int32)
            where[nodes] = np.arange(len(nodes))
            self.row.append(where)
        self.links = [np.full((len(nodes), DEGREE * 2 if l == 0 else DEGREE), -1, np.int32) for l, nodes in enumerate(order)]
        self.entry = -1

    @classmethod
    def build(cls, vectors: np.ndarray, seed: np.ndarray) -> "Graph":
        """``seed``: a 64-bit hash per node; it alone decides the node's level."""
        uniform = (seed.astype(np.float64) + 1) / 2.0**64
        graph = cls(vectors, np.minimum((-np.log(uniform) / np.log(DEGREE)).astype(np.int64), 8))
        order = np.argsort(-graph.levels, kind="stable")  # higher nodes first: the entry is settled from the start
        start, size = 0, 1
        while start < len(order):
            nodes = order[start : start + size]
            nodes = nodes[graph.levels[nodes] == graph.levels[nodes[0]]]
            graph._insert(nodes)
            start += len(nodes)
            size = min(BATCH, max(1, start // 2))
        graph._mend()
        return graph

    def walk(self, queries: np.ndarray, entries: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``ef`` nearest nodes found on a level, nearest first (-1 where fewer), and their nearness."""
        count, links, where = len(queries), self.links[level], self.row[level]
        seen = np.zeros((count, len(self.vectors)), bool)
        ids = np.full((count, ef), -1, np.int64)
        near = np.full((count, ef), -np.inf, np.float32)
        opened = np.ones((count, ef), bool)
        width = entries.shape[1]
        ids[:, :width] = entries
        near[:, :width] = np.where(entries >= 0, np.einsum("qd,qed->qe", queries, self.vectors[entries]), -np.inf)
        opened[:, :width] = entries < 0
        seen[np.where(entries >= 0)[0], entries[entries >= 0]] = True
        live = np.arange(count)
        while len(live):
            closed = np.where(opened[live], -np.inf, near[live])
            step = min(EXPAND, ef)
            pick = np.argpartition(-closed, step - 1, axis=1)[:, :step] if step < ef else np.tile(np.arange(ef), (len(live), 1))
            ok = np.take_along_axis(closed, pick, axis=1) > -np.inf
            going = ok.any(axis=1)
            live, pick, ok = live[going], pick[going], ok[going]
            if not len(live):
                break
            at = live[:, None]
            nodes = np.where(ok, ids[at, pick], -1)
            opened[at, pick] = True
            next_ = np.where(nodes[:, :, None] >= 0, links[where[nodes]], -1).reshape(len(live), -1)
            next_.sort(axis=1)
            fresh = next_ >= 0
            fresh[:, 1:] &= next_[:, 1:] != next_[:, :-1]
            fresh &= ~seen[at, next_]
            seen[at, np.where(fresh, next_, 0)] |= fresh
            r, c = np.nonzero(fresh)
            found = np.full(next_.shape, -np.inf, np.float32)
            found[r, c] = np.einsum("nd,nd->n", queries[live[r]], self.vectors[next_[r, c]])
            all_ids = np.concatenate((ids[live], np.where(fresh, next_, -1)), axis=1)
            all_near = np.concatenate((near[live], found), axis=1)
            all_open = np.concatenate((opened[live], ~fresh), axis=1)
            keep = np.argpartition(-all_near, ef - 1, axis=1)[:, :ef]
            ids[live] = np.take_along_axis(all_ids, keep, axis=1)
            near[live] = np.take_along_axis(all_near, keep, axis=1)
            opened[live] = np.take_along_axis(all_open, keep, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        return np.where(near > -np.inf, np.take_along_axis(ids, order, axis=1), -1), near

    def _choose(self, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (nearest first) up to ``most``: those nearer to the node than to a chosen one, then others."""
        count, width = ids.shape
        vectors = self.vectors[ids]
        between = np.einsum("nad,nbd->nab", vectors, vectors)
        blocked = np.full((count, width), -np.inf, np.float32)
        chosen = np.zeros((count, width), bool)
        number = np.zeros(count, np.int64)
        for k in range(width):
            take = (ids[:, k] >= 0) & (number < most) & (near[:, k] > blocked[:, k])
            chosen[:, k] = take
            number += take
            blocked = np.where(take[:, None], np.maximum(blocked, between[:, k]), blocked)
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(ids, order, axis=1)

    def _insert(self, nodes: np.ndarray) -> None:
        if self.entry < 0:
            self.entry = int(nodes[0])
            nodes = nodes[1:]
            if not len(nodes):
                return
        queries, own = self.vectors[nodes], int(self.levels[nodes[0]])
        entries = np.full((len(nodes), 1), self.entry, np.int64)
        for level in range(int(self.levels[self.entry]), -1, -1):
            if level > own:
                entries = self.walk(queries, entries, level, 4)[0][:, :1]
                continue
            ids, near = self.walk(queries, entries, level, EF_BUILD)
            links, where = self.links[level], self.row[level]
            picked = self._choose(ids, near, DEGREE)
            links[where[nodes], : picked.shape[1]] = picked
            self._link_back(nodes, picked, level)
            entries = ids[:, :4]

    def _link_back(self, nodes: np.ndarray, picked: np.ndarray, level: int) -> None:
        links, where = self.links[level], self.row[level]
        ok = picked >= 0
        target, source = picked[ok], np.repeat(nodes, ok.sum(axis=1))
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        whom, first, times = np.unique(target, return_index=True, return_counts=True)
        old, width = links[where[whom]], links.shape[1]
        more = np.full((len(whom), int(times.max(initial=0))), -1, np.int64)
        more[np.repeat(np.arange(len(whom)), times), np.arange(len(target)) - np.repeat(first, times)] = source
        both = np.concatenate((old, more), axis=1)
        near = np.where(both >= 0, np.einsum("nd,nkd->nk", self.vectors[whom], self.vectors[both]), -np.inf)
        by = np.argsort(-near, axis=1, kind="stable")
        both, near = np.take_along_axis(both, by, axis=1), np.take_along_axis(near, by, axis=1)
        full = (both >= 0).sum(axis=1) > width
        links[where[whom[~full]]] = both[~full, :width]
        for start in range(0, int(full.sum()), 1024):
            part = np.flatnonzero(full)[start : start + 1024]
            links[where[whom[part]]] = self._choose(both[part], near[part], width)

    def _mend(self) -> None:
        """Give nodes that no walk can reach a link from a near node that can be reached, in place of a spare one."""
        links = self.links[0]
        for _ in range(len(links) if self.entry >= 0 else 0):
            seen, edge = np.zeros(len(links), bool), np.array([self.entry])
            while len(edge):
                seen[edge] = True
                edge = np.unique(links[edge])
                edge = edge[(edge >= 0) & ~seen[np.maximum(edge, 0)]]
            if seen.all():
                return
            node = int(np.argmin(seen))
            times = np.bincount(links[links >= 0], minlength=len(links))
            near = np.flatnonzero(seen)
            for host in near[np.argsort(-(self.vectors[near] @ self.vectors[node]), kind="stable")]:
                spare = np.flatnonzero((links[host] < 0) | (times[links[host]] > 1))
                if len(spare):
                    links[host, spare[-1]] = node
                    break

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Numbers of the nodes nearest to each query, nearest first."""
        out = []
        for start in range(0, len(queries), BATCH):
            part = queries[start : start + BATCH]
            entries = np.full((len(part), 1), self.entry, np.int64)
            for level in range(int(self.levels[self.entry]), 0, -1):
                entries = self.walk(part, entries, level, 8)[0][:, :4]
            out.append(self.walk(part, entries, 0, max(ef, 8))[0])
        return np.concatenate(out) if out else np.empty((0, ef), np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the vectors that have a direction: no nulls, all finite, not all zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0)
    )


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes; cosines do not change, not even by rounding."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True, initial=0.0))[1])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of scaled rows with a scaled query, row by row: equal vectors get equal results wherever they are scored."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _build(key, rows):
    """The graph over a shard's distinct vectors; every node lists the ids of the rows with its vector, in order."""
    dim = key[0].as_py()
    ids, raw = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"), dim)
    order = np.argsort(ids, kind="stable")
    ids, raw = ids[order], np.ascontiguousarray(raw[order] + 0.0)
    _, first, node = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
    # Repeated rows count once: a node's ids are distinct, so the k + 1 least of them are enough for k neighbours.
    node, members = np.unique(np.stack([node.ravel(), ids]), axis=1)
    starts = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=len(first)))))
    vectors = raw[first]
    seed = (ids[first].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    seed = (seed ^ (seed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    graph = Graph.build(_unit(vectors).astype(np.float32), seed ^ (seed >> np.uint64(32)))
    parts = {
        "vectors": vectors.tobytes(), "members": members.astype(np.int64).tobytes(), "starts": starts.astype(np.int64).tobytes(),
        "levels": graph.levels.astype(np.int64).tobytes(), "links": b"".join(x.tobytes() for x in graph.links),
    }
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "entry": pa.array([graph.entry], pa.int64()),
                     **{k: pa.array([v], pa.binary()) for k, v in parts.items()}})


INDEX = "dim int, shard int, entry long, vectors binary, members binary, starts binary, levels binary, links binary"


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per shard: the graph's flat arrays. Vectors of different lengths never share a shard."""
    rows = usable(vectors).withColumn("dim", F.size("vector"))
    counts = settle(rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("_shards")), "shards")
    tasks = counts.agg(F.sum("_shards")).first()[0] or 1
    shard = F.pmod(F.xxhash64("vec_id"), F.col("_shards")).cast("int")
    # The hash deals the rows evenly; a row per vector length is joined.
    dealt = rows.join(F.broadcast(counts), "dim").select("dim", shard.alias("shard"), "vec_id", "vector")
    # Building a graph is dear, its rows are few: a task per shard is asked for outright.
    return settle(dealt.repartition(int(tasks), "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, INDEX), "graphs")


def _searcher(k: int, ef: int):
    def search(key, index: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[np.ndarray] = []
        if index.num_rows and asked.num_rows:
            dim, row = key[0].as_py(), {c: index.column(c)[0].as_py() for c in index.column_names}
            vectors = np.frombuffer(row["vectors"]).reshape(-1, dim)
            members, starts = np.frombuffer(row["members"], np.int64), np.frombuffer(row["starts"], np.int64)
            graph = Graph(_unit(vectors).astype(np.float32), np.frombuffer(row["levels"], np.int64))
            flat, at = np.frombuffer(row["links"], np.int32), 0
            for l, links in enumerate(graph.links):
                graph.links[l] = flat[at : at + links.size].reshape(links.shape)
                at += links.size
            graph.entry = row["entry"]
            own, raw = asked.column("vec_id").to_numpy(), _scaled(_matrix(asked.column("vector"), dim))
            units, scaled = _unit(raw).astype(np.float32), _scaled(vectors)

            def nearest(nodes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
                """The k best ids of the nodes for a query, each once with its best score."""
                nodes = nodes[nodes >= 0]
                times = np.minimum(starts[nodes + 1] - starts[nodes], k + 1)  # its own row and k others at most
                ids = np.concatenate([members[starts[n] : starts[n] + t] for n, t in zip(nodes, times)])
                scores = np.repeat(cosines(scaled[nodes], raw[q]), times)
                best = np.lexsort((ids, -scores))
                best = best[ids[best] != own[q]]
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:k]
                return ids[best], scores[best]

            for start in range(0, len(own), BATCH):
                found = graph.search(units[start : start + BATCH], min(ef, max(8, len(vectors))))
                for q, nodes in enumerate(found, start):
                    ids, scores, wide = *nearest(nodes, q), ef
                    while len(ids) < k and wide < len(vectors):  # many near vectors of few ids: look further
                        wide *= 4
                        ids, scores = nearest(graph.search(units[q : q + 1], min(wide, len(vectors)))[0], q)
                    rows.append(np.rec.fromarrays([np.full(len(ids), own[q]), ids, scores]))
        columns = [np.concatenate([r[f] for r in rows]) if rows else [] for f in ("f0", "f1", "f2")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return search


def search(index: DataFrame, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query (``vec_id, embedding``) the ``k`` nearest rows of the index by cosine.

    Ties go to the smaller id; rows with the query's own id are no candidates; an id is listed once. A query or a row
    whose vector is null, empty, zero or holds nulls or non-finite numbers takes no part, nor does one without an id.
    Queries meet only vectors of their length. Repeated queries are answered once.
    """
    asked = usable(queries).withColumn("dim", F.size("vector")).dropDuplicates(["vec_id", "vector"])
    groups = asked.groupBy("dim").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("_groups"))
    shards = index.select("dim", "shard")
    # A query goes to every shard, an index row to every group of queries.
    asked = asked.join(F.broadcast(groups), "dim").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("_groups")).cast("int"))
    asked = asked.join(F.broadcast(shards.groupBy("dim").agg(F.max("shard").alias("_last"))), "dim")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), "_last")).alias("shard"), "part", "vec_id", "vector")
    opened = index.join(F.broadcast(groups), "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")
    keys = ["dim", "shard", "part"]
    found = opened.groupBy(keys).cogroup(asked.groupBy(keys)).applyInArrow(_searcher(k, ef), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
