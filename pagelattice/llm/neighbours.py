"""The k most similar vectors of every vector, by small-world graphs per shard.

A tree of pivots cuts the vectors into shards: a node that holds more than ``SHARD`` vectors gets children, unit pivots fitted
on a bounded sample of its vectors, and so on until every leaf is a shard. The number of leaves grows with the data, the
sample of a node and the work to route a vector (its way down the tree) don't. Every vector is indexed in the leaf of its
nearest pivot and in those of the next ones that are nearly as similar, ``probes`` at most, so that a vector and its neighbour
meet even where a border runs between them; it is written once for each of these leaves, whatever their size. Each shard
holds a hierarchical navigable small-world graph as flat neighbour arrays; each vector searches the graphs of its leaves,
beginning at itself, and the shards' results are merged into one list per vector.

Equal vectors (by two 64-bit hashes, counted per hash with partial sums) are one point of the index, for which the lowest
``k + 1`` ids of the copies stand; so a vector that makes up a third of all rows is one point, and its copies find each other
without a search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.session import shared_checkpoint

#: Vectors per leaf that a node is cut for, its most children, and the sampled rows per child: a fit has FAN * SAMPLE rows at most.
CELL, FAN, SAMPLE = 600, 1024, 32
#: On its way down a vector follows so many times as many nodes as it may end in leaves: the leaf of a near pivot often lies in a farther node.
WIDER = 4
#: Copies of vectors that are handed on at once.
ROUTED = 1 << 16
#: The greatest size of a shard; a vector lies in up to four, so a shard has about three times CELL.
SHARD = 4096
#: Links of a node in the upper layers and in layer 0; candidates looked at for them; nodes of a layer per node above.
M, M0, WIDE, THIN = 8, 16, 32, 16


class Graph:
    """Hierarchical navigable small world over the rows of ``x`` (unit vectors), as one flat neighbour array per layer.

    Layer l holds every THIN-th node of layer l - 1 (rows are in no order, so this is a random choice). A node's links are
    chosen from its nearest nodes in the layer by the diversity rule: a candidate nearer to a link already chosen than to
    the node is left for last. Links are made mutual while there is room. Missing links are -1.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.layers, step = x, [], 1
        while True:
            nodes = np.arange(0, len(x), step)
            self.layers.append((nodes, self.links(x[nodes], M0 if step == 1 else M)))
            if len(nodes) <= THIN:
                break
            step *= THIN

    @staticmethod
    def links(x: np.ndarray, m: int, block: int = 1024) -> np.ndarray:
        n, out = len(x), []
        w = min(WIDE, n - 1)
        if w < 1:
            return np.full((n, m), -1, dtype=np.int32)
        for s in range(0, n, block):
            sim = x[s : s + block] @ x.T
            rows = np.arange(len(sim))
            sim[rows, rows + s] = -np.inf
            near = np.argpartition(sim, n - w - 1 if w < n - 1 else 0, axis=1)[:, n - w :] if w < n - 1 else np.argsort(sim, axis=1)[:, 1:]
            s_near = np.take_along_axis(sim, near, 1)
            order = np.argsort(-s_near, axis=1, kind="stable")
            near, s_near = np.take_along_axis(near, order, 1), np.take_along_axis(s_near, order, 1)
            v = x[near]
            among = v @ v.transpose(0, 2, 1)
            chosen = np.zeros(near.shape, dtype=bool)
            for j in range(near.shape[1]):
                shadowed = (chosen & (among[:, j, :] > s_near[:, j, None])).any(1)
                chosen[:, j] = ~shadowed & (chosen.sum(1) < m)
            # the diverse links first, then the nearest of the rest
            rank = np.argsort(~chosen, axis=1, kind="stable")[:, :m]
            got = np.take_along_axis(near, rank, 1)
            if got.shape[1] < m:
                got = np.pad(got, ((0, 0), (0, m - got.shape[1])), constant_values=-1)
            out.append(got)
        links = np.concatenate(out).astype(np.int32)
        return Graph.mutual(links)

    @staticmethod
    def mutual(links: np.ndarray) -> np.ndarray:
        """``links`` with up to as many incoming ones appended, so that no node is out of reach of those it points to."""
        n, m = links.shape
        src = np.repeat(np.arange(n), m)
        dst = links.ravel()
        keep = dst >= 0
        src, dst, turn = src[keep], dst[keep], np.tile(np.arange(m), n)[keep]
        order = np.lexsort((turn, dst))
        src, dst = src[order], dst[order]
        first = np.searchsorted(dst, np.arange(n))
        place = np.arange(len(dst)) - first[dst]
        room = m // 2
        back = np.full((n, room), -1, dtype=np.int32)
        fits = place < room
        back[dst[fits], place[fits]] = src[fits]
        return np.concatenate([links, back], axis=1)

    def search(self, q: np.ndarray, k: int, start: np.ndarray | None = None, ef: int = 24, block: int = 512):
        """Positions and similarities (-inf where there are fewer) of the ``k`` nearest nodes of each row of ``q``.

        start: a node of layer 0 per query to begin at; without it the search descends from the top layer.
        """
        pos, sim = [], []
        for s in range(0, len(q), block):
            part = q[s : s + block]
            if start is None:
                at = np.zeros((len(part), 1), dtype=np.int64)
                for level in range(len(self.layers) - 1, 0, -1):
                    nodes, links = self.layers[level]
                    best, _ = self.beam(part, nodes, links, at, 4, 2)
                    at = np.where(best >= 0, best, best[:, :1]) * THIN
            else:
                at = start[s : s + block, None]
            nodes, links = self.layers[0]
            p, d = self.beam(part, nodes, links, at, max(ef, k), 4)
            pos.append(p[:, :k])
            sim.append(d[:, :k])
        return np.concatenate(pos), np.concatenate(sim)

    def beam(self, q, nodes, links, at, ef, spread):
        """Best-first search of all queries in step: each round expands the ``spread`` best open nodes of every query's beam."""
        b, n, rows = len(q), len(nodes), np.arange(len(q))[:, None]
        xs = self.x if n == len(self.x) else self.x[nodes]
        seen = np.zeros((b, n + 1), dtype=bool)
        seen[:, n] = True
        beam = np.full((b, ef), n, dtype=np.int64)
        score = np.full((b, ef), -np.inf, dtype=np.float32)
        done = np.ones((b, ef), dtype=bool)
        w = at.shape[1]
        fresh = ~seen[rows, at]
        if w > 1:
            for j in range(1, w):
                fresh[:, j] &= ~(at[:, j : j + 1] == at[:, :j]).any(1)
        seen[rows, at] = True
        first = np.einsum("bd,bwd->bw", q, xs[at]).astype(np.float32)
        beam[:, :w], score[:, :w], done[:, :w] = at, np.where(fresh, first, -np.inf), ~fresh
        live = np.arange(b)
        while len(live):
            sc, dn, bm = score[live], done[live], beam[live]
            open_score = np.where(dn, -np.inf, sc)
            pick = np.argpartition(-open_score, spread - 1, axis=1)[:, :spread]
            ok = np.take_along_axis(open_score, pick, 1) > -np.inf
            going = ok.any(1)
            if not going.all():
                live, sc, dn, bm, pick, ok = live[going], sc[going], dn[going], bm[going], pick[going], ok[going]
                if not len(live):
                    break
            np.put_along_axis(dn, pick, True, 1)
            here = np.where(ok, np.take_along_axis(bm, pick, 1), 0)
            cand = np.where(ok[:, :, None], links[here], -1).reshape(len(live), -1)
            cand[cand < 0] = n
            cand = np.sort(cand, axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
            lr = live[:, None]
            cand[seen[lr, cand]] = n
            seen[lr, cand] = True
            new = cand < n
            r, c = np.nonzero(new)
            s = np.full(cand.shape, -np.inf, dtype=np.float32)
            if len(r):
                s[r, c] = np.einsum("nd,nd->n", q[live[r]], xs[cand[r, c]])
            all_s = np.concatenate([sc, s], 1)
            keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            score[live] = np.take_along_axis(all_s, keep, 1)
            beam[live] = np.take_along_axis(np.concatenate([bm, cand], 1), keep, 1)
            done[live] = np.take_along_axis(np.concatenate([dn, ~new], 1), keep, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        score, beam = np.take_along_axis(score, order, 1), np.take_along_axis(beam, order, 1)
        return np.where(score > -np.inf, beam, -1), score


def usable_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``id, v``: one row per key; vectors of another length, with nulls or non-finite values, or all zero, are left out."""
    v = F.col(vector)
    top = float(np.finfo(np.float32).max)
    ok = v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= top)) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & ok).select(F.col(key).cast("bigint").alias("id"), v.cast("array<float>").alias("v")).dropDuplicates(["id"])


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows, in double."""
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _floats(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, size)


def _raw(x: np.ndarray) -> pa.Array:
    """Rows as binary values, without a loop."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x, dtype=np.float32))])


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    """``n`` unit pivots: rows of the sample moved to the middle of what lies nearest, a few times."""
    rng = np.random.default_rng(7)
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], c)
    return c.astype(np.float32)


class Tree:
    """Pivots of inner nodes: ``inner[node]`` is the matrix of its children's pivots and the number of the first child. 0 is the root.

    A leaf that holds vectors too alike to be cut by pivots is cut by a hash of the id into ``parts`` blocks; every two blocks
    are a shard, so that any two of its vectors meet.
    """

    def __init__(self):
        self.inner: dict[int, tuple[np.ndarray, int]] = {}
        self.parts: dict[int, int] = {}
        self.nodes = 1

    def grow(self, node: int, pivots: np.ndarray) -> None:
        self.inner[node] = (pivots, self.nodes)
        self.nodes += len(pivots)

    def leaves(self, x: np.ndarray, probes: int, margin: float, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves: for each row (a unit vector) the leaves of its most similar pivots, within ``margin`` of the best."""
        parts = [self._descend(x[s : s + block], probes, margin) for s in range(0, len(x), block)]
        rows = [r + k * block for k, (r, _) in enumerate(parts)]
        return (np.concatenate(rows), np.concatenate([leaf for _, leaf in parts])) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _descend(self, x: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        rows, at, sim = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=np.float32)
        inner = np.array(sorted(self.inner), dtype=np.int64)
        while (down := np.isin(at, inner)).any():
            order = np.flatnonzero(down)[np.argsort(at[down], kind="stable")]
            new = [(rows[~down], at[~down], sim[~down])]
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                r = rows[part]
                pivots, first = self.inner[int(at[part[0]])]
                s = x[r] @ pivots.T
                # of leaves no more than ``probes`` can be among the nearest of all
                leads_on = np.searchsorted(inner, first + len(pivots)) > np.searchsorted(inner, first)
                w = min(probes * WIDER if leads_on else probes, s.shape[1])
                top = np.argpartition(-s, w - 1, axis=1)[:, :w]
                new.append((np.repeat(r, w), (top + first).ravel(), np.take_along_axis(s, top, 1).ravel()))
            rows, at, sim = self._first(*(np.concatenate(c) for c in zip(*new, strict=True)), probes * WIDER)
        rows, at, sim = self._first(rows, at, sim, probes)
        near = sim >= sim[np.searchsorted(rows, rows)] - margin
        return rows[near], at[near]

    @staticmethod
    def _first(rows: np.ndarray, at: np.ndarray, sim: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``n`` most similar nodes of each row."""
        order = np.lexsort((at, -sim, rows))
        rows, at, sim = rows[order], at[order], sim[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < n
        return rows[keep], at[keep], sim[keep]


def _hash(ids: np.ndarray, factor: int, shift: int) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(factor)) >> np.uint64(shift)


def pivot_tree(points: DataFrame, n: int, size: int, probes: int, margin: float, depth: int = 16) -> Tree:
    """The tree over ``points`` (``id, v``), of which there are ``n``. Grown level by level; of each level only nodes that are too large reach the driver.

    A node that hardly gets smaller by its parent's cut, or still is too large at ``depth``, is compared by pairs of blocks.
    """
    sc, tree = points.sparkSession.sparkContext, Tree()
    large = {0: n} if n > SHARD else {}
    for _ in range(depth):
        if not large:
            return tree
        children = {node: int(min(FAN, max(2, -(-k // CELL)))) for node, k in large.items()}
        found: dict[int, list[tuple[int, bytes]]] = {}
        for r in _fitted(points, sc.broadcast((tree, {node: min(1.0, SAMPLE * c / large[node]) for node, c in children.items()})), children, size).toLocalIterator():
            found.setdefault(r.node, []).append((r.turn, r.pivot))
        before = {}
        for node, ps in sorted(found.items()):
            first = tree.nodes
            tree.grow(node, np.frombuffer(b"".join(bytes(p) for _, p in sorted(ps)), dtype=np.float32).reshape(-1, size))
            before |= dict.fromkeys(range(first, tree.nodes), large[node])
        sizes = _sizes(points, sc.broadcast(tree), size, probes, margin)
        large = {}
        for node, k in sizes.items():
            if k > 0.9 * before.get(node, math.inf):
                tree.parts[node] = -(-2 * k // SHARD)
            elif node not in tree.parts:
                large[node] = k
    tree.parts |= {node: -(-2 * k // SHARD) for node, k in large.items()}
    return tree


def _fitted(points: DataFrame, state, children: dict[int, int], size: int) -> DataFrame:
    """``node, turn, pivot``: pivots of the nodes that are to be cut. state: the tree, and the share of each node's points that is sampled, by a hash of the id."""

    def sampled(batches):
        tree, rate = state.value
        for b in batches:
            ids, x = b.column(0).to_numpy(), _floats(b.column(1), size)
            lucky = _hash(ids, 0xD6E8FEB86659FD93, 11).astype(np.float64) / 2.0**53
            some = np.flatnonzero(lucky < max(rate.values()))
            rows, leaf = tree.leaves(_unit(x[some]).astype(np.float32), 1, 0.0)
            keep = np.array([lucky[some[r]] < rate.get(int(at), 0.0) for r, at in zip(rows, leaf, strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(leaf[keep], pa.int64()), _raw(x[some[rows[keep]]])], names=["node", "v"])

    def fit(key, group: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.frombuffer(b"".join(group.v), dtype=np.float32).reshape(-1, size))
        # the sample's rows come in any order
        x = x[np.lexsort(x.T[:8])]
        c = fit_pivots(x, children[int(key[0])])
        return pd.DataFrame({"node": int(key[0]), "turn": np.arange(len(c)), "pivot": [p.tobytes() for p in c]})

    return points.select("id", "v").mapInArrow(sampled, "node bigint, v binary").groupBy("node").applyInPandas(fit, "node bigint, turn bigint, pivot binary")


def _sizes(points: DataFrame, tree, size: int, probes: int, margin: float) -> dict[int, int]:
    """Leaves of more than SHARD vectors and how many they have."""

    def count(batches):
        for b in batches:
            _, leaf = tree.value.leaves(_unit(_floats(b.column(1), size)).astype(np.float32), probes, margin)
            at, n = np.unique(leaf, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["leaf", "n"])

    seen = points.select("id", "v").mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD)
    return {r.leaf: r.n for r in seen.toLocalIterator()}


def routed(points: DataFrame, tree: Tree, size: int, probes: int, margin: float) -> DataFrame:
    """``leaf, part, id, v``: every point once for each of its leaves, ``probes`` at most; in a leaf of blocks once for each other block."""
    held = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        tree = held.value
        for b in batches:
            x = _floats(b.column(1), size)
            rows, leaf = tree.leaves(_unit(x).astype(np.float32), probes, margin)
            ids, part = b.column(0).to_numpy()[rows], np.zeros(len(rows), dtype=np.int64)
            if tree.parts:
                blocks = np.array([tree.parts.get(int(k), 1) for k in leaf], dtype=np.int64)
                mine = (_hash(ids, 0x9E3779B97F4A7C15, 33) % blocks.astype(np.uint64)).astype(np.int64)
                times = np.maximum(blocks - 1, 1)
                src = np.repeat(np.arange(len(rows)), times)
                other = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
                rows, leaf, ids, mine, blocks = rows[src], leaf[src], ids[src], mine[src], blocks[src]
                other += (other >= mine) & (blocks > 1)
                part = np.minimum(mine, other) * blocks + np.maximum(mine, other)
            # copies of a crowded leaf's vectors in batches of bounded size
            for s in range(0, len(rows), ROUTED):
                part_, r = slice(s, s + ROUTED), rows[s : s + ROUTED]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[part_], pa.int64()), pa.array(part[part_]), pa.array(ids[part_]), _raw(x[r])], names=["leaf", "part", "id", "v"])

    return points.select("id", "v").mapInArrow(run, "leaf bigint, part bigint, id bigint, v binary")


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, min_score: float = 0.85, size: int = 64, probes: int = 4, margin: float = 0.15, ef: int = 16) -> DataFrame:
    """``id, near, score``: for every usable vector its ``k`` most similar others by cosine, those of ``min_score`` at least.

    probes, margin: a vector lies in at most so many leaves, those whose pivots are less similar than its nearest pivot by
    no more than ``margin``. ef: width of a search's beam.

    Defined results: null keys, null and unusable vectors neither have nor are neighbours; repeated rows count once; ties
    go to the lower id; no usable vectors give no rows.
    """
    vectors = usable_vectors(df, key, vector, size)
    raw = shared_checkpoint(vectors.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))
    equal = raw.groupBy("h1", "h2").agg(F.min("id").alias("point"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = shared_checkpoint(raw.select("id", "h1", "h2").join(equal, ["h1", "h2"]).select("id", "point"))
    points = raw.join(copies.where("id <> point").select("id"), "id", "left_anti").select("id", "v")
    tree = pivot_tree(points, points.count(), size, probes, margin)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        ids = group.id.to_numpy()
        # the graph takes its upper layers by position: mix the order, so that they are a random choice
        mix = np.argsort(_hash(ids, 0xD6E8FEB86659FD93, 20), kind="stable")
        ids = ids[mix]
        exact = _unit(np.frombuffer(b"".join(group.v), dtype=np.float32).reshape(-1, size))[mix]
        unit = exact.astype(np.float32)
        pos, _ = Graph(unit).search(unit, k + 4, np.arange(len(ids)), ef=ef)
        score = np.einsum("nd,nkd->nk", exact, exact[np.maximum(pos, 0)])
        near = ids[np.maximum(pos, 0)]
        r, c = np.nonzero((pos >= 0) & (score >= min_score) & (near != ids[:, None]))
        return pd.DataFrame({"id": ids[r], "near": near[r, c], "score": score[r, c]})

    found = routed(points, tree, size, probes, margin).groupBy("leaf", "part").applyInPandas(search, "id bigint, near bigint, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    once = found.repartition("id").dropDuplicates(["id", "near"])
    lists = once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select(F.col("id").alias("point"), "near", "score")
    turn = F.row_number().over(Window.partitionBy("point").orderBy("id"))
    heads = copies.withColumn("turn", turn).where(F.col("turn") <= k + 1).select(F.col("point").alias("near"), F.col("id").alias("copy"))
    reach = lists.join(heads, "near", "left").select("point", F.coalesce("copy", "near").alias("copy"), "score")
    same = heads.select(F.col("near").alias("point"), "copy", F.lit(1.0).alias("score"))
    full = reach.unionByName(same).join(copies, "point", "left").select(F.coalesce("id", "point").alias("id"), "copy", "score").where("id <> copy")
    last = Window.partitionBy("id").orderBy(F.desc("score"), "copy")
    return full.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k).select("id", F.col("copy").alias("near"), "score")
