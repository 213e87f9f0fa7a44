"""Near-duplicate texts: a Gray-ordered hierarchical index over fingerprints, with an exact check.

A text's set is all runs of five successive characters of its lower-cased letters and digits, other runs being one blank.
Texts that are equal after this are one class. Each class gets TABLES * ROWS min-hash values and, from their bits, a
fingerprint of 128 bits whose Hamming distance estimates the Jaccard distance.

The index has TABLES roots masks: the upper node of a fingerprint under a mask is the pattern of ROWS min-hash values that
the mask lets through, so only texts that agree in one whole pattern meet. Within a node the fingerprints are sorted by
Gray rank, which puts those that share leading bits side by side; these shared leading bits (32, then 64, then all) are
factored into inner nodes. Pairs of inner nodes are compared by their factored bits, the differences accumulate on the way
down, and a pair of groups that exceeds FAR differences is dropped with all that lies under it. Two further bits of each of
the 128 values are then compared as well, which leaves hardly a pair under a likeness of 0.4. Surviving pairs are checked exactly
on the texts.

At a likeness of 0.6 a pair shares a pattern with probability 1 - (1 - 0.6 ** ROWS) ** TABLES = 0.993, at 0.7 it is 0.99995;
FAR is 4.5 standard deviations above the expected distance at 0.6, and so is FINE for values of three bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.session import shared_checkpoint

TABLES, ROWS, FAR, FINE, RUN = 36, 4, 46, 69, 5
#: A node of CROWD texts, or of one in PORTION of all if these are more, is compared in blocks; crowded nodes are looked for
#: among one in SHARE of the texts. So no more than TABLES * PORTION nodes can be crowded.
CROWD, PORTION, SHARE = 1 << 15, 1024, 64
#: Pairs that are expanded at once; bounds a task's memory in nodes of any size. Rows from which a node that shares few leading bits has tiles.
CHUNK, TILE = 1 << 20, 256
_FINER = ["g1", "g2", "h1", "h2"]
_OTHER = re.compile(r"[\W_]+")
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, TABLES * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, TABLES * ROWS, dtype=np.uint32) | np.uint32(1)


def canonical(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def runs(text: str, n: int = RUN) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def min_hashes(texts: list[str], n: int = RUN) -> np.ndarray:
    """One row of min-hash values per text; every text must have ``n`` characters or more."""
    out = np.empty((len(texts), TABLES * ROWS), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    s = 0
    while s < len(texts):
        e, size = s, 0
        while e < len(texts) and (e == s or size + lengths[e] <= 1 << 16):
            size += int(lengths[e])
            e += 1
        c = np.frombuffer("".join(texts[s:e]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        h = np.zeros(len(c) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k : k + len(h)]
        h = (_mix(h) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths[s:e])])
        inner = np.ones(len(h), dtype=bool)
        for k in range(1, n):
            cross = starts[1:-1] - k
            inner[cross[(cross >= 0) & (cross < len(h))]] = False
        h = h[inner]
        first = np.concatenate([[0], np.cumsum(lengths[s:e] - n + 1)])[:-1]
        for k in range(TABLES * ROWS):
            out[s:e, k] = np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], first)
        s = e
    return out


def gray_rank(f: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray sequence."""
    r = f.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return r


def gray_code(r: np.ndarray) -> np.ndarray:
    return r ^ (r >> np.uint64(1))


def fingerprints(m: np.ndarray, bit: int = 0) -> np.ndarray:
    """Two 64-bit words per row, a bit from each of the first 128 min-hash values; ``bit`` 1 and 2 are those of the finer check."""
    bits = ((m[:, :128] * np.uint32(0x9E3779B1)) >> np.uint32(31 - bit)).astype(np.uint8) & np.uint8(1)
    return np.packbits(bits, axis=1, bitorder="big").view(">u8").astype(np.uint64)


def node_patterns(m: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """The upper node of every row under each of the masks, as one number."""
    out = np.empty((len(m), TABLES), dtype=np.uint64)
    for t in range(TABLES):
        h = _mix(origin.astype(np.uint64) * np.uint64(TABLES) + np.uint64(t + 1))
        for k in range(ROWS):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) ^ m[:, t * ROWS + k].astype(np.uint64))
        out[:, t] = h
    return out


def _levels(node: np.ndarray, rank1: np.ndarray, rank2: np.ndarray):
    """Start positions of the groups of each level of the sorted rows: nodes, shared 32 bits, shared 64 bits, single rows."""
    new = np.ones(len(node), dtype=bool)
    new[1:] = node[1:] != node[:-1]
    f1 = gray_code(rank1)
    out = [np.flatnonzero(new)]
    for shift in (32, 0):
        p = f1 >> np.uint64(shift)
        new = new.copy()
        new[1:] |= p[1:] != p[:-1]
        out.append(np.flatnonzero(new))
    out.append(np.arange(len(node)))
    return out, f1, gray_code(rank2)


def _tiles(f1: np.ndarray, f2: np.ndarray, first: int, end: int, far: int):
    """As ``close_pairs``, for the rows ``first`` to ``end`` of one node, without groups."""
    s = first
    while s < end - 1:
        e = min(end - 1, s + max(1, CHUNK // (end - s)))
        n = np.bitwise_count(f1[s:e, None] ^ f1[None, s + 1 : end]) + np.bitwise_count(f2[s:e, None] ^ f2[None, s + 1 : end])
        x, y = np.nonzero(n <= far)
        later = y >= x
        if later.any():
            yield x[later] + s, y[later] + s + 1
        s = e


def close_pairs(node: np.ndarray, rank1: np.ndarray, rank2: np.ndarray, far: int = FAR):
    """Positions (i, j), i < j, of rows of one node that differ in ``far`` bits at most; rows sorted by node, rank1, rank2."""
    if len(node) < 2:
        return
    levels, f1, f2 = _levels(node, rank1, rank2)
    size = np.diff(np.append(levels[0], len(node)))
    alone = np.flatnonzero(size > 1)
    # where most rows of a large node differ in the first 64 bits already, nothing can be factored out: rows are compared in tiles
    inner = np.diff(np.append(np.searchsorted(levels[2], levels[0]), len(levels[2])))
    tiled = (size[alone] >= TILE) & (2 * inner[alone] > size[alone])
    for k in alone[tiled]:
        yield from _tiles(f1, f2, int(levels[0][k]), int(levels[0][k] + size[k]), far)
    alone = alone[~tiled]
    low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
    masks = [None, lambda i: f1[i] >> high, lambda i: f1[i] & low, lambda i: f2[i]]
    # the first child of every group of a level, as an index into the next level
    child = [np.append(np.searchsorted(levels[k + 1], levels[k]), len(levels[k + 1])) for k in range(3)]
    # the last number is the first child of a single pair's left group that is still to be looked at; what is left of a pair
    # waits here behind what has come of it, so that no more than a few chunks a level are held, however large a node is
    todo = [(0, alone, alone, np.zeros(len(alone), dtype=np.int64), 0)] if len(alone) else []
    while todo:
        level, a, b, acc, s = todo.pop()
        na, nb = child[level][a + 1] - child[level][a], child[level][b + 1] - child[level][b]
        total = np.cumsum(na * nb)
        if len(a) > 1 and total[-1] > CHUNK:
            cut = max(1, int(np.searchsorted(total, total[-1] // 2)))
            todo += [(level, a[cut:], b[cut:], acc[cut:], 0), (level, a[:cut], b[:cut], acc[:cut], 0)]
            continue
        if len(a) == 1 and total[-1] > CHUNK:
            same = a[0] == b[0]
            first = s if same else 0
            k = min(max(1, CHUNK // int(nb[0] - first)), int(na[0]) - s)
            if s + k < na[0]:
                todo.append((level, a, b, acc, s + k))
            x = np.repeat(np.arange(s, s + k), nb[0] - first) + child[level][a[0]]
            y = np.tile(np.arange(first, nb[0]), k) + child[level][b[0]]
            got = np.zeros(len(x), dtype=np.int64) + acc[0]
        else:
            n = na * nb
            which = np.repeat(np.arange(len(a)), n)
            at = np.arange(int(total[-1])) - np.repeat(total - n, n)
            x, y = child[level][a[which]] + at // nb[which], child[level][b[which]] + at % nb[which]
            got, same = acc[which], a[which] == b[which]
        ok = (x <= y) | ~same if level < 2 else x < y
        x, y, got = x[ok], y[ok], got[ok]
        bits = masks[level + 1]
        got = got + np.bitwise_count(bits(levels[level + 1][x]) ^ bits(levels[level + 1][y]))
        near = got <= far
        x, y, got = x[near], y[near], got[near]
        if not len(x):
            continue
        if level == 2:
            yield x, y
        else:
            todo.append((level + 1, x, y, got, 0))


def _spread(node: np.ndarray, cols: list[np.ndarray], hot: dict[int, int]) -> list[np.ndarray]:
    """One row per text and node; in a crowded node one per pair of blocks that the text's block is part of, each pair a node of its own."""
    flat, rest = node.ravel(), [np.repeat(c, TABLES) for c in cols]
    if not hot:
        return [flat, *rest]
    at = np.isin(flat, np.array(list(hot), dtype=np.uint64))
    blocks = np.array([hot[int(x)] for x in flat[at]], dtype=np.int64)
    src = np.repeat(np.flatnonzero(at), blocks)
    other = np.arange(len(src)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = (_mix(rest[2][src].view(np.uint64)) % np.repeat(blocks, blocks).astype(np.uint64)).astype(np.int64)
    pair = np.minimum(mine, other) * (1 << 20) + np.maximum(mine, other) + 1
    split = _mix(flat[src] ^ _mix(pair.astype(np.uint64)))
    return [np.concatenate([flat[~at], split]), *[np.concatenate([c[~at], c[src]]) for c in rest]]


def _crowded(df: DataFrame) -> dict[int, int]:
    """Crowded nodes, and in how many blocks their texts are to be compared.

    Estimated on the texts whose id's hash is divisible by SHARE. The estimate only decides how work is spread: any answer
    gives the same pairs.
    """
    seen = shared_checkpoint(_normal(df.where(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0)).select("origin", "norm").distinct())
    crowd = max(CROWD, seen.count() * SHARE // PORTION)

    def count(batches):
        for b in batches:
            for s in range(0, len(b), 2048):
                part = b.slice(s, 2048)
                at, n = np.unique(node_patterns(min_hashes(part.column(1).to_pylist()), part.column(0).to_numpy()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(n, pa.int64())], names=["node", "n"])

    nodes = seen.mapInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
    return {int(np.int64(r.node).view(np.uint64)): -(-r.n * SHARE * 2 // crowd) for r in nodes.where(F.col("n") >= crowd // SHARE).toLocalIterator()}


def _normal(df: DataFrame) -> DataFrame:
    """``origin, id, norm``: usable rows with their text as ``canonical`` makes it, in an expression."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    usable = df.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return usable.select(F.col("origin").cast("int"), F.col("id").cast("bigint"), norm.alias("norm")).where(F.length("norm") >= RUN)


def near_copies(df: DataFrame, numerator: int = 3, denominator: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: similar pairs of classes of equal texts, and each record's class.

    df: ``origin int, id, text``; only records of one origin are compared. pairs: ``origin, a, b, common, united`` with a < b,
    class ids being the lowest id of a class; members: ``origin, id, cls``. A pair's likeness common / united is at least
    numerator / denominator, compared in integers.

    Defined results: null ids, null and blank texts and those of fewer than five letters or digits are no case; repeated
    rows count once, and of different texts under one id the greatest; no texts give no pairs; a long text is taken whole.
    """
    # texts are shuffled once, by id; classes are found and members placed by digests
    base = _normal(df).groupBy("origin", "id").agg(F.max("norm").alias("norm"))
    digests = base.select("origin", "id", F.unhex(F.md5("norm")).alias("h"))
    classes = digests.groupBy("origin", "h").agg(F.min("id").alias("cls"))
    cases = base.join(classes.select("origin", F.col("cls").alias("id")), ["origin", "id"], "left_semi")

    hot = df.sparkSession.sparkContext.broadcast(_crowded(df))

    def index(batches):
        for b in batches:
            for s in range(0, len(b), 2048):
                part = b.slice(s, 2048)
                m = min_hashes(part.column(2).to_pylist())
                origin = part.column(0).to_numpy()
                node, f = node_patterns(m, origin), fingerprints(m)
                r1, r2 = gray_rank(f[:, 0]), gray_rank(f[:, 1])
                finer = np.concatenate([fingerprints(m, 1), fingerprints(m, 2)], axis=1)
                cols = _spread(node, [r1, r2, part.column(1).to_numpy(), origin, *finer.T], hot.value)
                yield pa.RecordBatch.from_arrays([pa.array(x if x.dtype == np.int32 else np.ascontiguousarray(x).view(np.int64)) for x in cols], names=["node", "r1", "r2", "cls", "origin", *_FINER])

    def compare(batches):
        held = None
        for b in batches:
            now = [b.column(k).to_numpy() for k in range(b.num_columns)]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = [c[last:] for c in now]
            yield from _emit([c[:last] for c in now])
        if held is not None:
            yield from _emit(held)

    nodes = cases.mapInArrow(index, f"node bigint, r1 bigint, r2 bigint, cls bigint, origin int, {', '.join(f'{c} bigint' for c in _FINER)}").repartition("node").sortWithinPartitions("node", "r1", "r2")
    met = nodes.mapInArrow(compare, "origin int, a bigint, b bigint").distinct()
    side = lambda x: base.select("origin", F.col("id").alias(x), F.col("norm").alias(f"t{x}"))
    both = met.join(side("a"), ["origin", "a"]).join(side("b"), ["origin", "b"])

    def exact(batches):
        left: tuple[str | None, set[str]] = (None, set())
        right: tuple[str | None, set[str]] = (None, set())
        for x in batches:
            keep, common, united = [], [], []
            for k, (ta, tb) in enumerate(zip(x.column(3).to_pylist(), x.column(4).to_pylist(), strict=True)):
                if ta != left[0]:
                    left = (ta, runs(ta))
                if tb != right[0]:
                    right = (tb, runs(tb))
                n = len(left[1] & right[1])
                u = len(left[1]) + len(right[1]) - n
                if n * denominator >= u * numerator:
                    keep.append(k)
                    common.append(n)
                    united.append(u)
            rows_ = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[x.column(c).take(rows_) for c in range(3)], pa.array(common, pa.int64()), pa.array(united, pa.int64())], names=["origin", "a", "b", "common", "united"])

    pairs = both.select("origin", "a", "b", "ta", "tb").mapInArrow(exact, "origin int, a bigint, b bigint, common bigint, united bigint")
    members = digests.join(classes, ["origin", "h"]).select("origin", "id", "cls")
    return pairs, members


def _emit(cols: list[np.ndarray]):
    node, r1, r2, cls, origin, g1, g2, h1, h2 = cols
    r1, r2 = r1.view(np.uint64), r2.view(np.uint64)
    f1, f2 = gray_code(r1), gray_code(r2)
    for i, j in close_pairs(node, r1, r2):
        x, y = cls[i], cls[j]
        # values that differ in any of their three bits
        n = sum(np.bitwise_count((f[i] ^ f[j]) | ((g[i] ^ g[j]) | (h[i] ^ h[j])).view(np.uint64)) for f, g, h in ((f1, g1, h1), (f2, g2, h2)))
        ok = (x != y) & (n <= FINE)
        yield pa.RecordBatch.from_arrays([pa.array(origin[i][ok]), pa.array(np.minimum(x, y)[ok]), pa.array(np.maximum(x, y)[ok])], names=["origin", "a", "b"])


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``origin, id_a, id_b``: pairs between classes and within them as pairs of records, the smaller id first."""
    left, right = members.select("origin", F.col("cls").alias("a"), F.col("id").alias("x")), members.select("origin", F.col("cls").alias("b"), F.col("id").alias("y"))
    across = pairs.select("origin", "a", "b").join(left, ["origin", "a"]).join(right, ["origin", "b"])
    within = left.join(right.withColumnRenamed("b", "a"), ["origin", "a"]).where("x < y")
    return across.select("origin", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(within.select("origin", F.col("x").alias("id_a"), F.col("y").alias("id_b")))


def groups(pairs: DataFrame, members: DataFrame, rounds: int = 40) -> DataFrame:
    """``origin, id, group_id``: connected components of classes, by min-label propagation with pointer jumping.

    Labels and edges live in tables; each round is one aggregate and one join, its lineage cut in the shared checkpoint
    folder. Ends when no label changes, which takes about the logarithm of the longest chain in rounds; ``rounds`` only
    guards against an endless loop and raises when it is reached.
    """
    edges = shared_checkpoint(pairs.select("origin", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select("origin", F.col("b").alias("u"), F.col("a").alias("v"))))
    labels = shared_checkpoint(edges.groupBy("origin", "u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    for _ in range(rounds):
        seen = edges.join(labels.select("origin", F.col("u").alias("v"), F.col("label").alias("l")), ["origin", "v"]).groupBy("origin", "u").agg(F.min("l").alias("l"))
        hooked = labels.join(seen, ["origin", "u"]).select("origin", "u", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = hooked.select("origin", F.col("u").alias("label"), F.col("label").alias("far"))
        new = shared_checkpoint(hooked.join(jump, ["origin", "label"], "left").select("origin", "u", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("origin", "u", "label")
        if not changed:
            return members.join(labels.withColumnRenamed("u", "cls"), ["origin", "cls"], "left").select("origin", "id", F.coalesce("label", "cls").alias("group_id"))
    raise RuntimeError(f"components not found in {rounds} rounds")
