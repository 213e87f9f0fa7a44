"""The link graph: resolving links, degrees, relevance of linked pages, communities, insights, filters.

Edges are tables throughout. Hubs never become one row's array or one task's group: shared neighbours are counted by
triangles, each edge pointing from its rarer to its more linked end, so that a page with a tenth of all links adds work only
at its many small neighbours.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions import markdown as M
from pagelattice.functions import text as T
from pagelattice.functions.keys import page_key
from pagelattice.session import shared_checkpoint, shared_table

#: Weights of a direct link, a shared source, a shared neighbour.
DIRECT, SOURCE, NEIGHBOUR = 3.0, 4.0, 1.5
TYPES = ["entity", "concept", "source", "query", "synthesis"]
#: Affinity of two types, rows and columns in the order of TYPES; any other pair has 0.5.
AFFINITY = [
    [0.8, 1.2, 1.0, 0.8, 1.0],
    [1.2, 0.8, 1.0, 1.0, 1.2],
    [1.0, 1.0, 0.5, 0.8, 1.0],
    [0.8, 1.0, 0.8, 0.5, 1.0],
    [1.0, 1.2, 1.0, 1.0, 0.8],
]
STRUCTURAL = ["index", "overview", "log", "schema", "purpose"]
#: Ids of one block of a key that many share; links of a page whose neighbours are ordered in one task.
BLOCK, GATHERED = 2000, 10_000
#: Pairs of types that are far apart.
DISTANT = [("source", "concept"), ("source", "synthesis"), ("query", "entity")]


def affinity(a: Column, b: Column) -> Column:
    out = F.lit(0.5)
    for i, x in enumerate(TYPES):
        for j, y in enumerate(TYPES):
            if AFFINITY[i][j] != 0.5:
                out = F.when((a == x) & (b == y), AFFINITY[i][j]).otherwise(out)
    return out


def resolve_links(links: DataFrame, pages: DataFrame, to: str = "id", summed: bool = True) -> DataFrame:
    """``src, dst, times``: links whose target names a page, by the first of four spellings that does.

    links: ``src, target``; pages: ``id`` and, if other than that, ``to``, which stands for the page in ``src`` and ``dst`` and
    has the order of the ids. The spellings, most exact first: as it is; in lower case with hyphens for blanks; in lower case;
    by the normalised key. The first is an equi-join, the other three are one, of the distinct targets that the first leaves; of
    several pages the lowest wins. Links to the page itself and to no page are dropped. Null and blank targets are no links.
    Not ``summed``, each link is a row with ``times`` 1.
    """
    raw = F.trim("target")
    given = links.where(F.col("src").isNotNull() & (F.coalesce(raw, F.lit("")) != "")).select("src", raw.alias("target"))
    exact = pages.groupBy(F.col("id").alias("target")).agg(F.min(to).alias("dst")).hint("shuffle_hash")
    tried = shared_table(given.join(exact, "target", "left").select("src", "dst", F.when(F.col("dst").isNull(), F.col("target")).alias("target")))
    rest = tried.where("dst IS NULL").select("src", "target")
    # a target asks for each different text that its spellings make, once; a page is held under its two texts in the same way
    low = F.lower("target")
    asked = rest.select("target").distinct().select("target", F.regexp_replace(low, r"\s+", "-").alias("k2"), low.alias("k3"), page_key(F.col("target")).alias("k4"))
    asked = asked.select("*", F.explode(F.array_distinct(F.array("k2", "k3", "k4"))).alias("k"))
    asked = asked.select("target", "k", *[(F.col("k") == F.col(x)).alias(x) for x in ("k2", "k3", "k4")])
    held = pages.where("id IS NOT NULL").select(F.col(to).alias("dst"), F.lower("id").alias("low"), page_key(F.col("id")).alias("key"))
    held = held.select("*", F.explode(F.array_distinct(F.array("low", "key"))).alias("k"))
    held = held.groupBy("k").agg(*[F.min(F.when(F.col("k") == F.col(x), F.col("dst"))).alias(x) for x in ("low", "key")])
    best = asked.join(held.hint("shuffle_hash"), "k").groupBy("target").agg(*[F.min(F.when(F.col(k), F.col(x))).alias(k) for k, x in (("k2", "low"), ("k3", "low"), ("k4", "key"))])
    best = best.select("target", F.coalesce("k2", "k3", "k4").alias("dst")).where("dst IS NOT NULL")
    found = tried.where("dst IS NOT NULL").select("src", "dst").unionByName(rest.join(best, "target").select("src", "dst")).where("src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")) if summed else found.withColumn("times", F.lit(1).cast("bigint"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, n_out, n_in, degree`` over distinct directed edges; a mutual link counts at both."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count(F.lit(1)).alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b, times, ways``: one row per linked pair, a < b; ``ways`` counts the directions that are there, however many rows each has."""
    ways = [F.max((x < y).cast("bigint")) for x, y in ((F.col("src"), F.col("dst")), (F.col("dst"), F.col("src")))]
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("times").alias("times"), (ways[0] + ways[1]).alias("ways"))


def link_counts(pairs: DataFrame, every: bool) -> DataFrame:
    """``id, link_count``: every occurrence of a link at both its ends, or each linked pair once."""
    n = F.col("times") if every else F.lit(1)
    both = pairs.select(F.col("a").alias("id"), n.alias("n")).unionByName(pairs.select(F.col("b").alias("id"), n.alias("n")))
    return both.groupBy("id").agg(F.sum("n").alias("link_count"))


def end_counts(pairs: DataFrame) -> DataFrame:
    """``id, n, degree, link_count`` of every linked page, as a table: linked pairs, distinct directed edges, every occurrence of a link."""
    side = lambda x: F.struct(F.col(x).alias("id"), "ways", "times")
    both = pairs.select(F.explode(F.array(side("a"), side("b"))).alias("x"))
    return shared_table(both.groupBy("x.id").agg(F.count(F.lit(1)).alias("n"), F.sum("x.ways").alias("degree"), F.sum("x.times").alias("link_count")))


def shared_sources(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, shared``: sources that both ends of a pair name. nodes: ``id, sources``; arrays are compared pair by pair, so a source that many pages share joins nothing."""
    s = nodes.select("id", _sources().alias("s"))
    j = pairs.select("a", "b").join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return j.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"))


def triangles(sized: DataFrame) -> DataFrame:
    """``u, v, w``: every triangle once; edges point to the end with more links, wedges start at the lowest end. sized: ``a, b, na, nb``, the pairs with the number of pairs at each end."""
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    e = sized.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = e.join(e.select("u", F.col("v").alias("w")), "u").where("v < w")
    return wedge.join(sized.select(F.col("a").alias("v"), F.col("b").alias("w")).hint("shuffle_hash"), ["v", "w"], "left_semi").select("u", "v", "w")


def adamic_adar(sized: DataFrame, degree: DataFrame) -> DataFrame:
    """``a, b, aa``: for each linked pair the sum of 1 / ln(degree) over shared neighbours, degrees below two counting as two. sized: as for ``triangles``."""
    sides = lambda x, y, z: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col(z).alias("id"))
    t = triangles(sized).select(F.explode(F.array(sides("u", "v", "w"), sides("u", "w", "v"), sides("v", "w", "u"))).alias("t")).select("t.*")
    return t.join(degree.select("id", "degree"), "id").groupBy("a", "b").agg(F.sum(1 / F.log(F.greatest(F.col("degree").cast("double"), F.lit(2.0)))).alias("aa"))


def relevance(edges: DataFrame, nodes: DataFrame, pairs: DataFrame | None = None, count: DataFrame | None = None) -> DataFrame:
    """``a, b, ways, shared, aa, weight`` of every linked pair. nodes: ``id, type, sources``. ``pairs``: what ``undirected`` makes of ``edges``, as a table; where it is given, ``edges`` are not read. ``count``: what ``end_counts`` makes of the pairs, if at hand.

    Both ends' types, counts and sources are joined once. Sources go along as hashes, and only pairs that have one of these in
    common are compared by the sources themselves.
    """
    pairs = shared_table(undirected(edges)) if pairs is None else pairs
    count = end_counts(pairs) if count is None else count
    hashes = F.transform(_sources(), lambda x: F.hash(x))
    held = count.select("id", "n").join(nodes.select("id", "type", hashes.alias("s")), "id", "left")
    side = lambda x: held.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("type").alias(f"t{x}"), F.col("s").alias(f"s{x}")).hint("shuffle_hash")
    both = pairs.select("a", "b", "ways").join(side("a"), "a").join(side("b"), "b")
    both = shared_table(both.select("a", "b", "ways", "na", "nb", "ta", "tb", F.coalesce(F.arrays_overlap("sa", "sb"), F.lit(False)).alias("near")))
    shared = shared_sources(both.where("near"), nodes)
    return _scored(both.join(shared, ["a", "b"], "left").join(adamic_adar(both, count), ["a", "b"], "left"))


def _sources() -> Column:
    return F.array_except(F.coalesce("sources", F.array().cast("array<string>")), F.array(F.lit(""), F.lit(None).cast("string")))


def _weighed(pairs: DataFrame, aa: DataFrame, nodes: DataFrame) -> DataFrame:
    types = nodes.select("id", F.col("type"))
    out = pairs.join(shared_sources(pairs, nodes), ["a", "b"], "left").join(aa, ["a", "b"], "left")
    return _scored(out.join(types.select(F.col("id").alias("a"), F.col("type").alias("ta")), "a", "left").join(types.select(F.col("id").alias("b"), F.col("type").alias("tb")), "b", "left"))


def _scored(out: DataFrame) -> DataFrame:
    shared, aa = F.coalesce("shared", F.lit(0)), F.coalesce("aa", F.lit(0.0))
    weight = F.col("ways") * DIRECT + shared * SOURCE + aa * NEIGHBOUR + affinity(F.coalesce("ta", F.lit("")), F.coalesce("tb", F.lit("")))
    return out.select("a", "b", "ways", shared.alias("shared"), aa.alias("aa"), weight.alias("weight"), F.col("ta").alias("type_a"), F.col("tb").alias("type_b"))


def together(held: DataFrame) -> DataFrame:
    """``a, b``: pairs a < b of ids that hold the same key, once each. held: ``id, k``, distinct. A key that many hold is cut into blocks."""
    n = held.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    h = held.join(n, "k")
    left = h.select("k", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    right = h.select("k", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["k", "block"]).where("a < b").select("a", "b").distinct()


def relevance_of_all(edges: DataFrame, nodes: DataFrame, least: float = 0.0) -> DataFrame:
    """As ``relevance``, of every pair of pages of at least ``least`` with a link, a source or a neighbour in common.

    Pairs that have none of these are scored by their types alone and left to ``related_pages``. A pair without link and
    source reaches ``least`` only by its neighbours. The most linked neighbours of a page that together can't lift any pair
    to ``least`` need not be met over: a pair that reaches it has its least linked shared neighbour among the others of both.
    ``edges`` are read several times: hand in a table or checkpoint.
    """
    pairs = shared_checkpoint(undirected(edges))
    linked = pairs.select(F.col("a").alias("id"), F.col("b").alias("k")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("k")))
    count = linked.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    part = 1 / F.log(F.greatest(F.col("degree").cast("double"), F.lit(2.0)))
    hops = shared_checkpoint(linked.join(degrees(edges).select(F.col("id").alias("k"), "degree"), "k").join(count, "id").select("id", "k", "n", "degree", part.alias("part")))
    needed = (least - max(map(max, AFFINITY))) / NEIGHBOUR - 1e-9
    if needed > 0:
        few = hops.where(F.col("n") <= GATHERED)  # of pages with more links, all neighbours are met over
        few = few.withColumn("most", F.sum("part").over(Window.partitionBy("id").orderBy(F.desc("degree"), "k").rowsBetween(Window.unboundedPreceding, 0)))
        met = few.where(F.col("most") >= needed).select("id", "k").unionByName(hops.where(F.col("n") > GATHERED).select("id", "k"))
    else:
        met = hops.select("id", "k")
    cited = nodes.select("id", F.explode("sources").alias("k")).where("k IS NOT NULL AND k <> ''").distinct()
    found = shared_checkpoint(together(met).unionByName(together(cited)).unionByName(pairs.select("a", "b")).distinct())
    size = lambda x: count.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"))
    first = F.col("na") <= F.col("nb")
    e = found.join(size("a"), "a").join(size("b"), "b").select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    aa = e.join(hops.select(F.col("id").alias("u"), "k", "part"), "u").join(hops.select(F.col("id").alias("v"), "k"), ["v", "k"]).groupBy("a", "b").agg(F.sum("part").alias("aa"))
    ways = found.join(pairs.select("a", "b", "ways"), ["a", "b"], "left").select("a", "b", F.coalesce("ways", F.lit(0)).alias("ways"))
    return _weighed(ways, aa, nodes).where(F.col("weight") >= least)


def related_pages(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, n: int = 5, least: float = 0.0, unlike: DataFrame | None = None) -> DataFrame:
    """As ``related``, ranking every other page for each seed, linked or not. nodes: ``id, type, sources``; seeds: ``seed``.

    Where ``least`` is so low that an affinity of types reaches it, pages that share nothing else with the seed are ranked too:
    from the best of them by affinity and id, so many are looked at that ``n`` remain when the seed's own pairs are left out.
    """
    if least > max(map(max, AFFINITY)):
        return related(relevance_of_all(edges, nodes, least), seeds, n, least, unlike)
    ends = ends_of(shared_checkpoint(relevance_of_all(edges, nodes)))
    known = nodes.select("id", F.when(F.col("type").isin(TYPES), F.col("type")).otherwise("").alias("type"))
    own = seeds.select("seed").distinct().join(known.select(F.col("id").alias("seed"), F.col("type").alias("kind")), "seed")
    own = shared_checkpoint(own.join(ends.groupBy("seed").agg(F.count(F.lit(1)).alias("k")), "seed", "left").select("seed", "kind", (F.coalesce("k", F.lit(0)) + n + 1).alias("most")))
    deepest = own.agg(F.max("most")).first()[0] or 0
    pool = known if unlike is None else known.join(unlike.select("id"), "id", "left_anti")
    ranked = []
    for kind in [*TYPES, ""]:
        top = pool.select(F.lit(kind).alias("kind"), "id", affinity(F.lit(kind), F.col("type")).alias("weight")).orderBy(F.desc("weight"), "id").limit(deepest)
        ranked.append(top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), "id"))))
    rest = own.join(reduce(DataFrame.unionByName, ranked), "kind").where("place <= most AND id <> seed").join(ends, ["seed", "id"], "left_anti")
    return _top(ends.join(own.select("seed"), "seed", "left_semi").unionByName(rest.select("seed", "id", "weight")), n, least, unlike)


def ends_of(weighted: DataFrame) -> DataFrame:
    return weighted.select(F.col("a").alias("seed"), F.col("b").alias("id"), "weight").unionByName(weighted.select(F.col("b").alias("seed"), F.col("a").alias("id"), "weight"))


def related(weighted: DataFrame, seeds: DataFrame, n: int = 5, least: float = 0.0, unlike: DataFrame | None = None) -> DataFrame:
    """``seed, id, relevance, turn``: for each seed its ``n`` most relevant pages among the pairs given, of at least ``least``; pages in ``unlike`` (ids) are left out."""
    return _top(ends_of(weighted).join(seeds.select("seed").distinct(), "seed", "left_semi"), n, least, unlike)


def _top(ends: DataFrame, n: int, least: float, unlike: DataFrame | None) -> DataFrame:
    c = ends.where(F.col("weight") >= least)
    c = c if unlike is None else c.join(unlike.select("id"), "id", "left_anti")
    w = Window.partitionBy("seed").orderBy(F.desc("r"), "id")
    return c.withColumn("r", F.round("weight", 9)).withColumn("turn", F.row_number().over(w).cast("bigint")).where(F.col("turn") <= n).select("seed", "id", F.col("r").alias("relevance"), "turn")


def louvain(weighted: DataFrame, resolution: float = 1.0, guard: int = 200) -> DataFrame:
    """``id, community``: communities by modularity gain, all moves of a round made at once, until nothing gains any more.

    A node looks at the communities of its neighbours; the sums over them are one aggregate per round, so a hub is a group of
    partial sums, not of rows. In every round only one half of the nodes (by hash) may move, which keeps pairs from swapping
    for ever. A level ends when two rounds in a row move nothing, or when PATIENCE rounds in a row have not raised the
    modularity by GAIN; its best labels stand. Levels follow, each on the graph of the communities before, until one moves nothing.
    ``guard`` rounds in a level without an end are an error. Communities are numbered by size, 0 the largest, ties by their
    lowest id. Not deterministic in its grouping only across changes of the input; ids never depend on row order.

    Each round over a large graph is a few jobs and a written table. Once a graph, at first or after some levels, has AT_ONCE
    rows at most, one task makes the same moves in arrays: where a graph is looked at changes nothing in what is found. Where
    the ids are numbers and the graph is as small at first, that task does all of it.
    """
    if dict(weighted.dtypes)["a"] == dict(weighted.dtypes)["b"] == "bigint":
        given = weighted.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", F.col("weight").cast("double").alias("w"))
        n, total = given.agg(2 * F.count(F.lit(1)), 2 * F.sum("w")).first()
        if total and n <= AT_ONCE:
            return _found_at_once(given, total, resolution, guard)
    kind = "bigint" if dict(weighted.dtypes)["a"] == "bigint" else "string"
    ends = weighted.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), F.col("weight").cast("double").alias("w"))
    ids = ends.select(F.explode(F.array("a", "b")).alias("id")).where("id IS NOT NULL").distinct()
    names = shared_table(numbered(ids, [F.col("id")], "c").select("id", F.col("c").cast("bigint").alias("c")))
    at = lambda x, y: names.select(F.col("id").alias(x), F.col("c").alias(y))
    e = shared_table(ends.join(at("a", "u"), "a").join(at("b", "v"), "b").select("u", "v", "w"))
    n, total = e.agg(2 * F.count(F.lit(1)), 2 * F.sum("w")).first()
    e = e.select(F.explode(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))).alias("x")).select("x.*")
    if not total:
        return names.select("id", F.lit(0).cast("bigint").alias("community"))
    place, level, last = names, 0, False
    while not last:
        last = n <= AT_ONCE
        label = _levels_at_once(e, total, resolution, level, guard) if last else _level(e, total, resolution, level, guard)
        if label is None:
            break
        place = shared_table(place.join(label.select(F.col("u").alias("c"), F.col("c").alias("n")), "c", "left").select("id", F.coalesce("n", "c").alias("c")))
        if not last:
            up = label.select("u", "c")
            e = shared_table(e.join(up, "u").join(up.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").groupBy(F.col("c").alias("u"), F.col("d").alias("v")).agg(F.sum("w").alias("w")))
            n, level = e.count(), level + 1
    return renumber(place)


#: Rows of a graph (each link both ways) up to which one task moves its nodes: some 100 bytes a row.
AT_ONCE = 6_000_000
#: Rounds without a gain after which a level of the community search ends: one of each half. What counts as a gain, in modularity.
PATIENCE, GAIN = 2, 1e-6


def _level(e: DataFrame, total: float, resolution: float, level: int, guard: int) -> DataFrame | None:
    """``u, c, k``: the best labels that the moves of one level lead to; None if no move gains anything."""
    label = shared_table(e.groupBy("u").agg(F.sum("w").alias("k")).select("u", F.col("u").alias("c"), "k"))
    best, best_q, stale, still, alone = label, None, 0, 0, True
    for r in range(guard):
        mass = label.groupBy("c").agg(F.sum("k").alias("mass"))
        to = e.where("u <> v").join(label.select(F.col("u").alias("v"), F.col("c").alias("t")), "v").groupBy("u", "t").agg(F.sum("w").alias("into"))
        own = label.select("u", F.col("c").alias("t"), F.lit(0.0).alias("into"))
        options = to.unionByName(own).groupBy("u", "t").agg(F.sum("into").alias("into")).join(label, "u").join(mass.withColumnRenamed("c", "t"), "t")
        here = F.col("t") == F.col("c")
        rest = F.col("mass") - F.when(here, F.col("k")).otherwise(0.0)
        gain = F.col("into") - resolution * F.col("k") * rest / total
        chosen = options.groupBy("u", "c", "k").agg(
            F.max_by("t", F.struct(F.round(gain, 9).alias("g"), here.alias("stay"), F.col("t"))).alias("t"),
            F.max(F.when(here, F.col("into") - resolution * F.col("k") * F.col("mass") / total)).alias("q"),
        )
        turn = F.shiftright(F.xxhash64("u"), _bit(level, r)).bitwiseAND(F.lit(1)) == r % 2
        new = shared_table(chosen.select("u", F.when(turn, F.col("t")).otherwise(F.col("c")).alias("c"), "k", (turn & (F.col("t") != F.col("c"))).alias("moved"), "q"))
        # q is the modularity of the labels before the moves, but for what lies within single nodes and never changes
        seen = new.agg(F.sum(F.col("moved").cast("bigint")).alias("moved"), F.sum("q").alias("q")).first()
        if best_q is None or seen.q > best_q + GAIN * total:
            best, best_q, stale, alone = label, seen.q, 0, best_q is None
        else:
            stale += 1
        still = 0 if seen.moved else still + 1
        if still == 2 or stale == PATIENCE:
            return None if alone else best
        label = new.select("u", "c", "k")
    raise RuntimeError(f"communities still move after {guard} rounds")


def _bit(level: int, r: int) -> int:
    """The bit of a node's hash that tells in which of two rounds it may move."""
    return (r // 2 + 17 * level) % 63


def _read(batches) -> list[np.ndarray] | None:
    cols = None
    for b in batches:
        cols = cols or [[] for _ in b.columns]
        for to, c in zip(cols, b.columns, strict=True):
            to.append(c.to_numpy())
    return cols and [np.concatenate(c) for c in cols]


def _written(ids: np.ndarray, c: np.ndarray, names: list[str]):
    for s in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + (1 << 16)]), pa.array(c[s : s + (1 << 16)])], names=names)


def _levels_at_once(e: DataFrame, total: float, resolution: float, level: int, guard: int) -> DataFrame:
    """``u, c``: where the moves of this level and of all that follow lead to, in one task."""

    def run(batches):
        if cols := _read(batches):
            u, v, w, h = cols
            ids, first = np.unique(u, return_index=True)
            yield from _written(ids, ids[settled(np.searchsorted(ids, u), np.searchsorted(ids, v), w, h[first], total, resolution, level, guard)], ["u", "c"])

    return e.select("u", "v", "w", F.xxhash64("u").alias("h")).coalesce(1).mapInArrow(run, "u bigint, c bigint")


def _found_at_once(ends: DataFrame, total: float, resolution: float, guard: int) -> DataFrame:
    """``id, community`` as ``louvain`` gives them, in one task. ends: ``a, b, w``, ids as numbers."""

    def run(batches):
        if cols := _read(batches):
            a, b, w = cols
            ids = np.unique(np.concatenate([a, b]))
            a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
            c = settled(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), hashed(np.arange(len(ids))), total, resolution, 0, guard)
            _, first, c, size = np.unique(c, return_index=True, return_inverse=True, return_counts=True)
            number = np.empty(len(size), np.int64)
            number[np.lexsort((first, -size))] = np.arange(len(size))  # by size, ties by the lowest id
            yield from _written(ids, number[c], ["id", "community"])

    return ends.coalesce(1).mapInArrow(run, "id bigint, community bigint")


def hashed(x: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a bigint."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda y, k: y << np.uint64(k) | y >> np.uint64(64 - k)
    h = turned(x.astype(np.int64).view(np.uint64) * p2, 31) * p1 ^ (p5 + np.uint64(42 + 8))
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)).view(np.int64)


def settled(u: np.ndarray, v: np.ndarray, w: np.ndarray, h: np.ndarray, total: float, resolution: float, level: int, guard: int) -> np.ndarray:
    """For each of the nodes 0 to len(h) - 1 the node that its community is named by once no level moves any more."""
    place, at = np.arange(len(h)), np.arange(len(h))
    u, v, w = _merged(u, v, w, len(h))
    while (c := moved(u, v, w, h[at], total, resolution, level, guard)) is not None:
        kept, c = np.unique(c, return_inverse=True)
        place, at, level = c[place], at[kept], level + 1
        u, v, w = _merged(c[u], c[v], w, len(kept))
    return at[place]


def _merged(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per pair, in the order of the pairs."""
    key, w = _sums(u * n + v, w, n * n)
    return key // n, key % n, w


def _order(key: np.ndarray, most: int) -> np.ndarray:
    """The rows in the order of their keys, which are below ``most``. Where a key and its row fit one number, these are sorted, which is faster."""
    bits = len(key).bit_length()
    if most.bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    both = key << bits
    both |= np.arange(len(key))
    both.sort()
    both &= (1 << bits) - 1
    return both


def _sums(key: np.ndarray, w: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and the sums of ``w`` over each. Keys are below ``most``."""
    order = _order(key, most)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], np.add.reduceat(w[order], starts)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length tells, one run behind the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def moved(u: np.ndarray, v: np.ndarray, w: np.ndarray, h: np.ndarray, total: float, resolution: float, level: int, guard: int) -> np.ndarray | None:
    """The labels that ``_level`` would find, of nodes 0 to len(h) - 1; None if no move gains anything. Each link is there once each way, in the order of ``u, v``.

    A node's sums over its neighbours' communities stand until one of these moves, in the rows of its links; all else follows the nodes that move.
    """
    n = len(h)
    k = np.bincount(u, w, n)
    other = u != v
    u, v, w = u[other], v[other], w[other]
    count = np.bincount(u, minlength=n)
    start = np.cumsum(count) - count
    back = np.empty(len(u), np.int64)  # of each row, the one of the other way
    back[_order(v * n + u, n * n)] = np.arange(len(u))
    del u, other
    c, mass, inside = np.arange(n), k, 0.0
    there, old, groups, to, into = v.copy(), count > 0, np.zeros(n, np.int64), np.empty(len(v), np.int64), np.empty(len(v))
    best, best_q, stale, still, alone = c, None, 0, 0, True
    for r in range(guard):
        q = float(inside - resolution * (mass * mass).sum() / total)
        mine = np.flatnonzero(((h >> np.int64(_bit(level, r)) & 1) == r % 2) & (count > 0))  # only they are looked at
        new = c
        if len(mine):
            again = mine[old[mine]]
            if len(again):
                rows = _runs(start[again], count[again])
                key, sums = _sums(np.repeat(np.arange(len(again)) * n, count[again]) + there[rows], w[rows], len(again) * n)
                node = key // n
                groups[again] = np.bincount(node, minlength=len(again))
                at = _runs(start[again], groups[again])
                to[at], into[at], old[again] = key - node * n, sums, False
            length = groups[mine]
            end = np.cumsum(length)
            first = end - length
            at, own_k = _runs(start[mine], length), k[mine]
            t = to[at]
            home = np.flatnonzero(t == np.repeat(c[mine], length))
            its = np.searchsorted(first, home, side="right") - 1
            rest = mass[t]
            rest[home] -= own_k[its]
            gain = np.round(into[at] - np.repeat(resolution * own_k, length) * rest / total, 9)
            most = np.maximum.reduceat(gain, first)
            even = np.flatnonzero(gain == np.repeat(most, length))
            top = t[even[np.searchsorted(even, end) - 1]]  # the last of them is the highest
            stay = np.round(0.0 - resolution * own_k * (mass[c[mine]] - own_k) / total, 9)  # where no neighbour is of the own community
            stay[its] = gain[home]
            new = c.copy()
            new[mine] = np.where(stay >= most, c[mine], top)
        if best_q is None or q > best_q + GAIN * total:
            best, best_q, stale, alone = c, q, 0, best_q is None
        else:
            stale += 1
        left = np.flatnonzero(new != c)
        still = 0 if len(left) else still + 1
        if still == 2 or stale == PATIENCE:
            return None if alone else best
        if len(left):
            rows = _runs(start[left], count[left])
            far, goes = v[rows], np.repeat(new[left], count[left])
            # a link of two nodes that move is met from both of them, any other from one
            change = w[rows] * (1.0 + (new[far] == c[far])) * ((goes == new[far]) * 1.0 - (np.repeat(c[left], count[left]) == c[far]))
            inside += float(change.sum())
            there[back[rows]], old[far] = goes, True
            mass = np.bincount(new, k, n)
        c = new
    raise RuntimeError(f"communities still move after {guard} rounds")


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in an order, without one task for all: sorted by ranges, counted per range, numbered within."""
    held = shared_checkpoint(df.orderBy(*by).withColumn("_range", F.spark_partition_id()))
    counts = sorted((r["_range"], r["count"]) for r in held.groupBy("_range").count().collect())
    before, start = [], 0
    for at, n in counts:
        before.append((at, start))
        start += n
    offsets = df.sparkSession.createDataFrame(before, "_range int, _before bigint")
    w = Window.partitionBy("_range").orderBy(*by)
    return held.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.row_number().over(w) - 1).drop("_range", "_before")


def renumber(place: DataFrame) -> DataFrame:
    """Communities as numbers by descending size, ties by their lowest id."""
    sizes = place.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return place.join(numbered(sizes, [F.desc("n"), F.col("first")], "community").select("c", "community"), "c").select("id", "community")


def modularity(weighted: DataFrame, communities: DataFrame) -> DataFrame:
    """One row ``q`` of weighted modularity."""
    c = communities.select("id", "community")
    j = weighted.join(c.select(F.col("id").cast("string").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("id").cast("string").alias("b"), F.col("community").alias("cb")), "b")
    ends = j.select(F.col("ca").alias("c"), "weight").unionByName(j.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    both = j.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    return both.crossJoin(ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk"))).select((F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("q"))


def placed(pairs: DataFrame, communities: DataFrame) -> DataFrame:
    """``a, b, ca, cb``: pairs with the communities of their ends, which both have one."""
    side = lambda x: communities.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")).hint("shuffle_hash")
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb")


def cohesion(inner: DataFrame, communities: DataFrame) -> DataFrame:
    """``community, n_nodes, cohesion``: inner pairs over possible ones (0 for a single node). inner: as ``placed`` gives them."""
    inner = inner.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("n_inner"))
    size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))
    possible = F.greatest(F.col("n_nodes") * (F.col("n_nodes") - 1) / 2, F.lit(1.0))
    return size.join(inner, "community", "left").select("community", "n_nodes", (F.coalesce("n_inner", F.lit(0)) / possible).alias("cohesion"))


def community_stats(pairs: DataFrame, communities: DataFrame, nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """``community, n_nodes, cohesion, top_nodes``: as ``cohesion``, with the five most linked labels."""
    w = Window.partitionBy("community").orderBy(F.desc(F.coalesce("link_count", F.lit(0))), "id")
    top = communities.join(counts, "id", "left").withColumn("r", F.row_number().over(w)).where("r <= 5").join(nodes.select("id", "label"), "id", "left")
    top = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), "|").alias("top_nodes"))
    return cohesion(placed(pairs, communities), communities).join(top, "community", "left").select("community", "n_nodes", "cohesion", "top_nodes")


def _name(nodes: DataFrame) -> Column:
    """What names a page: ``name`` where ``id`` is only its number, in the order of the names."""
    return F.col("name") if "name" in nodes.columns else F.col("id")


def surprising(weighted: DataFrame, nodes: DataFrame, communities: DataFrame, counts: DataFrame, n: int = 5) -> DataFrame:
    """``a, b, score, reasons``: linked pairs that one wouldn't expect, the ``n`` of the highest score of three or more. nodes: ``id, type`` and, where ids are numbers, ``name``."""
    info = nodes.where(~F.lower(_name(nodes)).isin(STRUCTURAL[:3])).join(communities, "id", "left").join(counts, "id", "left")
    info = shared_table(info.select("id", "type", "community", F.coalesce("link_count", F.lit(0)).alias("n")))
    most = counts.agg(F.max("link_count").alias("most"))
    side = lambda x: info.select(F.col("id").alias(x), F.col("type").alias(f"t{x}"), F.col("community").alias(f"c{x}"), F.col("n").alias(f"n{x}")).hint("shuffle_hash")
    j = weighted.select("a", "b", "weight").join(side("a"), "a").join(side("b"), "b").crossJoin(F.broadcast(most))
    far = reduce(lambda x, y: x | y, [((F.col("ta") == p) & (F.col("tb") == q)) | ((F.col("ta") == q) & (F.col("tb") == p)) for p, q in DISTANT])
    tests = [
        (F.col("ca") != F.col("cb"), 3, "communities"), (far, 2, "distant types"), (~far & (F.col("ta") != F.col("tb")), 1, "types"),
        ((F.least("na", "nb") <= 2) & (F.greatest("na", "nb") >= 0.5 * F.col("most")), 2, "edge and hub"), ((F.col("weight") > 0) & (F.col("weight") < 2), 1, "weak"),
    ]
    score = sum((F.when(t, p).otherwise(0) for t, p, _ in tests), F.lit(0))
    reasons = F.concat_ws("|", *[F.when(t, r) for t, _, r in tests])
    w = Window.orderBy(F.desc("score"), "a", "b")
    top = j.select("a", "b", score.cast("bigint").alias("score"), reasons.alias("reasons")).where("score >= 3").orderBy(F.desc("score"), "a", "b").limit(n)
    if "name" in nodes.columns:
        for x in "ab":
            top = top.join(nodes.select(F.col("id").alias(x), F.col("name").alias(f"name_{x}")), x)
        top = top.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "score", "reasons")
    return top.withColumn("turn", F.row_number().over(w).cast("bigint"))


def neighbour_communities(linked: DataFrame) -> DataFrame:
    """``id, n_communities``: different communities among a page's neighbours. linked: as ``placed`` gives them."""
    ends = linked.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("cb").alias("community")), F.struct(F.col("b").alias("id"), F.col("ca").alias("community")))).alias("x"))
    return ends.select("x.*").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_communities"))


def knowledge_gaps(pairs: DataFrame, nodes: DataFrame, communities: DataFrame, counts: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``kind, key, n``: pages with one link at most, communities of three or more that hardly hang together, pages between three or more communities. nodes: ``id, label`` and, where ids are numbers, ``name``; ``stats``: as ``community_stats`` or ``cohesion`` gives them, if at hand."""
    linked = nodes.join(counts, "id", "left").select(_name(nodes).alias("key"), F.coalesce("link_count", F.lit(0)).cast("bigint").alias("n"))
    alone = linked.where(~F.lower("key").isin(STRUCTURAL[:3]) & (F.col("n") <= 1)).select(F.lit("isolated").alias("kind"), "key", "n")
    both = placed(pairs, communities)
    if stats is None:
        both = shared_table(both)
        stats = cohesion(both, communities)
    sparse = stats.where("cohesion < 0.15 AND n_nodes >= 3").select(F.lit("sparse").alias("kind"), F.col("community").cast("string").alias("key"), F.col("n_nodes").alias("n"))
    bridges = neighbour_communities(both).where("n_communities >= 3")
    bridges = bridges.join(nodes.select("id", "name"), "id") if "name" in nodes.columns else bridges
    bridges = bridges.select(F.lit("bridge").alias("kind"), _name(nodes).alias("key"), F.col("n_communities").alias("n"))
    return alone.unionByName(sparse).unionByName(bridges)


def gap_report(gaps: DataFrame, nodes: DataFrame, stats: DataFrame, limit: int = 8, bridges: int = 3, names: int = 5) -> DataFrame:
    """``turn, kind, title, n, names``: the gaps as a report of ``limit`` rows at most, which is the feature.

    One row stands for all isolated pages and names the first of them; sparse communities follow in order of their numbers
    under their most linked page; then the ``bridges`` pages that join most communities. Ties go to the lower id.
    """
    labels = nodes.select(_name(nodes).alias("key"), "label")
    alone = gaps.where("kind = 'isolated'")
    few = alone.join(labels, "key").orderBy("key").limit(names)
    few = few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "label"))), lambda x: x.label), ", ").alias("names"))
    one = alone.agg(F.count(F.lit(1)).alias("n")).where("n > 0").crossJoin(few).select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("a"), F.lit("").alias("b"), F.lit("isolated").alias("kind"), F.concat(F.col("n").cast("string"), F.lit(" isolated pages")).alias("title"), "n", "names")
    sparse = gaps.where("kind = 'sparse'").join(stats.select(F.col("community").cast("string").alias("key"), "top_nodes"), "key")
    sparse = sparse.select(F.lit(1).alias("part"), F.col("key").try_cast("bigint").alias("a"), F.col("key").alias("b"), "kind", F.substring_index("top_nodes", "|", 1).alias("title"), "n", F.replace("top_nodes", F.lit("|"), F.lit(", ")).alias("names"))
    most = gaps.where("kind = 'bridge' AND NOT lower(key) IN ('index', 'log', 'overview')").orderBy(F.desc("n"), "key").limit(bridges).join(labels, "key")
    most = most.select(F.lit(2).alias("part"), (-F.col("n")).alias("a"), F.col("key").alias("b"), "kind", F.col("label").alias("title"), "n", F.col("key").alias("names"))
    order = ["part", "a", "b"]
    top = one.unionByName(sparse).unionByName(most).orderBy(*order).limit(limit)
    return top.withColumn("turn", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("turn", "kind", "title", "n", "names")


def raw_sources(images: DataFrame, files: DataFrame) -> DataFrame:
    """``url, path``: the raw source that an image was taken from; null if its folder names none. images: ``url``; files: ``path``.

    An image lies in media/<slug>/, the slug being that of the source's summary or, from older imports, the file's bare stem;
    of several files the lowest path wins. Both are equi-joins on the slug.
    """
    slug = F.regexp_extract(F.replace("url", F.lit("\\"), F.lit("/")), r"(?:^|/)media/([^/]+)/", 1)

    @F.pandas_udf("string")
    def summary(paths: pd.Series) -> pd.Series:
        return paths.map(T.summary_slug)

    known = files.where("path IS NOT NULL").select("path", summary(T.source_identity(F.col("path"))).alias("a"), M.file_stem(F.col("path")).alias("b"))
    by = known.select("path", F.explode(F.array_distinct(F.array("a", "b"))).alias("slug")).groupBy("slug").agg(F.min("path").alias("path"))
    return images.select("url", slug.alias("slug")).join(by, "slug", "left").select("url", "path")


def is_structural(id_: Column, path: Column) -> Column:
    return F.lower(id_).isin(STRUCTURAL) | F.coalesce(path, F.lit("")).rlike(r"(?i)(?:^|/)(?:index|overview|log|schema|purpose)\.md$")


def visible(nodes: DataFrame, hidden_ids: list[str] = (), hidden_types: list[str] = (), structural: bool = False, isolated: bool = False, most: int | None = None) -> DataFrame:
    """``nodes`` with the reason that hides each, the first that applies; null if it is shown. nodes: ``id, type, path, link_count``."""
    n = F.coalesce("link_count", F.lit(0))
    reason = F.when(F.col("id").isin(list(hidden_ids)), "id").when(F.coalesce("type", F.lit("")).isin(list(hidden_types)), "type")
    if not structural:
        reason = reason.when(is_structural(F.col("id"), F.col("path")), "structural")
    if not isolated:
        reason = reason.when(n <= 0, "isolated")
    if most is not None:
        reason = reason.when(n > most, "links")
    return nodes.withColumn("hidden", reason)


def induced(pairs: DataFrame, shown: DataFrame) -> DataFrame:
    """Pairs both of whose ends are among the ids shown."""
    ids = shown.select("id")
    return pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def graph_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label, id, type and path together hold every word of the query."""
    text = F.lower(F.concat_ws(" ", "label", "id", "type", "path"))
    return nodes.where(reduce(lambda x, y: x & y, [text.contains(w) for w in query.lower().split()], F.lit(True)))


def api_graph(nodes: DataFrame, pairs: DataFrame, q: str | None = None, node_type: str | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes (by id, at most ``limit`` of 1..1000) that match, and the pairs among them. The limit is the feature."""
    n = nodes
    if q:
        n = n.where(F.lower("id").contains(q.lower()) | F.lower("label").contains(q.lower()))
    if node_type:
        n = n.where(F.col("type") == node_type)
    n = n.orderBy("id").limit(max(1, min(limit, 1000)))
    return n, induced(pairs, n)
