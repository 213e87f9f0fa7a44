"""Operators that must do the whole job, against brute force on small tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.operators import graph
from pagelattice.plans import graph as plan
from pagelattice.plans import upkeep


def scores(pages, edges):
    """Relevance of every pair as the reference has it: each page against every other."""
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in pages}
    degree = {i: sum(i == a for a, _ in edges) + sum(i == b for _, b in edges) for i in pages}
    row = lambda t: graph.TYPES.index(t) if t in graph.TYPES else None
    out = {}
    for i, (t, s) in pages.items():
        for j, (u, r) in pages.items():
            if i != j:
                kind = graph.AFFINITY[row(t)][row(u)] if None not in (row(t), row(u)) else 0.5
                aa = sum(1 / math.log(max(degree[z], 2)) for z in near[i] & near[j])
                out[i, j] = 3 * (((i, j) in edges) + ((j, i) in edges)) + 4 * len(set(s or []) & set(r or [])) + 1.5 * aa + kind
    return out


@pytest.mark.parametrize("least", [0.0, 0.9, 2.0, 3.5])
def test_related_pages_ranks_every_page(spark, monkeypatch, least):
    monkeypatch.setattr(graph, "BLOCK", 4)
    r = random.Random(3)
    ids = [f"p{i:02d}" for i in range(40)]
    pages = {i: (r.choice([*graph.TYPES, "other", None]), r.choice([None, [], ["s"], [f"s{r.randrange(9)}", f"s{r.randrange(9)}"]])) for i in ids}
    edges = {(r.choice(ids[:30]), r.choice(ids[:3] + ids)) for _ in range(90)} | {(i, "p00") for i in ids[5:25]}
    edges = {(a, b) for a, b in edges if a != b}
    nodes = spark.createDataFrame([(i, *x) for i, x in pages.items()], "id string, type string, sources array<string>")
    e = spark.createDataFrame([(*x, 1) for x in sorted(edges)], "src string, dst string, times bigint")
    seeds, unlike = ids[:20] + ids[35:], {"p07"}
    got = {}
    for x in graph.related_pages(e, nodes, spark.createDataFrame([(i,) for i in seeds], "seed string"), 4, least, nodes.where("id = 'p07'")).collect():
        got[x.seed, x.turn] = (x.id, pytest.approx(x.relevance))
    want = {}
    s = scores(pages, edges)
    for i in seeds:
        best = sorted((-round(w, 9), j) for (k, j), w in s.items() if k == i and w >= least and j not in unlike)
        want |= {(i, n): (j, -w) for n, (w, j) in enumerate(best[:4], 1)}
    assert want == got and (least > 2 or any((i, j) not in edges and (j, i) not in edges for (i, _), (j, _) in want.items()))


def test_merged_pages_reads_every_member(spark):
    page = lambda title, tags, *lists: f"---\ntitle: {title}\ntags: [{tags}]\n" + "".join(f"{x}\n" for x in lists) + f"---\n\nBody of {title}\n"
    rows = [
        (1, 3, page("C", "z, x", "sources: [s3.md]")), (1, 1, page("A", "x", "type: entity")), (1, 2, page("B", "y", "related: [r2]")), (1, 4, None), (1, 5, page("E", "w")), (1, 5, page("E", "w")),
        (2, 1, None), (2, 2, page("B", "k")), (3, 1, None), (3, 2, page("X", "a")), (3, 3, page("Y", "b")), (4, 1, None), (5, 1, page("P", "m")), (5, 2, page("Q", "n")), (None, 1, page("N", "n")),
    ]
    got = {r.request_id: (r.title, r.tags, r.sources, r.related) for r in upkeep.read_merged(spark.createDataFrame(rows, "request_id bigint, member_no int, content string")).collect()}
    assert got == {1: ("A", "x|y|z|w", "s3.md", "r2"), 2: ("B", "k", "", ""), 3: ("X", "a|b", "", ""), 5: ("P", "m|n", "", "")}


def test_insights_over_found_communities(spark):
    groups = [[f"{g}{i}" for i in range(6)] for g in "wxyz"]  # every group has pages of one letter, but page q is in the first
    groups[0][5] = "q"
    types = {p: "entity" for g in groups for p in g} | {"x0": "concept"}
    edges = {(a, b) for g in groups for a in g for b in g if a < b} | {("w0", "x0"), ("q", "y0"), ("q", "z0")}
    nodes = spark.createDataFrame([(p, p, t, []) for p, t in types.items()] + [("lone", "lone", "entity", [])], "id string, label string, type string, sources array<string>")
    e = spark.createDataFrame([(a, b, 1) for a, b in sorted(edges)], "src string, dst string, times bigint")
    nodes, weighted, pairs, counts, c = plan.found_graph(nodes, e)
    place = {r.id: r.community for r in c.collect()}
    assert all(len({place[p] for p in g}) == 1 for g in groups) and len({place[g[0]] for g in groups}) == 4
    got = {(r.a, r.b): (r.score, r.reasons) for r in graph.surprising(weighted, nodes, c, counts, 50).collect()}
    assert got == {("w0", "x0"): (4, "communities|types"), ("q", "y0"): (3, "communities"), ("q", "z0"): (3, "communities")}
    assert {(r.kind, r.key, r.n) for r in graph.knowledge_gaps(pairs, nodes, c, counts).collect()} == {("isolated", "lone", 0), ("bridge", "q", 3)}


def records_of_pages(spark):
    """Four groups of pages with a page q between them, an older record, a page that is nobody's, one without a name, one left out of gaps."""
    groups = [[f"{g}{i}" for i in range(6)] for g in "wxyz"]
    near = {a: [b for b in g if a < b] for g in groups for a in g} | {"q": ["[[w1]]", "y 0", "Y1", "Z-0", "z1", "q", None, " "]}
    near["w0"].append("X0")
    rows = [(i, p, None, "concept" if p == "x0" else " Entity", f"wiki/{p}.md", ["s", None, ""] if p in ("w0", "x0") else None, to, i, i) for i, (p, to) in enumerate(near.items())]
    rows += [(90, "z0", "old", "query", None, None, ["w2"], -1, 90), (91, "lone", None, None, None, None, None, 5, 5), (92, None, "none", None, None, None, ["w0"], 5, 5), (93, "Index", "i", None, None, None, None, 5, 5)]
    return spark.createDataFrame(rows, "node_id bigint, page_id string, title string, node_type string, path string, sources array<string>, out_links array<string>, updated_at bigint, ingested_at bigint")


def by_name_and_number(spark):
    records = records_of_pages(spark)
    nodes = plan._latest(records)
    named = plan.found_graph(nodes, plan._edges(nodes))
    n = plan.numbered_nodes(records)
    return named, plan.found_graph(n, graph.resolve_links(plan._links(n), n.select(F.col("name").alias("id"), F.col("id").alias("n")), "n"))


def test_gap_report_over_numbered_pages(spark):
    named, numbers = by_name_and_number(spark)
    place = [r.name for r in numbers[0].orderBy("id").collect()]
    assert place == sorted(place) and len(place) == 27 and numbers[2].dtypes[:2] == [("a", "bigint"), ("b", "bigint")]
    names = dict(numbers[0].select("id", "name").collect())
    assert {(names[int(r.id)], r.community) for r in numbers[4].collect()} == {(r.id, r.community) for r in named[4].collect()}
    got = []
    for nodes, _, pairs, counts, c in (named, numbers):
        stats = graph.community_stats(pairs, c, nodes, counts)
        got.append(graph.gap_report(graph.knowledge_gaps(pairs, nodes, c, counts, stats), nodes, stats).collect())
    assert got[0] == got[1] and [(r.kind, r.title, r.names) for r in got[0]][:1] == [("isolated", "1 isolated pages", "lone")]
    assert ("bridge", "q", "q") in [(r.kind, r.title, r.names) for r in got[0]]


def test_knowledge_gaps_over_numbered_pages(spark):
    got = [{tuple(r) for r in graph.knowledge_gaps(pairs, nodes, c, counts).collect()} for nodes, _, pairs, counts, c in by_name_and_number(spark)]
    assert got[0] == got[1] == {("isolated", "lone", 0), ("bridge", "q", 3)}


def test_surprising_links_over_numbered_pages(spark):
    got = [graph.surprising(weighted, nodes, c, counts, 50).collect() for nodes, weighted, _, counts, c in by_name_and_number(spark)]
    assert got[0] == got[1] and {(r.a, r.b, r.reasons) for r in got[0]} >= {("w0", "x0", "communities|types"), ("q", "y1", "communities")}


def test_links_resolved_unsummed_make_the_same_pairs(spark):
    pages = spark.createDataFrame([("b-c", 1), ("B c", 2), ("b c", 3), ("dir", 4), ("x", 5), (None, 6)], "id string, n bigint")
    asked = ["b-c", "b c", "B  C", "B C", "[[Dir|d]]", "\u2003wiki\\DIR.MD#top\u2003", "x", "x", "y", "[[]]", None, " "]
    links = spark.createDataFrame([(i, t) for i in (1, 5, 6) for t in asked], "src bigint, target string")
    rows = graph.resolve_links(links, pages, "n", summed=False)
    got = {(r.src, r.dst): r.times for r in rows.groupBy("src", "dst").agg(F.sum("times").alias("times")).collect()}
    summed = graph.resolve_links(links, pages, "n")
    # in lower case with hyphens "B C" is page 1 before it is page 2 or 3; both last spellings of dir are found by their keys
    to = {1: 3, 3: 1, 4: 2, 5: 2}
    assert got == {(r.src, r.dst): r.times for r in summed.collect()} == {(i, j): k for i in (1, 5, 6) for j, k in to.items() if i != j}
    assert set(graph.undirected(rows).collect()) == set(graph.undirected(summed).collect())
    assert {(r.a, r.b): (r.times, r.ways) for r in graph.undirected(rows).collect()}[1, 5] == (5, 2)


def test_communities_of_numbers_are_found_in_one_task(spark, monkeypatch):
    rnd = random.Random(7)
    links = {(min(a, b), max(a, b)) for a in range(400) for b in [a // 20 * 20 + rnd.randint(0, 19), a // 100 * 100 + rnd.randint(0, 99), rnd.randint(0, 399)] if a != b}
    rows = [(3 * a, 3 * b, rnd.choice([1.0, 2.5, 4.2])) for a, b in sorted(links)]
    numbers = spark.createDataFrame([*rows, (None, 3, 9.0)], "a bigint, b bigint, weight double")
    written, table = [], graph.shared_table
    monkeypatch.setattr(graph, "shared_table", lambda df: written.append(1) or table(df))
    got = {r.id: r.community for r in graph.louvain(numbers).collect()}
    assert not written
    names = spark.createDataFrame([(f"p{a:04d}", f"p{b:04d}", w) for a, b, w in rows], "a string, b string, weight double")
    assert {f"p{i:04d}": c for i, c in got.items()} == {r.id: r.community for r in graph.louvain(names).collect()} and 2 < len(set(got.values())) < 40
    ids = spark.range(-3, 2000, 7).select("id", F.xxhash64("id").alias("h")).collect()
    assert graph.hashed(np.array([r.id for r in ids])).tolist() == [r.h for r in ids]


def test_gaps_rank_no_labels(spark):
    nodes, _, pairs, counts, c = by_name_and_number(spark)[1]
    gaps = graph.knowledge_gaps(pairs, nodes, c, counts)
    assert "Window" not in gaps._jdf.queryExecution().optimizedPlan().toString()
    stats = graph.community_stats(pairs, c, nodes, counts)
    assert set(gaps.collect()) == set(graph.knowledge_gaps(pairs, nodes, c, counts, stats).collect())
