"""Core operators on small tables with nulls, blanks, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.functions import blocks, keys, language, text
from pagelattice.functions import markdown as M
from pagelattice.operators import graph, lint, references, search

T = lambda d, h=0: dt.datetime(2024, 1, d, h)


def value(spark, expr, s):
    return spark.createDataFrame([(s,)], "s string").select(expr(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("s", "want"),
    [(" [[A_b  C|x]] ", "a-b-c"), ("wiki/x/A b.md", "a-b"), ("a#part", "a"), ("A--B", "a-b"), ("x\\y\\Z.MD", "z"), ("", "")],
)
def test_page_key(spark, s, want):
    assert value(spark, keys.page_key, s) == want


def test_file_key(spark):
    assert value(spark, keys.file_key, ' "raw\\Sources\\A b.PDF" ') == "a b.pdf"


REFS, PARENTS = "key string, at timestamp_ntz, note string, since int", "key string, since timestamp_ntz, until timestamp_ntz, note int"


def test_orphans_as_of(spark):
    parents = [("a", T(1), T(3), 0), ("a", T(2), T(5), 0), ("a", T(7), None, 0), ("a", T(7), None, 0), ("b", T(4), None, 0), (None, T(1), None, 0), ("c", None, None, 0)]
    refs = [("a", T(1), "1", 0), ("a", T(4, 23), "2", 0), ("a", T(5), "3", 0), ("a", T(6), "4", 0), ("a", T(9), "5", 0), ("b", T(3, 23), "6", 0), ("b", T(4), "7", 0), ("c", T(9), "8", 0),
            (None, T(1), "9", 0), ("a", None, "10", 0), ("z", T(1), "11", 0), ("z", T(1), "11", 0)]
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    assert sorted(x.note for x in references.orphans_as_of(r, p).collect()) == ["11", "11", "3", "4", "6", "8"]
    assert references.orphans_as_of(r, p.limit(0)).count() == 10
    assert references.orphans_as_of(r.limit(0), p).count() == 0


def test_integer_runs(spark):
    p = spark.createDataFrame([(k,) for k in [1, 2, 3, 3, 7, 8, None, 70000]], "k bigint")
    assert sorted((r.run_start, r.run_end) for r in references.contiguous_runs(p, "k").collect()) == [(1, 3), (7, 8), (70000, 70000)]
    c = spark.createDataFrame([(k, 0) for k in [0, 1, 4, 4, 8, 9, -5, None, 70000, 10**12]], "c bigint, k int")
    assert sorted((r.key, r.n_rows) for r in references.orphan_keys(c, "c", p, "k").collect()) == [(-5, 1), (0, 1), (4, 2), (9, 1), (10**12, 1)]
    assert references.orphan_keys(c, "c", p.limit(0), "k").count() == 8


PAGE = '---\ntitle: "A: b"\ntags: [x, "y z"]\nsources:\n  - s1.md\n  - "s 2.md"\ntype: Entity\n---\n# Head\n[[one|1]] and ![pic](a.png) `[[code]]` [[two]]\n'


def test_frontmatter(spark):
    b = lambda c: M.frontmatter_block(c)
    assert value(spark, lambda c: M.scalar_field(b(c), "title"), PAGE) == "A: b"
    assert value(spark, lambda c: M.array_field(b(c), "tags"), PAGE) == ["x", "y z"]
    assert value(spark, lambda c: M.array_field(b(c), "sources"), PAGE) == ["s1.md", "s 2.md"]
    assert value(spark, M.page_type, PAGE) == "entity" and value(spark, M.page_type, "none") == "other"
    assert value(spark, lambda c: M.title(c, F.lit("wiki/my-page.md")), "text") == "my page"
    assert value(spark, lambda c: M.scalar_field(b(c), "title"), None) is None
    new = value(spark, lambda c: M.write_array(c, "tags", F.array(F.lit("q"), F.lit("$1"))), PAGE)
    assert 'tags: ["q", "$1"]\n' in new and new.endswith(PAGE.split("---\n")[2])
    assert 'sources: ["n"]\ntype' in value(spark, lambda c: M.write_array(c, "sources", F.array(F.lit("n"))), PAGE)
    assert '\nrelated: ["n"]\n---' in value(spark, lambda c: M.write_array(c, "related", F.array(F.lit("n"))), PAGE)
    assert value(spark, lambda c: M.write_array(c, "tags", F.array(F.lit("n"))), "no block") == "no block"
    assert "\nupdated: 2024\n---" in value(spark, lambda c: M.set_scalar(c, "updated", F.lit("2024")), PAGE)


def test_links(spark):
    assert value(spark, M.wikilinks, PAGE) == ["one", "code", "two"]
    md = value(spark, M.links_as_markdown, PAGE)
    assert "[1](#one)" in md and "`[[code]]`" in md and "[two](#two)" in md
    gone = F.array(F.lit("one"))
    assert value(spark, lambda c: M.strip_links(c, gone), "a [[One|x]] [[one]] [[two]]") == "a x one [[two]]"
    assert value(spark, lambda c: M.clean_index(c, gone), "# I\n- [[one]] a [[two]]\n- [[two]] b [[one]]\ntext [[one]]") == "# I\n- [[two]] b [[one]]\ntext [[one]]"
    assert [x.url for x in value(spark, M.image_refs, "![a](u) ![b](u) ![c](v w) ![d](v)")] == ["u", "v"]
    assert value(spark, M.local_image_refs, "![[p.png]] ![x](https://h/q.png) ![y](d/r.jpg) ![z](s.txt)") == ["p.png", "d/r.jpg"]
    assert value(spark, lambda c: M.rewrite_alt(c, F.create_map(F.lit("u"), F.lit("new]\nalt"))), "x ![a](u) y ![b](v)") == "x ![new) alt](u) y ![b](v)"
    ctx = value(spark, lambda c: M.image_context(c, F.lit("u"), 3), "abcdef![a](u)ghijkl")
    assert (ctx.before, ctx.after) == ("def", "ghi")
    assert value(spark, lambda c: M.list_union(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), c)), "C") == ["A", "b", "C"]


def test_tokens(spark):
    q = "The 知识图谱, and plough-letters!"
    assert value(spark, text.token_array, q) == text.tokenize(q)
    assert "知识" in text.tokenize(q) and "the" not in text.tokenize(q)


def test_text(spark):
    assert value(spark, text.is_greeting, "Hello there!") and not value(spark, text.is_greeting, "hello world tour")
    assert value(spark, text.citations, "x [2] [1] [2] <!-- cited: 3, 1 -->") == [1, 3] and value(spark, text.citations, "x [2] [1] [2]") == [1, 2]
    assert value(spark, text.strip_reasoning, "<think>a</think> b <think>c") == "b"
    assert value(spark, text.latex_to_unicode, r"$\alpha \leq \beta$") == "α ≤ β"
    assert value(spark, text.query_slug, "  A b: c!  ") == "a-b-c" and value(spark, text.query_slug, "!!") == "query"
    assert text.fnv64("") == "cbf29ce484222325" and text.summary_slug("a/b c.pdf").startswith("1a-3b-c-") and text.summary_slug("x.pdf") == "x"
    assert value(spark, lambda c: text.matches_glob(c, ["*.draft.*", "~$*"]), "d/a.draft.md") is True


@pytest.mark.parametrize(("s", "want"), [("这是中文", "Chinese"), ("これは日本語", "Japanese"), ("der Hund und die Katze", "German"), ("the dog", "English"), ("", "English"), ("این یک متن است که", "Persian"), ("Москва город", "Russian"), (None, None)])
def test_language(spark, s, want):
    assert value(spark, language.detect_language, s) == want


def test_blocks(spark):
    t = "---FILE: wiki/a.md---\r\n```\n---END FILE---\n```\nx\r\n--- end file ---\n---FILE: /etc/x ---\ny\n---END FILE---\n---FILE: wiki/b.md---\nz"
    assert [(b["path"], b["content"], b["problem"]) for b in blocks.file_blocks(t)] == [("wiki/a.md", "```\n---END FILE---\n```\nx", None), ("/etc/x", None, "unsafe path"), ("wiki/b.md", None, "unclosed")]
    assert blocks.file_blocks(None) == [] and blocks.first_object('x {"a": "}{"} y') == '{"a": "}{"}' and blocks.first_object("{") == ""
    r = value(spark, blocks.parse_review_blocks, "---REVIEW: odd | T ---\nbody\nOPTIONS: a | b\nPAGES: p, q\n---END REVIEW---")[0]
    assert (r.type, r.title, r.description, r.options, r.pages) == ("confirm", "T", "body", ["a", "b"], ["p", "q"])
    assert value(spark, blocks.sanitize, "type: x\nrelated: [[a]], [[b]]\n---\nbody") == '---\ntype: x\nrelated: ["[[a]]", "[[b]]"]\n---\nbody'


def test_vector_hits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    rows = [(i, f"p{i % 7}", i, [float(v) for v in x[i]], 1) for i in range(200)] + [(900, "p", 0, None, 1), (901, "p", 0, [1.0], 1), (902, "p", 0, [float("nan")] * 8, 1)]
    c = spark.createDataFrame(rows, "chunk_key bigint, page_id string, chunk_index int, vector array<double>, distance int")
    q = c.where("chunk_key < 5").select(F.col("chunk_key").alias("query_id"), "vector")
    hits = search.vector_hits(c, q, 6)
    got = {(r.query_id, r.hit_rank): r.chunk_key for r in hits.collect()}
    d = ((x[:5, None] - x[None]) ** 2).sum(-1)
    assert got == {(i, r + 1): int(k) for i in range(5) for r, k in enumerate(np.argsort(d[i], kind="stable")[:6])}
    assert search.vector_hits(c, q.limit(0), 6).count() == 0
    scores = search.page_scores(hits).collect()
    assert all(0 < r.vector_score <= 1 for r in scores)


def test_keyword_and_fusion(spark):
    pages = spark.createDataFrame([("a", "wiki/red-boat.md", "Red boat", "a boat, a red boat", 1), ("b", "wiki/b.md", None, None, 1), ("c", "wiki/c.md", "C", "red " * 50, 1)], "page_id string, path string, title string, content string, score int")
    q = spark.createDataFrame([(1, "red boat"), (2, "the"), (3, "")], "query_id bigint, query string")
    got = {(r.query_id, r.page_id): r.score for r in search.keyword_scores(pages, q).collect()}
    assert got[1, "a"] == 50 + 20 + 2 * 5 + 2 and got[1, "c"] == 1 and (1, "b") not in got and (2, "a") not in got
    t = search.token_ranks(search.keyword_scores(pages, q))
    v = spark.createDataFrame([(1, "c", 0.9, 1), (1, "gone", 0.8, 2)], "query_id bigint, page_id string, vector_score double, vector_rank bigint")
    f = [(r.page_id, r.mode) for r in search.fuse(t, v, pages).where("query_id = 1").orderBy("place").collect()]
    assert f == [("c", "hybrid"), ("a", "hybrid")]


def test_graph(spark):
    nodes = spark.createDataFrame([(i, i.upper(), "entity", f"wiki/{i}.md", ["s"] if i in "ab" else None) for i in "abcdef"], "id string, label string, type string, path string, sources array<string>")
    links = [("a", "B"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "e"), ("d", "missing"), ("e", None), ("a", "a")]
    e = graph.resolve_links(spark.createDataFrame(links, "src string, target string"), nodes)
    assert {(r.src, r.dst): r.times for r in e.collect()} == {("a", "b"): 2, ("b", "a"): 1, ("b", "c"): 1, ("c", "a"): 1, ("d", "e"): 1}
    w = {(r.a, r.b): r for r in graph.relevance(e, nodes).collect()}
    assert w["a", "b"].weight == pytest.approx(6 + 4 + 1.5 / np.log(2) + 0.8) and w["d", "e"].aa == 0
    c = {r.id: r.community for r in graph.louvain(graph.relevance(e, nodes)).collect()}
    assert c["a"] == c["b"] == c["c"] != c["d"] == c["e"]
    q = graph.modularity(graph.relevance(e, nodes), graph.louvain(graph.relevance(e, nodes))).first().q
    assert q > 0.2
    assert graph.relevance(e.limit(0), nodes).count() == 0
    found = {(r.kind, r.page) for r in lint.structural_findings(nodes, spark.createDataFrame(links, "src string, target string")).collect()}
    assert found == {("orphan", "d"), ("orphan", "f"), ("broken-link", "d"), ("no-outlinks", "e"), ("no-outlinks", "f")}


def test_core_does_not_import_llm():
    import pathlib

    import pagelattice

    root = pathlib.Path(pagelattice.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "pagelattice.llm" in p.read_text()]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40
