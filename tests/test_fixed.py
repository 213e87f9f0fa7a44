"""Fixed tables and formats, page rewriting, rules as configuration, reading long sources in turn."""

from __future__ import annotations

import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import blocks, text
from pagelattice.functions import markdown as M
from pagelattice.operators import chunks, context, curation, graph, search
from pagelattice.plans import upkeep
from pagelattice.sources import files, store


def value(spark, expr, s, kind="string"):
    return spark.createDataFrame([(s,)], f"s {kind}").select(expr(F.col("s"))).first()[0]


def column(spark, expr, xs):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, s string").orderBy("i").select(expr(F.col("s"))).collect()]


def test_greetings(spark):
    yes = ["hi", "Hello!", "hey there", "howdy", "Good morning.", "greetings", "what's up?", "你好", "您好呀", "早上好！", "在吗", "こんにちは", "안녕하세요", "hola", "bonjour", "ciao", "привет"]
    no = ["", None, "how are you", "thanks", "谢谢你", "hello, how do I train a transformer?", "hi " * 20, "good", ".hi"]
    assert column(spark, text.is_greeting, yes + no) == [True] * len(yes) + [False] * len(no)


def test_latex(spark):
    given = [r"$\xi$ and $\nu$", r"$a \leq \frac{1}{2}$", r"$$x^2$$", r"\alpha outside", r"$\unknown$", r"$5 and $6", "", None, r"$\longrightarrow$"]
    want = ["ξ and ν", "a ≤ /{1}{2}", "\nx^2\n", r"\alpha outside", r"\unknown", r"5 and 6", "", None, "⟶"]
    assert column(spark, text.latex_to_unicode, given) == want


def test_review_titles_and_categories(spark):
    titles = ["Missing page: Foo  Bar", "MissingPage:Foo", "possible duplicate：x", "缺失页面: 水泵", "Missing page Foo", None]
    assert column(spark, text.normalise_review_title, titles) == ["foo bar", "foo", "x", "水泵", "missing page foo", None]
    names = ["a.svg", "a.rtf", "a.csv", "a.yaml", "a.pptx", "a.kt", "x/a.TSV", "makefile", "a.zip", "a", "a.epub", "a.mdx"]
    assert column(spark, text.file_category, names) == ["code", "text", "data", "data", "document", "code", "data", "code", "unknown", "unknown", "document", "markdown"]
    assert column(spark, files.ingestable, ["a.yaml", "a.yml", "a.tsv", "a.epub", ".b.md", "x/.cache/a.md", "a.MD"]) == [True, True, False, False, False, False, True]


def test_index_tokens_and_cited_pages(spark):
    assert value(spark, text.index_tokens, "The map, v1.2 of 知识图谱 map!") == ["map", "v1.2", "知识", "识图", "图谱", "知", "识", "图", "谱", "知识图谱", "map!"]
    pages = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(p).alias("path")) for t, p in (("A", "a.md"), ("B", "b.md"))])
    cited = lambda s: [(r.title, r.path) for r in value(spark, lambda c: text.cited_pages(c, pages), s)]
    assert cited("x [1] <!-- cited: 2, 9 -->") == [("B", "b.md")] and cited("x [2][1][2]") == [("B", "b.md"), ("A", "a.md")]
    assert cited("[7] see [[pump|the pump]], [[q/one]], [[pump]]") == [("the pump", "wiki/entities/pump.md"), ("q/one", "wiki/q/one.md")] and cited("none") == []


PAGE = "---\ntitle: Old\ntags: [a]\n---\n\ntitle: keep me\ntags: [keep, these]\nsources:\n  - keep.md\n"


def test_bodies_are_never_rewritten(spark):
    out = value(spark, lambda c: M.write_array(M.set_scalar(c, "title", F.lit("New $1 \\")), "tags", F.array(F.lit("x"), F.lit("y"))), PAGE)
    assert out == '---\ntitle: New $1 \\\ntags: ["x", "y"]\n---\n\ntitle: keep me\ntags: [keep, these]\nsources:\n  - keep.md\n'
    assert value(spark, lambda c: M.write_array(c, "sources", F.array(F.lit("n"))), PAGE) == PAGE.replace("tags: [a]\n", 'tags: [a]\nsources: ["n"]\n', 1)
    twice = "---\ntitle: a\ntitle: b\n---\nx"
    assert value(spark, lambda c: M.set_scalar(c, "title", F.lit("n")), twice) == "---\ntitle: n\ntitle: b\n---\nx"
    assert value(spark, lambda c: M.set_scalar(c, "title", F.lit("n")), "---\n---\nbody") == "---\ntitle: n\n---\nbody"
    crlf = "---\r\ntags:\r\n  - a\r\n  - b\r\nx: y\r\n---\r\ntags:\r\n  - a\r\n"
    assert value(spark, lambda c: M.write_array(c, "tags", F.array(F.lit("n"))), crlf) == '---\r\ntags: ["n"]\r\nx: y\r\n---\r\ntags:\r\n  - a\r\n'


def test_merging_pages(spark):
    new = "---\ntitle: Newer\ntags: [b]\ntype: concept\n---\n\nOther body, long enough to stand for itself.\ntitle: and this\n"
    merge = lambda o, n, body=None: spark.createDataFrame([(o, n, body)], "o string, n string, b string").select(curation.merge_pages(F.col("o"), F.col("n"), None if body is None else F.col("b"), F.lit("2025-06-01"))).first()[0]
    assert merge(PAGE, new) == new.replace("tags: [b]", 'tags: ["a", "b"]', 1).replace("title: Newer", "title: Old").replace("concept\n---", "concept\nupdated: 2025-06-01\n---")
    body = "\nA body of both, as a model would write it, with all that the two of them say about it.\ntags: [in, body]\n"
    assert merge(PAGE, new, body) == f'---\ntitle: Old\ntags: ["a", "b"]\ntype: concept\nupdated: 2025-06-01\n---\n{body}'
    assert merge(PAGE, new, "short") == new.replace("tags: [b]", 'tags: ["a", "b"]', 1)
    assert merge(None, new) == new and merge(PAGE, None) == PAGE and merge(PAGE, PAGE, body) == PAGE and merge("no block", new, body) == new


def test_joined_pages_keep_their_bodies(spark):
    rows = [(1, 1, PAGE), (1, 2, "---\ntitle: B\nsources: [s]\n---\nSecond.\ntitle: b\n"), (2, 1, PAGE)]
    got = {r.request_id: r.page for r in upkeep.joined_pages(spark.createDataFrame(rows, "request_id bigint, member_no int, content string")).collect()}
    assert got[2] == PAGE
    assert got[1] == '---\ntitle: Old\nsources: ["s"]\ntags: ["a"]\nupdated: 2025-06-01\n---\n\ntitle: keep me\ntags: [keep, these]\nsources:\n  - keep.md\n\nSecond.\ntitle: b\n'


def test_yaml_blocks():
    got = M.parsed_frontmatter("---\na: 1\nb: null\nc:\n  - x\n  - y: z\nd: |\n  two\n  lines\ne: true\nf:\n---\nbody")
    assert got == {"a": "1", "b": "", "c": '["x", {"y": "z"}]', "d": "two\nlines\n", "e": "true", "f": ""}
    assert M.parsed_frontmatter("---\nrelated: [[a]], [[b]]\n---\n") == {"related": '["[[a]]", "[[b]]"]'}
    assert M.parsed_frontmatter("---\n- list\n---\n") is None and M.parsed_frontmatter("---\na: [\n---\n") is None and M.parsed_frontmatter("text") is None and M.parsed_frontmatter(None) is None


def test_frontmatter_yaml_column(spark):
    assert column(spark, M.frontmatter_yaml, ["---\na: [1, 2]\n---\n", None, "x"]) == [{"a": '["1", "2"]'}, None, None]


def test_watch_rules(spark):
    r = files.WatchRules.of(include=[".MD, txt，md"], folders=["build, raw/old"], megabytes=99999)
    assert (r.include, r.folders, r.megabytes, files.WatchRules.of(megabytes=0).megabytes) == (("md", "txt"), ("build", "raw/old"), 4096, 1)
    paths = ["raw/a.md", "raw/old/a.md", "x/raw/old/b.md", "Build/a.txt", "a.pdf", ".a.md", "a.draft.md", "noext"]
    assert column(spark, lambda c: files.allowed(c, r), paths) == [True, False, False, False, False, False, False, False]
    assert column(spark, files.watched, ["raw/sources/a.csv", "raw/sources/node_modules/a.csv", "wiki/a.md", "wiki/a.txt", "purpose.md"]) == [True, False, True, False, True]


def ods(rows):
    ns = 'xmlns:office="o" xmlns:table="t" xmlns:text="x"'
    cell = lambda c: f'<table:table-cell office:value-type="float" office:value="{c}"/>' if isinstance(c, float) else f"<table:table-cell><text:p>{c}</text:p></table:table-cell>"
    body = "".join("<table:table-row>" + "".join(map(cell, r)) + '<table:table-cell table:number-columns-repeated="1000"/></table:table-row>' for r in rows)
    xml = f'<office:document-content {ns}><table:table table:name="S">{body}<table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="1000"/></table:table-row></table:table></office:document-content>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("content.xml", xml)
    return b.getvalue()


def test_open_spreadsheets():
    assert files.read_text("ods", "a.ods", ods([["h", "k|l"], [1.0, 2.5], ["x"]])) == ("| h | k\\|l |\n| --- | --- |\n| 1 | 2.50 |\n| x |  |", None)


def test_raw_sources(spark):
    nested = "raw/sources/a/b c.pdf"
    f = spark.createDataFrame([(nested,), ("raw/sources/top.md",), ("raw/sources/z/top.txt",), (None,)], "path string")
    slug = text.summary_slug("a/b c.pdf")
    urls = [f"media/{slug}/img-1.png", "/x/wiki/media/top/img-2.png", "media\\b c\\i.png", "media/none/i.png", "other/top/i.png", None]
    got = {r.url: r.path for r in graph.raw_sources(spark.createDataFrame([(u,) for u in urls], "url string"), f).collect()}
    assert got == {urls[0]: nested, urls[1]: "raw/sources/top.md", urls[2]: nested, urls[3]: None, urls[4]: None, None: None}


def test_objects_with_many_open_braces():
    assert blocks.first_object('{ "a{b}": ') == "{b}" and blocks.first_object("{ { {x} ") == "{x}" and blocks.first_object('{"a": "\\"}"}') == '{"a": "\\"}"}'
    began = time.time()
    assert blocks.first_object("{" * 200_000) == "" and time.time() - began < 5


def test_unreadable_state_is_told(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": 1, "s": "a"}\n{"id": \n{"id": 2}\n')
    p = str(tmp_path / "s.json")
    assert sorted((r.id, r.s) for r in store.load_state(spark, p, "id int, s string").collect()) == [(1, "a"), (2, None)]
    assert [r.line for r in store.unreadable_state(spark, p, "id int, s string").collect()] == ['{"id": ']
    assert store.unreadable_state(spark, str(tmp_path / "none"), "id int").count() == 0


def test_sections():
    r = blocks.review_blocks("---REVIEW: duplicate | T---\nOPTIONS: a|b\ntext\nSEARCH: x | y ---END REVIEW---\n---REVIEW: odd---\nz\n---END REVIEW---\n---review: Suggestion | U ---\nopen")
    assert r == [{"type": "duplicate", "title": "T", "description": "text", "options": ["a", "b"], "pages": [], "searches": ["x", "y"]}]
    lint = blocks.lint_blocks("---LINT: Orphan | INFO | t ---\nd\nPAGES: p, q\n---END LINT---")
    assert lint == [{"type": "orphan", "severity": "info", "title": "t", "detail": "d", "pages": ["p", "q"]}] and blocks.lint_blocks(None) == []
    assert blocks.repaired(None) is None and blocks.repaired("# A\n---\n") == "# A\n---\n" and blocks.repaired("title: a\n# H\n---\n") == "title: a\n# H\n---\n"


def test_token_ranks_of_wanted_pages(spark):
    s = spark.createDataFrame([(1, f"p{i:03d}", 100 - i // 3, False) for i in range(90)] + [(2, "z", 1, True)], "query_id bigint, page_id string, score bigint, title_match boolean")
    whole = {(r.query_id, r.page_id): r.token_rank for r in search.token_ranks(s).collect()}
    wanted = spark.createDataFrame([(1, "p070"), (1, "p002"), (1, "gone"), (2, "z")], "query_id bigint, page_id string")
    some = {(r.query_id, r.page_id): r.token_rank for r in search.token_ranks(s, 5, wanted).collect()}
    assert some == {k: v for k, v in whole.items() if v <= 5 or k == (1, "p070")}


def test_rate_windows_longer_than_a_day(spark):
    rows = [("a", f"2024-01-0{d} 12:00:00") for d in (1, 2, 3, 4, 5)]
    r = spark.createDataFrame(rows, "client string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [x.recent for x in context.rate_limited(r, 2, 3 * 86400).orderBy("at").collect()] == [1, 2, 3, 3, 3]


def test_long_sources_are_taken_up_again(spark):
    body = "\n\n".join(f"Paragraph {i}. " + "word " * 400 for i in range(40))
    src = spark.createDataFrame([("s", body), ("short", "one"), (None, body), ("t", None)], "key string, text string")
    none = spark.createDataFrame([], chunks.PROGRESS)

    def ask(key, digest, piece):
        return f"{len(digest)}:{piece[:12]}", digest + "+"

    def fails(key, digest, piece):
        if len(digest) == 2:
            raise RuntimeError("gone")
        return ask(key, digest, piece)

    whole = chunks.read_long_sources(src, none, ask, 20_000).collect()
    assert [(r.key, r.completed == r.total > 3, r.problem) for r in whole] == [("s", True, None)]
    part = chunks.read_long_sources(src, none, fails, 20_000)
    assert [(r.completed, r.problem, len(r.analyses)) for r in part.collect()] == [(2, "RuntimeError: gone", 2)]
    again = chunks.read_long_sources(src, spark.createDataFrame(part.collect(), chunks.PROGRESS), ask, 20_000).first()
    assert (again.analyses, again.digest) == (whole[0].analyses, whole[0].digest)
    assert chunks.read_long_sources(src, spark.createDataFrame(part.collect(), chunks.PROGRESS), ask, 20_000, steps=1).first().completed == 3
    # another budget or another text begins anew
    assert chunks.read_long_sources(src, part, ask, 30_000, steps=1).first().completed == 1


def test_answers_and_their_problems(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, prompt string").coalesce(1)

    def broken(xs):
        raise ValueError("down")

    good = {r.id: (r.answer, r.answer_problem) for r in curation.batched_calls(rows, "prompt", lambda xs: [x.upper() for x in xs]).collect()}
    bad = {r.id: (r.answer, r.answer_problem) for r in curation.batched_calls(rows, "prompt", broken).collect()}
    assert good == {1: ("A", None), 2: (None, "no prompt")} and bad == {1: (None, "ValueError: down"), 2: (None, "no prompt")}


def test_assembled_context(spark):
    q = spark.createDataFrame([(1, "the pump"), (2, "hello!")], "query_id bigint, query string")
    hits = spark.createDataFrame([(1, "b", 1, False), (1, "a", 2, True), (1, "late", 11, True), (2, "a", 1, True)], "query_id bigint, page_id string, place bigint, title_match boolean")
    near = spark.createDataFrame([("a", "c", 3.0), ("b", "d", 5.0), ("b", "a", 9.0), ("late", "e", 9.0)], "seed string, id string, relevance double")
    pages = spark.createDataFrame([(x, x * 40) for x in "abcde"], "page_id string, content string")
    got = [(r.query_id, r.number, r.page_id, r.part) for r in context.assembled(q, hits, near, pages, 150, 40).orderBy("number").collect()]
    assert got == [(1, 1, "a", 0), (1, 2, "b", 1), (1, 3, "d", 2)]


def test_communities_of_a_chain_are_found_to_the_end(spark):
    n = 64
    w = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", 1.0) for i in range(n - 1)], "a string, b string, weight double")
    c = graph.louvain(w)
    sizes = [r["count"] for r in c.groupBy("community").count().collect()]
    # the best cuts of a chain have about the square root of its length
    assert graph.modularity(w, c).first().q > 0.72 and 5 <= len(sizes) <= 14 and sum(sizes) == n
    assert sorted(r.community for r in c.select("community").distinct().collect()) == list(range(len(sizes)))


def test_communities_are_the_same_in_one_task_and_by_tables(spark, monkeypatch):
    rnd = random.Random(4)
    links = {(min(a, b), max(a, b)) for a in range(60) for b in [a // 10 * 10 + rnd.randint(0, 9), a // 10 * 10 + rnd.randint(0, 9), rnd.randint(0, 59)] if a != b}
    w = spark.createDataFrame([(f"p{a:02d}", f"p{b:02d}", rnd.choice([1.0, 2.5, 4.2])) for a, b in sorted(links)], "a string, b string, weight double")
    written, table = [], graph.shared_table
    monkeypatch.setattr(graph, "shared_table", lambda df: written.append(1) or table(df))
    found, tables = [], []
    for most in (1 << 20, 20, 0):
        monkeypatch.setattr(graph, "AT_ONCE", most, raising=False)
        written.clear()
        found.append({r.id: r.community for r in graph.louvain(w).collect()})
        tables.append(len(written))
    assert found[0] == found[1] == found[2] and len(found[0]) == 60 and 2 < len(set(found[0].values())) < 20
    # a round is no table where one task holds the graph
    assert tables[0] <= 3 < tables[2]


@pytest.mark.parametrize("n", [0, 1, 50])
def test_numbering_without_one_task(spark, n):
    df = spark.createDataFrame([(i * 7 % 50, "x") for i in range(n)], "v int, y string")
    assert [r.k for r in graph.numbered(df, [F.desc("v")], "k").orderBy(F.desc("v")).collect()] == list(range(n))
