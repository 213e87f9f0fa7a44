"""Files, web pages, stores and streams."""

from __future__ import annotations

import datetime as dt
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import changes, chunks, context, curation
from pagelattice.sources import files, store, web
from pagelattice.streaming import feeds


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b|c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = zipped({
    "xl/workbook.xml": '<w xmlns:r="urn:r"><sheets><sheet name="S" r:id="rId1"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="rId1" Target="worksheets/s.xml"/></R>',
    "xl/sharedStrings.xml": "<sst><si><t>n</t></si></sst>", "xl/worksheets/s.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.50</v></c></row><row><c r="A2"><v>3.0</v></c></row></w>',
})


def test_office_readers():
    assert files.docx_markdown(DOCX) == "## Head\n\n**bold** text\n\n| a | b\\|c |\n| --- | --- |"
    assert files.xlsx_markdown(XLSX) == "| n |  | 2.50 |\n| --- | --- | --- |\n| 3 |  |  |"
    assert files.pptx_markdown(zipped({f"ppt/slides/slide{n}.xml": f"<s><p><t>T{n}</t></p><p><t>x</t></p></s>" for n in (10, 2)})) == "## Slide 2\n\n**T2**\n\n- x\n\n## Slide 10\n\n**T10**\n\n- x"
    assert files.odf_text(zipped({"content.xml": "<d><text:h>A &amp;lt; b</text:h><text:p>c</text:p></d>"})) == "A &lt; b\n\nc"
    assert files.read_text("docx", "x.docx", b"no zip")[0] is None and files.read_text("txt", "x", b"\xff")[1] == "not UTF-8"


def test_file_trees(spark, tmp_path):
    for p, data in {"wiki/a b.md": b"# A", "wiki/sub/c.md": b"-", ".hidden/x.md": b"x", "raw/sources/d.docx": DOCX, "raw/e.bin": b"\xff\xfe"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(data)
    assert {r.path for r in files.listing(spark, str(tmp_path)).collect()} == {"wiki/a b.md", "wiki/sub/c.md", "raw/sources/d.docx", "raw/e.bin"}
    pages = {r.page_id: r.content for r in files.markdown_pages(spark, str(tmp_path)).collect()}
    assert pages["a b"] == "# A" and ".hidden" not in str(pages)
    got = {r.ext: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["docx"].text.startswith("## Head") and got["bin"].problem == "not UTF-8"


@pytest.mark.parametrize(("p", "ok"), [("wiki/a.md", True), ("raw/sources/a.pdf", True), ("raw/sources/a.tmp", False), ("raw/sources/.git/a.md", False), ("raw/sources/a.draft.md", False), ("wiki/media/a.md", False), ("notes.md", False), ("schema.md", True)])
def test_watch_rules(spark, p, ok):
    assert spark.createDataFrame([(p,)], "p string").select(files.watched(F.col("p"))).first()[0] is ok


def test_paths(spark):
    d = spark.createDataFrame([("wiki/a.md",), ("wiki/../x.md",), ("/wiki/a.md",), ("other/a.md",), ("wiki/a.exe",)], "p string")
    assert [r[0] for r in d.select(files.safe_path(F.col("p"))).collect()] == [True, False, False, False, False]


def test_web(spark):
    h = '<html><title>T &amp; x</title><body><nav>no</nav><div class="ad">no</div><h1>H</h1><p>a <b>b</b> <a href="u">l</a></p><ul><li>x</li></ul><table><tr><th>k</th></tr><tr><td>v</td></tr></table><script>no</script></body></html>'
    a = web.article(h)
    assert a["title"] == "T & x" and "no" not in a["content"] and "# H" in a["content"] and "a **b** [l](u)" in a["content"] and "- x" in a["content"] and "| k |\n| --- |\n| v |" in a["content"]
    assert web.article(None) == {"title": "", "content": ""} and web.article("<p>open")["content"] == "open"
    clips = spark.createDataFrame([(1, "A  b!", "u", "x", "2024-01-01"), (2, "a B", "u", None, "2024-01-01"), (3, None, None, "y", "2024-01-01")], "seq int, title string, url string, content string, day string")
    assert sorted(r.path for r in web.clip_files(clips).collect()) == ["raw/sources/a-b-2024-01-01-2.md", "raw/sources/a-b-2024-01-01.md", "raw/sources/clip-2024-01-01.md"]
    raw = spark.createDataFrame([(json.dumps({"title": "t", "link": "https://www.h.org/x", "content": "c"}),), ("{}",), (None,)], "json string")
    assert [tuple(r) for r in web.search_results(raw).collect()] == [("t", "https://www.h.org/x", "c", "h.org")]
    rows = spark.createDataFrame([(1, "some words"), (2, None)], "id int, text string")
    got = {r.id: r.vector for r in web.embedded(rows, "id", "text", web.hashed_client).collect()}
    assert got[2] is None and sum(x * x for x in got[1]) == pytest.approx(1)

    def short(texts):
        if len(texts[0]) > 100:
            raise web.TooLong
        return [[1.0]]

    assert web.embed_text(short, "x" * 300) == [1.0] and web.embed_text(short, "x" * 5000) is None


def test_vector_store(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path / "v"))
    make = lambda rows: spark.createDataFrame(rows, "page_id string, chunk_index int, chunk_text string, heading_path string, vector array<double>")
    assert s.count() == 0
    s.upsert(make([("a", 0, "x", "", [1.0, 2.0]), ("a", 1, "y", "", [1.0, 2.0]), ("b", 0, "z", "", [1.0, 2.0])]))
    s.upsert(make([("a", 0, "new", "", [3.0, 4.0])]))
    s.upsert(make([]))
    assert {(r.chunk_id, r.chunk_text) for r in s.rows().collect()} == {("a#0", "new"), ("b#0", "z")}
    with pytest.raises(ValueError):
        s.upsert(make([("c", 0, "x", "", [1.0])]))
    with pytest.raises(ValueError):
        s.upsert(make([("c/d", 0, "x", "", [1.0, 2.0])]))
    s.delete_pages(spark.createDataFrame([("a",), ("zzz",)], "page_id string"))
    assert [r.chunk_id for r in s.rows().collect()] == ["b#0"]


def test_changes(spark):
    b = spark.createDataFrame([("a", "1", 1), ("b", None, 1), ("c", "1", 1)], "path string, hash string, size int")
    a = spark.createDataFrame([("a", "2", 1), ("b", "9", 1), ("d", "1", 1), (None, "1", 1)], "path string, hash string, size int")
    assert {(r.path, r.kind) for r in changes.snapshot_diff(b, a).collect()} == {("a", "modified"), ("c", "deleted"), ("d", "created")}
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    seqs = {"x": ["created", "deleted", "created"], "y": ["deleted", "created"], "z": ["modified", "deleted"], "w": ["created"]}
    rows = [(k, t(i * 50), e) for k, v in seqs.items() for i, e in enumerate(v)]
    got = {r.key: r.kind for r in changes.coalesce_changes(spark.createDataFrame(rows, "key string, at timestamp_ntz, kind string")).collect()}
    want = {}
    for k, v in seqs.items():
        s = ""
        for e in v:
            s = feeds._fold(s, e)
        want[k] = s
    assert got == want == {"x": "created", "y": "modified", "z": "deleted", "w": "created"}
    c = spark.createDataFrame([("p", t(1)), ("p", t(2)), ("q", t(1))], "path string, at timestamp_ntz")
    w = spark.createDataFrame([("p", t(1) - dt.timedelta(seconds=3))], "path string, at timestamp_ntz")
    assert {(r.path, r.at) for r in changes.without_own_writes(c, w).collect()} == {("p", t(2)), ("q", t(1))}


def test_streamed_changes(spark, tmp_path):
    rows = [("a", "2024-01-01T00:00:00", "created"), ("a", "2024-01-01T00:00:00.1", "deleted"), ("b", "2024-01-01T00:00:00", "created"), ("z", "2024-01-01T02:00:00", "created")]
    for i, part in enumerate((rows[:3], rows[3:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "at": t, "kind": e}) for k, t, e in part))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i * 60,) * 2)
    s = spark.readStream.schema("key string, at timestamp, kind string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = feeds.coalesced(s).writeStream.format("memory").queryName("burst").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.kind, r.n) for r in spark.table("burst").collect()} == {("a", "modified", 2), ("b", "created", 1)}


def test_chunks(spark):
    t = "---\na: b\n---\n# A\n\n" + "word. " * 400 + "\n\n```\n" + "code\n" * 500 + "```\n\n## B\n\n| a | b |\n| 1 | 2 |\n\ntail"
    s = chunks.chunk(t)
    assert all(c.end - c.start <= 1500 or c.whole for c in s) and any(c.whole and c.end - c.start > 1500 for c in s)
    assert "".join("".join(t[c.start : c.end] for c in s).split()) == "".join(t.split("---\n", 2)[2].split())
    assert s[-1].path == "# A > ## B"
    rows = chunks.chunked(spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "x" * 5000)], "id int, text string"), "id", "text").collect()
    assert {r.id for r in rows} == {1, 4} and max(r.char_end - r.char_start for r in rows if r.id == 4) <= 1500


def test_context(spark):
    r = spark.createDataFrame([(1, 1, "a", "x" * 50), (1, 2, "b", "x" * 70), (1, 3, "c", "x" * 40), (1, 4, "d", None), (2, 1, "a", "x" * 500)], "query_id int, place bigint, page_id string, content string")
    got = {(x.query_id, x.number): (x.page_id, x.truncated) for x in context.pack(r, 100, 80).collect()}
    assert got == {(1, 1): ("a", False), (1, 2): ("c", False), (2, 1): ("a", True)}
    t = spark.createDataFrame([("## H\nthe oven\nno\noven " + "x" * 50 + "\noven",)], "t string").select(context.trim_index(F.col("t"), F.array(F.lit("oven")), 30)).first()[0]
    assert t == "## H\nthe oven\noven"


def test_curation(spark):
    old, new = "---\ntype: a\ntags: [x]\n---\nsame", "---\ntype: b\ntags: [X, y]\n---\nother"
    d = spark.createDataFrame([(old, new), (None, new), (old, None), ("plain", new)], "o string, n string")
    got = [r[0] for r in d.select(curation.merge_pages(F.col("o"), F.col("n"))).collect()]
    assert got == ['---\ntype: a\ntags: ["x", "y"]\n---\nother', new, old, new]
    terms = F.array(F.struct(F.lit("oven").alias("term"), F.lit("oven").alias("target")), F.struct(F.lit("map").alias("term"), F.lit("chart").alias("target")))
    p = spark.createDataFrame([("---\nt: oven\n---\nan oven, oven, [[chart|old map]] map",)], "c string").select(curation.link_terms(F.col("c"), terms)).first()[0]
    assert p == "---\nt: oven\n---\nan [[oven]], oven, [[chart|old map]] map"
    rows = spark.createDataFrame([(1, "ask one"), (2, None), (3, "else")], "id int, prompt string")
    assert {r.id: r.answer for r in curation.batched_calls(rows, "prompt", web.replayed({"one": "1"})).collect()} == {1: "1", 2: None, 3: None}
