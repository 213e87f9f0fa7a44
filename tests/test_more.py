"""Images, state, imports, first-seen lists, streams and properties."""

from __future__ import annotations

import datetime as dt
import io
import json
import os
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelattice.functions import blocks, text
from pagelattice.operators import changes, chunks, search
from pagelattice.sources import files, store
from pagelattice.streaming import feeds


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"rest"


def test_images(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in (("word/media/a.png", png(200, 150)), ("word/media/b.png", png(200, 150)), ("word/media/c.png", png(50, 500)), ("word/media/d.txt", b"x")):
            z.writestr(n, d)
    got = files.embedded_images(spark.createDataFrame([("x.docx", b.getvalue()), ("bad.docx", b"no")], "path string, content binary")).collect()
    assert [(r.path, r.name, r.width, r.height) for r in got] == [("x.docx", "word/media/a.png", 200, 150)]
    assert files.image_size(b"GIF89a" + (300).to_bytes(2, "little") + (20).to_bytes(2, "little")) == (300, 20) and files.image_size(b"") is None
    i = spark.createDataFrame([("d", 10, 1, "u1", "c"), ("d", 2, 2, "u2", None), ("d", None, 3, "u3", None)], "path string, page int, idx int, url string, caption string")
    assert files.image_section(i).first().section == "## Embedded images\n\n### Page 2\n\n![](u2)\n\n### Page 10\n\n![c](u1)\n\n### Document\n\n![](u3)"


def test_state_and_imports(spark, tmp_path):
    p = str(tmp_path / "s")
    assert store.load_state(spark, p, "id int, s string").count() == 0
    store.save_state(spark.createDataFrame([(1, "a"), (2, None)], "id int, s string"), p)
    assert sorted((r.id, r.s) for r in store.load_state(spark, p, "id int, s string").collect()) == [(1, "a"), (2, None)]
    m = spark.createDataFrame([(1, i) for i in range(150)], "conv_id int, turn int")
    assert store.kept_messages(m).agg(F.min("turn"), F.count(F.lit(1))).first() == (50, 100)
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, md5 string")
    assert [r.path for r in files.changed_imports(f, spark.createDataFrame([("a", "1"), ("b", "x")], "path string, md5 string")).collect()] == ["b"]
    t = spark.createDataFrame([("t", 1, "pending", 0), ("t", 2, "failed", 1), ("u", 1, "failed", 3)], "id string, at int, status string, retry_count int")
    assert {r.state: r.n for r in changes.open_tasks(t).collect()} == {"pending": 1, "failed": 1}


def test_first_seen_and_image_hits(spark):
    r = spark.createDataFrame([(1, i, k) for i, k in enumerate(["x", "y", "x", None, None, "z"])], "q int, seq int, url string")
    assert [x.seq for x in search.first_seen(r, ["url"], ["seq"], 3, ["q"]).orderBy("turn").collect()] == [0, 1, 3]
    img = "query_id int, place int, page_id string, images array<struct<url:string,alt:string>>"
    d = spark.createDataFrame([(1, 1, "a", [("u", "no"), ("v", "an oven")]), (1, 2, "b", [("u", "oven")])], img)
    got = search.image_hits(d, F.array(F.lit("oven"))).orderBy("turn").collect()
    assert [(x.page_id, x.url, x.matched) for x in got] == [("a", "v", True), ("a", "u", False)]


def put(folder, n, rows):
    folder.mkdir(exist_ok=True)
    p = folder / f"{n}.json"
    p.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(p, (1_700_000_000 + n * 60,) * 2)


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    t = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}"
    put(tmp_path / "r", 0, [{"client": "a", "at": t(0)}, {"client": "a", "at": t(0)}, {"client": "b", "at": t(1)}])
    put(tmp_path / "r", 1, [{"client": "a", "at": t(300)}])
    s = spark.readStream.schema("client string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "r"))
    assert {(x.client, x.n) for x in run(feeds.request_counts(s), "counts", tmp_path)} == {("a", 2), ("b", 1)}
    put(tmp_path / "k", 0, [{"key": "x", "kind": "created", "at": t(0)}, {"key": "x", "kind": "created", "at": t(5)}, {"key": "x", "kind": "deleted", "at": t(5)}])
    k = spark.readStream.schema("key string, kind string, at timestamp").json(str(tmp_path / "k"))
    assert len(run(feeds.debounced(k), "once", tmp_path)) == 2
    (tmp_path / "f" / "sub").mkdir(parents=True)
    (tmp_path / "f" / "sub" / "a.md").write_text("# A\ntext")
    seen = []
    feed = feeds.file_feed(spark, str(tmp_path / "f"))
    q = feeds.run_batches(feed, lambda df, n: seen.extend(df.select("path", "text", "hash").collect()), str(tmp_path / "cpf")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [x.text for x in seen] == ["# A\ntext"] and seen[0].path.endswith("/sub/a.md")
    b = spark.createDataFrame([("a", "1", 1)], "path string, hash string, size int")
    assert [(x.key, x.kind) for x in feeds.rescan(b, b.limit(0), "2024-01-01").collect()] == [("a", "deleted")]


def test_own_writes_in_a_stream(spark, tmp_path):
    at = lambda s: (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)).isoformat()
    put(tmp_path / "c", 0, [{"path": "p", "at": at(2)}, {"path": "q", "at": at(2)}])
    put(tmp_path / "c", 1, [{"path": "z", "at": at(9000)}])
    put(tmp_path / "w", 0, [{"path": "p", "at": at(0)}])
    put(tmp_path / "w", 1, [{"path": "z", "at": at(8999)}])
    read = lambda d: spark.readStream.schema("path string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / d))
    assert {x.path for x in run(feeds.without_own_writes(read("c"), read("w")), "foreign", tmp_path)} == {"q"}


MARKDOWN = st.lists(st.sampled_from(["# A\n", "## B c\n", "text here. more! ", "\n\n", "```\n", "code\n", "| a | b |\n", "水泵。", "x" * 400, "- item\n", " ", "\t\n"]), max_size=40).map("".join)


@given(MARKDOWN)
@settings(max_examples=150, deadline=None)
def test_chunks_hold_everything_once(s):
    spans = chunks.chunk(s, chunks.Sizes(200, 300, 40, 40))
    at = chunks._TOP.match(s).end() if chunks._TOP.match(s) else 0
    assert "".join("".join(s[c.start : c.end] for c in spans).split()) == "".join(s[at:].split())
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:], strict=False)) and all(c.end - c.start <= 300 or c.whole for c in spans)


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_parsers_never_raise(s):
    o = blocks.first_object("x" + s)
    assert o == "" or (o[0], o[-1]) == ("{", "}")
    assert all(b["problem"] or b["content"] is not None for b in blocks.file_blocks(s))
    assert text.tokenize(s) == sorted(set(text.tokenize(s)))
    assert len(text.summary_slug(s)) <= 255
