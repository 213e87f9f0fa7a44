"""Each operator beside a brute-force version, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import encode, leakage, nearcopies, neighbours, sentences, setjoin, splitting, survivors

MEMBERS = "request_id bigint, member_no int, slug string, canonical_slug string, origin string, title string, page_type string, description string, created_on string, updated_on string, tags array<string>, trust int, value string"


def member(req, no, slug, origin, title=None, updated=None, desc=None, tags=None):
    return (req, no, slug, None, origin, title, None, desc, None, updated, tags, 9, "x")


def test_survivors(spark):
    rows = [
        member(1, 1, "a", "guessed", "A", "2025-01-01"), member(1, 2, "b", " REVIEWED ", "n/a", "2025-01-01", "(none)"), member(1, 3, "c", "ingested", "C", "2024-01-01", "d"),
        member(1, 4, "d", "ingested", "D", "2024-01-01T03:00:00+05:30", "e"), member(1, 4, "d", "ingested", "D", "2024-01-01T03:00:00+05:30", "e"),
        member(2, 2, "y", None, "Y", None), member(2, 1, "x", "odd", "X", "no date"), member(3, 1, "z", "reviewed", " ", None), member(None, 1, "n", "reviewed", "N", None),
    ]
    got = {(r.request_id, r.field_name): r.slug for r in survivors.surviving_values(spark.createDataFrame(rows, MEMBERS)).collect()}
    assert got == {(1, "title"): "c", (1, "description"): "c", (2, "title"): "x"}
    pages = {r.request_id: r for r in survivors.canonical_pages(spark.createDataFrame(rows, MEMBERS)).collect()}
    assert pages[1].title == "C" and pages[3].title is None and pages[3].canonical_slug == "z"
    assert survivors.surviving_values(spark.createDataFrame([], MEMBERS)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-01-01", 1704067200), ("2024-01-01T05:30:00+05:30", 1704067200), ("1704067200000", 1704067200), ("01 Jan 2024", 1704067200), ("2024/01/01 00:30", 1704069000), ("2024-01-01T00:00:00Z", 1704067200), ("", None), ("soon", None), (None, None)],
)
def test_instants(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(survivors.instant(F.col("s"))).first()[0]
    assert got == (None if want is None else want * 1_000_000)


def test_splitting(spark):
    long_run = "x" * 95
    text = "# A\r\n\r\nfirst line here\r\nsecond\r\n \t\r\n```sh\na\n\n\nb\n```\n\n" + long_run + "\n\n## B\n\ntail. " + "More words in one sentence. " * 6
    rows = [(1, text, 40, 10, "m"), (1, text, 40, 10, "m"), (2, None, 40, 10, "m"), (3, " \n ", 40, 10, "m"), (4, "short", None, None, "m"), (5, "y " * 30000, 1000, 50, "m")]
    schema = "source_id bigint, content string, max_chars int, overlap_chars int, main string"
    got = splitting.split_sources(spark.createDataFrame(rows, schema)).collect()
    u = splitting.unify(text)
    one = sorted((r for r in got if r.source_id == 1), key=lambda r: r.piece_no)
    assert all(len(r.main) <= 40 and len(r.overlap_before) <= 10 for r in one)
    assert [r.piece_no for r in one] == list(range(1, len(one) + 1))
    assert "".join(u.split()) == "".join("".join(r.main for r in one).split())
    assert {r.first_block for r in one if r.cut_inside} == {b.number for b in splitting.blocks(u) if b.end - b.start > 40} == {4, 6}
    assert one[-1].heading_path == "A > B"
    assert {r.source_id for r in got} == {1, 4, 5} and max(len(r.main) for r in got if r.source_id == 5) <= 1000
    assert splitting.split_sources(spark.createDataFrame([], schema)).count() == 0
    assert splitting.split_sources(spark.createDataFrame([(1, "tail", 4, 0, "m")], schema)).first().main == "tail"


def plain_blocks(text):
    """Blocks as lists of lines, by a parser of its own."""
    out, held, mark = [], [], None
    for line in text.replace("\r\n", "\n").split("\n"):
        bare = line.strip()
        run = len(bare) - len(bare.lstrip(bare[:1])) if bare[:1] in ("`", "~") else 0
        if mark:
            held.append(line)
            if run >= mark[1] and bare == mark[0] * run:
                out.append(held)
                held, mark = [], None
        elif run >= 3:
            if held:
                out.append(held)
            held, mark = [line], (bare[0], run)
        elif bare:
            held.append(line)
        elif held:
            out.append(held)
            held = []
    return out + ([held] if held else [])


def test_long_blocks_of_the_tables(spark, small):
    rows = spark.read.parquet(f"{small}/long_sources.parquet").dropDuplicates(["source_id"]).collect()
    want = {(r.source_id, n) for r in rows if r.content for n, b in enumerate(plain_blocks(r.content), 1) if len("\n".join(b).strip()) > r.max_chars}
    from pagelattice.llm import queries as Q

    got = {(r.source_id, r.block_no) for r in Q.p2_found(spark, small).collect()}
    assert got == want and want


def unit(rng, base, cos):
    v = rng.normal(size=64)
    v -= v @ base * base
    v /= np.linalg.norm(v)
    return cos * base + np.sqrt(1 - cos * cos) * v


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vs = []
    for _ in range(150):
        base = rng.normal(size=64)
        base /= np.linalg.norm(base)
        vs += [base * 3] + [unit(rng, base, c) for c in rng.uniform(0.8, 0.99, rng.integers(0, 9))]
    vs += [np.ones(64)] * 9
    rows = [(i, [float(x) for x in v], "u") for i, v in enumerate(vs)]
    bad = [(9001, None, "u"), (9002, [0.0] * 64, "u"), (9003, [1.0] * 63, "u"), (9004, [float("nan")] * 64, "u"), (9005, [float("inf")] * 64, "u"), (None, [1.0] * 64, "u"), (9006, [None] * 64, "u")]
    df = spark.createDataFrame(rows + rows[:40] + bad, "vec_id bigint, embedding array<float>, v string")
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 12), j))[:5] if s[i, j] >= 0.85}
    got = {(r.id, r.near) for r in neighbours.nearest(df).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    copies = range(len(vs) - 9, len(vs))
    assert {j for i, j in got if i == copies[-1]} == set(copies[:5])
    assert neighbours.nearest(df.where("vec_id > 9000")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    g, q = neighbours.Graph(x), x[:200]
    pos, _ = g.search(q, 6, ef=48)
    true = np.argsort(-(q @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(pos, true, strict=True)]) > 0.95
    assert neighbours.Graph(x[:1]).search(x[:1], 3)[0].tolist()[0][0] == 0


def corpus(seed=1, families=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    out = []
    for _ in range(families):
        ws = [word() for _ in range(60)]
        for _ in range(rnd.randint(1, 4)):
            v = list(ws)
            for _ in range(rnd.randint(0, 12)):
                v[rnd.randrange(len(v))] = word()
            out.append(" ".join(v))
    return out


def test_near_copies_against_brute_force(spark):
    texts = corpus() + ["Same, text here!", "same text  HERE", "", " ", None, "abc", "Long " * 20000 + "end"]
    rows = [(0, i, t, 1) for i, t in enumerate(texts)] + [(1, 0, texts[0], 1), (0, 1, texts[1], 1), (0, None, texts[1], 1)]
    pairs, members = nearcopies.near_copies(spark.createDataFrame(rows, "origin int, id bigint, text string, norm int"))
    got = {(r.origin, r.id_a, r.id_b): 1 for r in nearcopies.expand(pairs, members).collect()}
    sets = {i: nearcopies.runs(nearcopies.canonical(t)) for i, t in enumerate(texts) if t and len(nearcopies.canonical(t)) >= 5}
    want = {(0, a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert set(got) == want and len(want) > 20
    labels = {r.id: r.group_id for r in nearcopies.groups(pairs, members).where("origin = 0").collect()}
    assert all(labels[a] == labels[b] for _, a, b in want) and set(labels) == set(sets)
    empty = spark.createDataFrame([], "origin int, id bigint, text string")
    assert nearcopies.expand(*nearcopies.near_copies(empty)).count() == 0


def test_crowded_nodes_give_the_same_pairs(spark, monkeypatch):
    texts = [f"shared beginning of every text in this crowd, told again and again until it is long enough {i % 7} tail {i}" for i in range(150)]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "origin int, id bigint, text string")
    plain = {(r.a, r.b) for r in nearcopies.near_copies(df)[0].collect()}
    monkeypatch.setattr(nearcopies, "CROWD", 20)
    monkeypatch.setattr(nearcopies, "SHARE", 2)
    hot = nearcopies._crowded(df)
    assert hot and max(hot.values()) > 1
    assert {(r.a, r.b) for r in nearcopies.near_copies(df)[0].collect()} == plain and len(plain) > 1000


def test_gray_index_is_exact():
    rng = np.random.default_rng(0)
    node = np.sort(rng.integers(0, 3, 400)).astype(np.int64)
    base = rng.integers(0, 1 << 63, (20, 2), dtype=np.uint64)
    f = base[rng.integers(0, 20, 400)] ^ (np.uint64(1) << rng.integers(0, 64, (400, 2), dtype=np.uint64))
    r1, r2 = nearcopies.gray_rank(f[:, 0]), nearcopies.gray_rank(f[:, 1])
    assert (nearcopies.gray_code(r1) == f[:, 0]).all()
    order = np.lexsort((r2, r1, node))
    node, r1, r2, f = node[order], r1[order], r2[order], f[order]
    got = {(int(min(i, j)), int(max(i, j))) for a, b in nearcopies.close_pairs(node, r1, r2, 6) for i, j in zip(a, b, strict=True) if i != j}
    bits = lambda i, j: int(np.bitwise_count(f[i] ^ f[j]).sum())
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if node[i] == node[j] and bits(i, j) <= 6}


def test_set_join_against_brute_force(spark):
    rnd = random.Random(2)
    pool = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(300):
        s = rnd.sample(pool[: rnd.choice([8, 40])], rnd.randint(2, 8))
        rows.append(("f" if i % 3 else "g", i, [*s, s[0], None], 7))
    rows += [rows[0], ("f", 900, None, 7), ("f", 901, [], 7), ("f", None, pool[:5], 7)]
    pairs, members = setjoin.similar_sets(spark.createDataFrame(rows, "set_field string, id bigint, values array<string>, n int"))
    got = {(r.field, r.id_a, r.id_b) for r in setjoin.expand(pairs, members).collect()}
    sets = {(f, i): set(v) - {None} for f, i, v, _ in rows if v and i is not None}
    sets = {k: v for k, v in sets.items() if len(v) >= 4}
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(sorted(sets), 2) if a[0] == b[0] and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 50
    empty = spark.createDataFrame([], "set_field string, id bigint, values array<string>")
    assert setjoin.expand(*setjoin.similar_sets(empty)).count() == 0


def test_encoding_round_trip(spark):
    texts = ["", None, "Hello  world\n\n", "naïve 水泵 👩‍🔧\r\n", "<|endoftext|>", "a" * 70000, "word " * 20000, "\t x'll  \n\n y " * 9000, "水" * 40000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "x", "z")], "doc_id bigint, text string, ids string")
    enc = encode.encode_corpus(docs)
    got = {r.doc_id: r.ids for r in enc.collect()}
    import tiktoken

    plain = encode.encoding(encode.default_ranks(), encode.default_pattern())
    assert isinstance(plain, tiktoken.Encoding) and got[0] == got[1] == []
    assert all(got[i] == plain.encode_ordinary(t) for i, t in enumerate(texts) if t and len(t) < 200000)
    raw = {r.doc_id: bytes(r.raw) for r in encode.decode_ids(enc).collect()}
    assert all(raw[i] == (t or "").encode() for i, t in enumerate(texts))
    assert encode.encode_corpus(docs.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(30))) for i in range(8)] + [(8, "too short"), (9, None), (10, ""), (11, "水泵里还有木箱子很多很多旧箱子")]
    docs = []
    for i in range(60):
        w = [rnd.choice(words + ["other"]) for _ in range(40)]
        if i % 2:
            src = items[i % 8][1].split()
            n = rnd.randint(10, 16)
            s = rnd.randint(0, 30 - n)
            w[5 : 5 + n] = src[s : s + n]
        docs.append((i, ", ".join(w).upper(), 1))
    docs += [(100, None, 1), (101, "", 1), (102, "x水泵里 还有木箱子很多，很多旧箱子", 1), (1, docs[1][1], 1), (None, docs[1][1], 1), (103, "q " * 50000 + items[0][1], 1)]
    got = {(r.doc_id, r.item_id): r.n_words for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for d, t, _ in docs:
        for i, q in items:
            if t and q and d is not None:
                a, b = leakage.words(t), leakage.words(q)
                grams = {tuple(b[k : k + 12]) for k in range(len(b) - 11)}
                if any(tuple(a[k : k + 12]) in grams for k in range(len(a) - 11)):
                    want[d, i] = 1
    assert set(got) == set(want) and (102, 11) in got and got[103, 0] == 30
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    blocks = leakage.leaks(d, spark.createDataFrame(items, "item_id bigint, text string"), block_chars=100)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(want)
    assert leakage.leaks(d.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert leakage.leaks(d, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


CASES = [
    ("Dr. A met Mr. B. They left.", ["Dr. A met Mr. B. They left."]),
    ("It opened at 2 a.m. The door shut. It shut at 3 p.m. before us.", ["It opened at 2 a.m.", "The door shut.", "It shut at 3 p.m. before us."]),
    ("It rose by 3.5 m. Then it fell.", ["It rose by 3.5 m.", "Then it fell."]),
    ('"Is it dry?" asked Prof. Li. Yes.', ['"Is it dry?" asked Prof. Li.', "Yes."]),
    ("“Go! It leaks,” wrote A. B. Cox. (It is over.) End", ["“Go! It leaks,” wrote A. B. Cox.", "(It is over.)", "End"]),
    ("One.[^3] Two!\nthree lines\nlong. four?", ["One.[^3]", "Two!", "three lines\nlong.", "four?"]),
    ("水位上升了16.89米。灯塔……被更换了！“小心！漏水了，”他写道。好", ["水位上升了16.89米。", "灯塔……被更换了！", "“小心！漏水了，”他写道。", "好"]),
    ("ระดับน้ำสูง 45 ไม่มีใคร\nเขื่อน", ["ระดับน้ำสูง 45", "ไม่มีใคร", "เขื่อน"]),
    ("Am 13. März kam er. Das gilt z. B. für uns usw. Ende.", ["Am 13. März kam er.", "Das gilt z. B. für uns usw.", "Ende."]),
    ("क्या हुआ? डॉ. राम ने कहा। हाँ।", ["क्या हुआ?", "डॉ. राम ने कहा।", "हाँ।"]),
    ("---\ntitle: X. Y\n---\n\n# No. 5: a. b\n- one. two\n1. three\n\n| a. | b. |\n\n```\nx. y.\n```\nLast", ["# No. 5: a. b", "- one. two", "1. three", "Last"]),
    ("", []), (" \n ", []), ("---\na: b\n---\n", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(text, want):
    ends = sentences.Splitter().ends(text)
    assert ends == sorted(set(ends))
    got, at = [], 0
    for e in ends:
        got.append(text[at:e].strip())
        at = e
    assert len(got) == len(want) or want == got
    assert [g.endswith(w) for g, w in zip(got, want, strict=True)] == [True] * len(want)


def test_sentence_units(spark):
    rows = [(1, "One. Two.", 5), (2, None, 5), (3, "", 5), (4, "x" * 100000, 5), (None, "One. Two.", 5), (1, "One. Two.", 5)]
    got = sorted((r.doc_id, r.end_pos) for r in sentences.sentence_units(spark.createDataFrame(rows, "doc_id bigint, text string, end_pos int")).collect())
    assert got == [(1, 4), (1, 4), (1, 9), (1, 9), (4, 100000)]
    assert sentences.sentence_units(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_queries_run_on_the_smallest_tables(spark, small):
    from pagelattice.llm import queries as Q

    assert set(Q.oracle_sql()) <= set(Q.queries())
    for name, f in Q.queries().items():
        assert f(spark, small).limit(1).count() >= 0, name
