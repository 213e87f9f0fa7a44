"""What the methods themselves must do: layers, trees, valleys, evidence, long matches."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import leakage, nearcopies, neighbours, sentences, setjoin, splitting, survivors


def test_canonical_pages_have_their_text(spark):
    cols = "request_id bigint, member_no int, slug string, canonical_slug string, origin string, title string, page_type string, description string, created_on string, updated_on string, tags array<string>, content string, path string"
    rows = [
        (1, 1, "a", None, "guessed", "A", "entity", "d", "2024", "2025-01-01", ["t"], "text of a", "wiki/a.md"), (1, 2, "b", None, "reviewed", "B", None, None, None, "2024-01-01", None, "todo", "wiki/b.md"),
        (1, 3, "c", None, "ingested", None, None, None, None, "2024-06-01", None, "text of c", None), (1, 4, "e", None, "ingested", "E", "x", "y", "z", "2024-06-01", None, "text of e", None),
        (2, 1, "d", None, "clipped", "D", None, None, None, None, None, None, None), (2, 1, "d", None, "clipped", "D", None, None, None, None, None, None, None),
    ]
    m = spark.createDataFrame(rows, cols)
    got = {r.request_id: r for r in survivors.canonical_pages(m).collect()}
    assert (got[1].title, got[1].content, got[1].path, got[1].tags) == ("B", "text of e", "wiki/b.md", "t") and (got[2].title, got[2].content, got[2].path) == ("D", None, None)
    assert {r.field_name for r in survivors.surviving_values(m).collect()} == set(survivors.FIELDS)


@pytest.mark.parametrize("bits", [42, 44, 46])
def test_near_copies_are_not_dropped_far_above_the_expected_distance(bits):
    f = np.zeros((2, 2), dtype=np.uint64)
    f[1] = [(1 << 40) - 1, (1 << (bits - 40)) - 1]
    ranks = nearcopies.gray_rank(f[:, 0]), nearcopies.gray_rank(f[:, 1])
    order = np.lexsort((ranks[1], ranks[0]))
    pairs = nearcopies.close_pairs(np.zeros(2, dtype=np.uint64), ranks[0][order], ranks[1][order], nearcopies.FAR)
    assert {(min(i, j), max(i, j)) for a, b in pairs for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j} == {(0, 1)}


def test_a_large_node_is_compared_in_bounded_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, (6000, 2), dtype=np.uint64)
    f[3000:] = f[:3000] ^ (np.uint64(1) << rng.integers(0, 64, (3000, 2), dtype=np.uint64))
    ranks = nearcopies.gray_rank(f[:, 0]), nearcopies.gray_rank(f[:, 1])
    order = np.lexsort((ranks[1], ranks[0]))
    got = []
    for tile in (256, 1 << 40):
        monkeypatch.setattr(nearcopies, "TILE", tile, raising=False)
        tracemalloc.start()
        pairs = {(min(i, j), max(i, j)) for a, b in nearcopies.close_pairs(np.zeros(6000, dtype=np.int64), ranks[0][order], ranks[1][order], 8) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()
        got.append(pairs)
    assert got[0] == got[1] and len(got[0]) >= 3000


@pytest.mark.parametrize(("bits", "kept"), [(69, 1), (70, 0)])
def test_finer_bits_are_compared_behind_the_fingerprints(bits, kept):
    words = [[0, (1 << k) - 1] for k in (0, 0)] + [[0, (1 << min(63, bits)) - 1], [0, (1 << bits - 63) - 1], [0, 0], [0, 0]]
    r1, r2, *finer = (np.array(w, dtype=np.int64) for w in words)
    zero = np.zeros(2, dtype=np.int64)
    assert sum(b.num_rows for b in nearcopies._emit([zero, r1, r2, np.array([1, 2]), zero.astype(np.int32), *finer])) == kept


def test_fields_are_filled_from_deeper_layers(spark):
    cols = "request_id bigint, member_no int, slug string, origin string, title string, page_type string, description string, created_on string, updated_on string"
    rows = [
        (1, 1, "a", "reviewed", "A", "entity", None, "2024", "2025-01-01"),  # the skyline alone
        (1, 2, "b", "ingested", "B", "entity", "todo", None, "2024-06-01"),  # layer 2
        (1, 3, "c", "ingested", None, None, "text of c", None, "2024-01-01"),  # layer 3, the only text
        (2, 1, "d", "guessed", "D", "x", "y", "z", "2025-01-01"), (2, 2, "e", "reviewed", None, None, "E", None, "2024-01-01"),  # one layer: neither beats the other
        (3, 1, "f", "clipped", None, "x", "y", None, "2025-01-01"), (3, 2, "g", "clipped", "G", None, None, None, "2024-01-01"), (3, 3, "h", "guessed", "H", "x", "y", "z", "2025-01-01"),
    ]
    got = {(r.request_id, r.field_name): (r.slug, r.layer) for r in survivors.surviving_values(spark.createDataFrame(rows, cols)).collect()}
    assert got[1, "title"] == ("a", 1) and got[1, "description"] == ("c", 3) and got[1, "created_on"] == ("a", 1)
    assert got[2, "description"] == ("e", 1) and got[2, "title"] == ("d", 1)
    # the front's h has a title, but the more trusted g of the second layer has one too
    assert got[3, "title"] == ("g", 2) and got[3, "created_on"] == ("h", 1)


def test_vectors_are_written_as_often_however_few_pivots_a_node_has(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.1 for _ in range(6)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    points = neighbours.usable_vectors(df, "vec_id", "embedding", 16)
    monkeypatch.setattr(neighbours, "SHARD", 120)
    monkeypatch.setattr(neighbours, "CELL", 30)
    found = {}
    for fan in (1024, 8):
        monkeypatch.setattr(neighbours, "FAN", fan)
        tree = neighbours.pivot_tree(points, len(x), 16, 4, 0.15)
        r = neighbours.routed(points, tree, 16, 4, 0.15)
        per = [n["count"] for n in r.groupBy("id").count().collect()]
        assert len(per) == len(x) and max(per) <= 4 and (fan == 1024) == (len(tree.inner) == 1)
        assert max(n["count"] for n in r.groupBy("leaf", "part").count().collect()) <= 240
        found[fan] = {(p.id, p.near) for p in neighbours.nearest(df, k=5, min_score=0.85, size=16).collect()}
    u = neighbours._unit(x.astype(np.float32))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.85}
    assert all(len(f & want) > 0.97 * len(want) for f in found.values())


def test_vectors_too_alike_for_pivots_are_cut_by_hash(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 50)
    rows = [(i, [1.0, 1e-7 * i, 0.0, 0.0]) for i in range(400)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=3, size=4).collect()
    assert len(got) == 1200 and all(r.score > 0.999 for r in got)


def test_vectors_too_alike_for_pivots_all_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 50)
    # pairs close together among vectors that all are alike: a partner in another block must not be lost
    rows = [(i, [1.0, 1e-3 * (i // 2) + 1e-6 * (i % 2), 0.0, 0.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    tree = neighbours.Tree()
    tree.parts[0] = 12
    shards = neighbours.routed(neighbours.usable_vectors(df, "vec_id", "embedding", 4), tree, 4, 4, 0.15).groupBy("leaf", "part").agg(F.collect_list("id").alias("ids")).collect()
    met = {(a, b) for r in shards for a in r.ids for b in r.ids if a != b}
    assert len(met) == 300 * 299 and max(len(r.ids) for r in shards) < 100


def test_a_tree_leads_to_the_nearest_leaves_behind_farther_nodes():
    rng = np.random.default_rng(3)
    pivots = neighbours._unit(rng.normal(size=(256, 16))).astype(np.float32)
    tree = neighbours.Tree()
    mine = np.argsort(pivots[:, 0], kind="stable").reshape(16, 16)
    tree.grow(0, neighbours._unit(pivots[mine].sum(1)).astype(np.float32))
    for k in range(16):
        tree.grow(1 + k, pivots[mine[k]])
    x = neighbours._unit(rng.normal(size=(500, 16))).astype(np.float32)
    rows, leaf = tree.leaves(x, 4, 9.0)
    found = {(r, n) for r, n in zip(rows.tolist(), mine.ravel()[leaf - 17].tolist(), strict=True)}
    best = {(r, int(n)) for r, s in enumerate(x @ pivots.T) for n in np.argsort(-s)[:4]}
    # all sixteen nodes are followed: these are the leaves of a flat search
    assert found == best


def test_routing_keeps_its_memory_small():
    import tracemalloc

    rng = np.random.default_rng(0)
    tree = neighbours.Tree()
    tree.grow(0, rng.normal(size=(1024, 64)).astype(np.float32))
    x = rng.normal(size=(10_000, 64)).astype(np.float32)
    tracemalloc.start()
    rows, _ = tree.leaves(x, 4, 0.15)
    assert tracemalloc.get_traced_memory()[1] < 100e6 and set(rows.tolist()) == set(range(10_000))
    tracemalloc.stop()


def longest_common(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_longest_matches_against_brute_force(seed, monkeypatch):
    rnd = random.Random(seed)
    for _ in range(12):
        size, n = rnd.choice([1, 2, 3, 8]), rnd.choice([1, 2, 3, 5, 7, 12])
        some = lambda k: " ".join("abcdefgh"[rnd.randrange(size)] for _ in range(k))  # noqa: B023, E731
        items = [(i, some(rnd.randint(0, 30))) for i in range(5)]
        docs = [rnd.choice([None, "", some(rnd.randint(0, 40)), some(rnd.randint(0, 9)) + " zz " + rnd.choice(items)[1]]) for _ in range(6)]
        monkeypatch.setattr(leakage, "SHARD", rnd.choice([10, 1000]))
        got = {(int(d), int(i)): (int(k), int(x), int(y)) for cols in leakage.matches(leakage.Passages(items, n), docs) for d, i, k, x, y in zip(*cols, strict=True)}
        want = {(d, i): m for d, t in enumerate(docs) for i, q in items if (m := longest_common(leakage.words(t or ""), leakage.words(q))) >= n}
        assert {k: v[0] for k, v in got.items()} == want
        assert all(leakage.words(docs[d])[x : x + k] == leakage.words(dict(items)[i])[y : y + k] for (d, i), (k, x, y) in got.items())


def test_repeated_words_cost_no_more_than_others():
    import time

    began = time.time()
    got = [c for c in leakage.matches(leakage.Passages([(1, "q " * 10_000), (2, "a b " * 5000)], 12), ["z " + "q " * 10_000, "b a " * 5000])]
    assert {(int(d), int(n)) for cols in got for d, _, n, *_ in zip(*cols, strict=True)} == {(0, 10_000), (1, 9999)} and time.time() - began < 3


def plain_depths(parts):
    """Valleys by their definition, climbing from every gap to both sides."""
    flat, at, sims = [w for p in parts for w in p], 0, []
    for p in parts[:-1]:
        at += len(p)
        sims.append(splitting._cosine(splitting._bag(flat[max(0, at - splitting.SIDE) : at]), splitting._bag(flat[at : at + splitting.SIDE])))
    out = []
    for i, s in enumerate(sims):
        tops = []
        for step in (-1, 1):
            k = i
            while 0 <= k + step < len(sims) and sims[k + step] >= sims[k]:
                k += step
            tops.append(sims[k])
        out.append(sum(tops) - 2 * s)
    return out


def test_depths_by_their_definition():
    rnd = random.Random(6)
    for _ in range(60):
        parts = [[rnd.choice(["river", "stone", "lamp", "of", "bread"]) for _ in range(rnd.choice([0, 1, 5, 30, 90]))] for _ in range(rnd.randint(1, 30))]
        assert splitting.depths(parts) == pytest.approx(plain_depths(parts))
    import time

    began = time.time()
    assert len(splitting.depths([["same"]] * 20_000)) == 19_999 and time.time() - began < 5


def test_a_long_block_is_cut_where_its_subject_changes():
    bread = [f"bread oven dough flour crust yeast {i}" for i in range(12)]
    river = [f"river water flood bridge stone bank {i}" for i in range(12)]
    text = "\n".join(bread + river)
    size = len("\n".join(bread + river[:4]))
    spans = splitting.inside(text, splitting.Block(0, len(text), 1), size)
    # the last line break of the window is four lines further on
    assert text[spans[0][0] : spans[0][1]] == "\n".join(bread) and text[spans[1][0] : spans[1][1]].startswith(river[0])
    pieces = splitting.split(text, size)
    assert [(p.start, p.end) for p in pieces] == spans and all(p.cut for p in pieces)
    over = splitting.overlap(text, pieces[1].start, 100)
    assert 0 < len(over) <= 100 and text[: pieces[1].start].endswith(over) and over.startswith("bread")


def units(text, corpus=None):
    out, at = [], 0
    for e in sentences.Splitter(corpus).ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        # an abbreviation of no list: a small letter follows again and again, other sentences begin with capitals
        ("We used abk. for the unit. The abk. is short. Later abk. returns.", ["We used abk. for the unit.", "The abk. is short.", "Later abk. returns."]),
        # no abbreviations: sentences begin small here
        ("the oven is dry. then we left. the oven was dry. we ate.", ["the oven is dry.", "then we left.", "the oven was dry.", "we ate."]),
        # words of the lists that the document also writes without a stop
        ("He told me. Then they gave me the key, then left.", ["He told me.", "Then they gave me the key, then left."]),
        ("She studied art. He likes art because he paints.", ["She studied art.", "He likes art because he paints."]),
        ("So did I. We went home, and I said that we won.", ["So did I.", "We went home, and I said that we won."]),
        # a name behind an abbreviation is no sentence
        ("The cap. was closed. The cap. is blue. Another cap. Boston made it, and old Boston is far.", ["The cap. was closed.", "The cap. is blue.", "Another cap. Boston made it, and old Boston is far."]),
        ("Dr. Smith met Dr. Smith, who is a dr of law.", ["Dr. Smith met Dr. Smith, who is a dr of law."]),
        # no limits of length
        ("We saw unabbreviatedabk. for once. The unabbreviatedabk. is long. A unabbreviatedabk. returns.", ["We saw unabbreviatedabk. for once.", "The unabbreviatedabk. is long.", "A unabbreviatedabk. returns."]),
        ("It is so.[^a-very-long-footnote-name] Next.", ["It is so.[^a-very-long-footnote-name]", "Next."]),
    ],
)
def test_documents_speak_for_their_words(text, want):
    assert units(text) == want


def test_the_corpus_speaks_where_the_document_is_silent(spark):
    once = "He saw the qty. of oil."
    assert units(once) == ["He saw the qty.", "of oil."]
    docs = spark.createDataFrame([(i, f"The qty. is {i}. We wrote the qty. of oil.") for i in range(30)], "doc_id bigint, text string")
    known = sentences.corpus_evidence(docs, "text")
    assert known.kind("qty") == "abbr" and known.kind("oil") is None
    assert units(once, known) == [once]


def test_hot_cells_give_the_same_pairs(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [("f", i, ["a", "b", "c", *rnd.sample("defghijk", rnd.randint(1, 3))]) for i in range(250)]
    df = spark.createDataFrame(rows, "set_field string, id bigint, values array<string>")
    pairs = lambda: {(r.a, r.b, r.common, r.united) for r in setjoin.similar_sets(df)[0].collect()}
    plain = pairs()
    monkeypatch.setattr(setjoin, "BLOCK", 6)
    monkeypatch.setattr(setjoin, "SHARE", 2)
    assert pairs() == plain and len(plain) > 100
