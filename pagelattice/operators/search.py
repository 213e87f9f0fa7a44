"""Ranked retrieval: keyword scores, vector hits, page scores, reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions import text as T
from pagelattice.session import shared_checkpoint

#: Points for the phrase as file name, in the title, in the text (each time, so many times at most), and for a token in the title and in the text.
EXACT, IN_TITLE, IN_TEXT, MOST, TITLE_TOKEN, TEXT_TOKEN = 200, 50, 20, 10, 5, 1
RRF = 60
#: The queries that one pass holds in every task. More queries take more passes.
BLOCK = 4096


def parsed_queries(queries: DataFrame) -> DataFrame:
    """``query_id, query`` with ``tokens`` and ``phrase``; a query without tokens has its trimmed text as the only one."""
    tokens, low = T.token_array(F.col("query")), F.lower(F.trim("query"))
    return queries.select("query_id", F.when(F.size(tokens) > 0, tokens).otherwise(F.array(low)).alias("tokens"), T.phrase(F.col("query")).alias("phrase"))


def keyword_scores(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, page_id, score, title_match`` of every page that any part of a query meets.

    pages: ``page_id, path, title, content``. The stated query set meets all pages: it is broadcast after its size is
    checked, in blocks of BLOCK queries, and the pages are read once per block, never shuffled.
    """
    q = parsed_queries(queries)
    name = T.file_name(F.col("path"))
    stem = F.lower(F.regexp_replace(name, r"(?i)\.md$", ""))
    head = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), name))
    p = pages.select("page_id", stem.alias("stem"), head.alias("head"), F.lower(F.coalesce("content", F.lit(""))).alias("low"))
    return reduce(DataFrame.unionByName, [_scored(p, F.broadcast(b)) for b in _blocks(q)])


def _blocks(q: DataFrame) -> Iterator[DataFrame]:
    n = q.limit(BLOCK + 1).count()
    if n <= BLOCK:
        yield q
        return
    numbered = q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(-(-q.count() // (BLOCK // 2)))))
    for b in sorted(r[0] for r in numbered.select("_block").distinct().collect()):
        yield numbered.where(F.col("_block") == b).drop("_block")


def _scored(p: DataFrame, q: DataFrame) -> DataFrame:
    has = F.col("phrase") != ""
    one = lambda c: F.when(has & c, 1).otherwise(0)
    holds = lambda text: F.size(F.filter("tokens", lambda t: F.col(text).contains(t)))
    n = (F.length("low") - F.length(F.replace(F.col("low"), F.col("phrase"), F.lit("")))) / F.greatest(F.length("phrase"), F.lit(1))
    hit = F.exists("tokens", lambda t: F.col("low").contains(t) | F.col("head").contains(t)) | (has & (F.col("low").contains(F.col("phrase")) | F.col("head").contains(F.col("phrase"))))
    parts = p.join(q, hit, "inner").select(
        "query_id", "page_id", one(F.col("stem") == F.col("phrase")).alias("exact"), one(F.col("head").contains(F.col("phrase"))).alias("named"),
        F.when(has, F.least(n.cast("int"), F.lit(MOST))).otherwise(0).alias("times"), holds("head").alias("in_title"), holds("low").alias("in_text"),
    )
    score = F.col("exact") * EXACT + F.col("named") * IN_TITLE + F.col("times") * IN_TEXT + F.col("in_title") * TITLE_TOKEN + F.col("in_text") * TEXT_TOKEN
    return parts.select("query_id", "page_id", score.cast("bigint").alias("score"), ((F.col("in_title") > 0) | (F.col("named") > 0)).alias("title_match")).where("score > 0")


def ranked(scores: DataFrame, by: Column, tie: str, name: str, top: int | None = None) -> DataFrame:
    """``scores`` with 1-based rank per query; top keeps the first so many, which Spark limits before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(by, tie)
    out = scores.withColumn(name, F.row_number().over(w).cast("bigint"))
    return out if top is None else out.where(F.col(name) <= top)


def token_ranks(scores: DataFrame, k: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """``scores`` with their ranks per query. With ``k`` and ``wanted`` (``query_id, page_id``, a few of each query) only the first ``k`` and the wanted ones.

    A wanted page's rank is one more than the number of pages before it, a sum; so no query's hits are ordered in one task.
    """
    if k is None or wanted is None:
        return ranked(scores, F.desc("score"), "page_id", "token_rank")
    scores = shared_checkpoint(scores)
    first = ranked(scores, F.desc("score"), "page_id", "token_rank", k)
    own = scores.join(wanted.select("query_id", "page_id").distinct(), ["query_id", "page_id"])
    mine = own.select("query_id", F.col("page_id").alias("_p"), F.col("score").alias("_s"))
    ahead = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("page_id") < F.col("_p")))
    places = scores.select("query_id", "page_id", "score").join(mine, "query_id").groupBy("query_id", F.col("_p").alias("page_id")).agg((F.sum(ahead.cast("bigint")) + 1).alias("token_rank"))
    rest = own.join(places.where(F.col("token_rank") > k), ["query_id", "page_id"]).select(*first.columns)
    return first.unionByName(rest)


def over_fetch(k: int) -> tuple[int, int]:
    """Pages and chunks to look at for ``k`` results."""
    return max(k, 10), max(3 * k, 30)


def vector_hits(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_key, page_id, chunk_index, distance``: the ``k`` chunks of least squared Euclidean distance, exactly.

    chunks: ``chunk_key, page_id, chunk_index, vector``; queries: ``query_id, vector``. Each batch of chunks is multiplied
    with the block of queries and hands on its own best ``k``; only these are shuffled. Null vectors and those of another
    length than the queries or with non-finite values are left out; ties go to the lower chunk key.
    """
    usable = lambda d: d.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = chunks.select("chunk_key", "page_id", "chunk_index", F.col("vector").cast("array<double>").alias("vector"))
    key_t, page_t, q_t = (dict(chunks.dtypes)["chunk_key"], dict(chunks.dtypes)["page_id"], dict(queries.dtypes)["query_id"])

    def over(held):
        # one broadcast a block: the driver holds one block at a time
        block = chunks.sparkSession.sparkContext.broadcast(([x[0] for x in held], np.array([x[1] for x in held], dtype=np.float64).reshape(len(held), -1 if held else 1)))

        def run(batches):
            ids, m = block.value
            for b in batches:
                v = b.column(3)
                b = b.filter(pc.equal(pc.list_value_length(v), m.shape[1]))
                if not len(b):
                    continue
                x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, m.shape[1])
                keys = np.argsort(np.argsort(np.array(b.column(0).to_pylist()), kind="stable"), kind="stable")
                w = min(k, len(b))
                square = (x * x).sum(1)[None, :]
                for q in range(0, len(m), 256):
                    part = m[q : q + 256]
                    d = np.maximum((part * part).sum(1)[:, None] + square - 2 * part @ x.T, 0)
                    cut = np.partition(d, w - 1, axis=1)[:, w - 1 : w]
                    r, c = np.nonzero(d <= cut + 1e-12)
                    order = np.lexsort((keys[c], d[r, c], r))
                    r, c = r[order], c[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c = r[place < w], c[place < w]
                    exact = ((part[r] - x[c]) ** 2).sum(1)
                    at = pa.array(c)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[q + i] for i in r]), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at).cast(pa.int64()), pa.array(exact)],
                                                     names=["query_id", "chunk_key", "page_id", "chunk_index", "distance"])

        return usable(rows).mapInArrow(run, f"query_id {q_t}, chunk_key {key_t}, page_id {page_t}, chunk_index bigint, distance double")

    held, parts = [], []
    for r in usable(queries).select("query_id", "vector").toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            parts.append(over(held))
            held = []
    if held or not parts:
        parts.append(over(held))
    found = reduce(DataFrame.unionByName, parts)
    return ranked(found, F.col("distance"), "chunk_key", "hit_rank", k)


def page_scores(hits: DataFrame) -> DataFrame:
    """``query_id, page_id, vector_score, chunk_index``: best chunk plus 0.3 of the others, these up to what is left to 1; with the best chunk."""
    s = hits.withColumn("s", 1 / (1 + F.col("distance")))
    g = s.groupBy("query_id", "page_id").agg(F.max("s").alias("top"), F.sum("s").alias("all"), F.max_by("chunk_index", F.struct("s", -F.col("chunk_index"))).alias("chunk_index"))
    blended = F.col("top") + F.least(0.3 * (F.col("all") - F.col("top")), F.greatest(F.lit(0.0), 1 - F.col("top")))
    return g.select("query_id", "page_id", F.round(blended, 9).alias("vector_score"), "chunk_index")


def vector_ranks(scores: DataFrame, top: int | None = None) -> DataFrame:
    return ranked(scores, F.desc("vector_score"), "page_id", "vector_rank", top)


def fuse(tokens: DataFrame, vectors: DataFrame, pages: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, page_id, score, token_rank, vector_rank, mode``: the ``k`` best by reciprocal ranks.

    Vector hits of pages that are gone are dropped, but a query that had any is ranked by fusion; one without keeps its
    keyword scores. mode tells which side found anything for the query.
    """
    any_v = vectors.select("query_id").distinct().withColumn("has_v", F.lit(True))
    alive = vectors.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    t = tokens.select("query_id", "page_id", F.col("score").alias("token_score"), "token_rank")
    both = t.join(alive.select("query_id", "page_id", "vector_rank"), ["query_id", "page_id"], "full_outer").join(any_v, "query_id", "left")
    share = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    score = F.when(F.col("has_v"), F.round(share("token_rank") + share("vector_rank"), 9)).otherwise(F.col("token_score").cast("double"))
    any_t = F.max(F.col("token_rank").isNotNull()).over(Window.partitionBy("query_id"))
    mode = F.when(~F.coalesce("has_v", F.lit(False)), "keyword").when(any_t, "hybrid").otherwise("vector")
    return ranked(both.select("query_id", "page_id", score.alias("score"), "token_rank", "vector_rank", mode.alias("mode")), F.desc("score"), "page_id", "place", k)


def orphaned_hits(vectors: DataFrame, pages: DataFrame) -> DataFrame:
    """Vector hits whose page is gone."""
    return vectors.join(pages.select("page_id").distinct(), "page_id", "left_anti")


def image_hits(results: DataFrame, tokens: Column) -> DataFrame:
    """Images of ranked results, each url once, owned by the first result that shows it; alt texts that hold a token come first.

    results: ``query_id, place, page_id, images array<struct<url, alt>>``.
    """
    i = results.select("query_id", "place", "page_id", F.posexplode("images").alias("pos", "i")).select("query_id", "place", "page_id", "pos", "i.url", "i.alt")
    first = i.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("place", "pos"))).where("n = 1")
    match = F.exists(tokens, lambda t: F.lower(F.col("alt")).contains(t))
    w = Window.partitionBy("query_id").orderBy(F.when(match, 0).otherwise(1), "place", "pos")
    return first.select("query_id", "page_id", "url", "alt", match.alias("matched"), F.row_number().over(w).alias("turn"))


def first_seen(results: DataFrame, keys: list[str], order: list[str], cap: int, per: list[str]) -> DataFrame:
    """External results, each key once in order of arrival, at most ``cap`` of each ``per``. The cap is the feature."""
    once = results.withColumn("_n", F.row_number().over(Window.partitionBy(*per, *keys).orderBy(*order))).where("_n = 1").drop("_n")
    return once.withColumn("turn", F.row_number().over(Window.partitionBy(*per).orderBy(*order)).cast("bigint")).where(F.col("turn") <= cap)
