"""Queries of the retrieval operators: entity summaries as pages, chunk vectors as their chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.operators import search as S
from pagelattice.session import table

#: The query set of the keyword queries.
ASKED = [(1, "the rusted lantern"), (2, "sturdy belfry of"), (3, "水泵 记录"), (4, "map"), (5, "Is the oven dry?"), (6, "of the"), (7, "plough letters near")]


def _pages(spark, d):
    """One page per slug: the latest delivery of its latest summary."""
    e = table(spark, d, "entity_summaries")
    last = F.max(F.struct("updated_at", "summary_id", "ingested_at", "path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("content"))).alias("r")
    return e.groupBy(F.col("slug").alias("page_id")).agg(last).select("page_id", "r.path", "r.title", "r.content")


def _asked(spark):
    return spark.createDataFrame(ASKED, "query_id bigint, query string")


def _chunks(spark, d):
    c = table(spark, d, "chunk_vectors").dropDuplicates(["vec_id"]).where(F.size("embedding") == 64)
    return c.select(F.col("vec_id").alias("chunk_key"), "page_id", "chunk_index", F.col("embedding").alias("vector"))


def _vectors(spark, d):
    """Every vector whose id is divisible by 50 as a query."""
    return _chunks(spark, d).where("chunk_key % 50 = 0").select(F.col("chunk_key").alias("query_id"), "vector")


def keyword_search(spark, d):
    return S.ranked(S.keyword_scores(_pages(spark, d), _asked(spark)), F.desc("score"), "page_id", "place", 20)


def keyword_hits(spark, d):
    return S.keyword_scores(_pages(spark, d), _asked(spark)).groupBy("query_id", "title_match").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


def vector_topk(spark, d):
    return S.vector_hits(_chunks(spark, d), _vectors(spark, d), 30).select("query_id", "chunk_key", F.round("distance", 6).alias("distance"), "hit_rank")


def vector_page_scores(spark, d):
    hits = S.vector_hits(_chunks(spark, d), _vectors(spark, d), 30)
    return S.page_scores(hits).select("query_id", "page_id", F.round("vector_score", 6).alias("vector_score"), F.col("chunk_index").cast("bigint").alias("chunk_index"))


def _fused(spark, d):
    """The keyword queries beside vectors: query n has the vector with id 50 n."""
    pages = _pages(spark, d)
    asked = _vectors(spark, d).where("query_id <= 250").withColumn("query_id", (F.col("query_id") / 50).cast("bigint"))
    vectors = S.vector_ranks(S.page_scores(S.vector_hits(_chunks(spark, d), asked, S.over_fetch(20)[1])), S.over_fetch(20)[0])
    return S.token_ranks(S.keyword_scores(pages, _asked(spark)), 20, vectors), vectors, pages


def hybrid_search(spark, d):
    return S.fuse(*_fused(spark, d)).select("query_id", "page_id", F.round("score", 6).alias("score"), "mode")


def orphaned_vector_hits(spark, d):
    hits = S.page_scores(S.vector_hits(_chunks(spark, d), _vectors(spark, d), 30))
    return S.orphaned_hits(hits, _pages(spark, d)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_queries"))


def external_dedup(spark, d):
    """Chunk texts as results of an outside search, one list per page, deduplicated by text."""
    c = table(spark, d, "chunk_vectors").where("chunk_text IS NOT NULL").withColumn("key", F.lower(F.trim("chunk_text")))
    return S.first_seen(c, ["key"], ["chunk_index", "vec_id"], 10, ["page_id"]).select("page_id", "turn", "vec_id")


_PAGES = """pages AS (SELECT slug page_id, path, coalesce(title, '') title, coalesce(description, '') content FROM entity_summaries
  QUALIFY row_number() OVER (PARTITION BY slug ORDER BY updated_at DESC, summary_id DESC, ingested_at DESC) = 1)"""
_ASKED = "asked(query_id, tokens, phrase) AS (VALUES (1, ['lantern', 'rusted'], 'the rusted lantern'), (2, ['belfry', 'sturdy'], 'sturdy belfry of'), (3, ['水泵', '记录'], '水泵 记录'), (4, ['map'], 'map'), (5, ['dry', 'oven'], 'is the oven dry'), (6, ['of the'], 'of the'), (7, ['letters', 'near', 'plough'], 'plough letters near'))"
_SCORED = f"""{_PAGES}, {_ASKED},
 parts AS (SELECT query_id, page_id, CAST(regexp_replace(lower(regexp_replace(path, '^.*/', '')), '\\.md$', '') = phrase AS INT) * 200
    + CAST(contains(lower(title || ' ' || regexp_replace(path, '^.*/', '')), phrase) AS INT) * 50
    + least(10, (length(content) - length(replace(lower(content), phrase, ''))) // length(phrase)) * 20
    + len(list_filter(tokens, lambda t: contains(lower(title || ' ' || regexp_replace(path, '^.*/', '')), t))) * 5
    + len(list_filter(tokens, lambda t: contains(lower(content), t))) score,
    contains(lower(title || ' ' || regexp_replace(path, '^.*/', '')), phrase) OR len(list_filter(tokens, lambda t: contains(lower(title || ' ' || regexp_replace(path, '^.*/', '')), t))) > 0 title_match
  FROM pages, asked),
 scored AS (SELECT query_id, page_id, CAST(score AS BIGINT) score, title_match FROM parts WHERE score > 0)"""
_HITS = """v AS (SELECT vec_id, any_value(page_id) page_id, any_value(chunk_index) chunk_index, any_value(CAST(embedding AS DOUBLE[])) e FROM chunk_vectors WHERE len(embedding) = 64
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY 1),
 hits AS (SELECT a.vec_id query_id, b.vec_id chunk_key, b.page_id, b.chunk_index, list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) distance
   FROM v a, v b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY distance, b.vec_id) <= {k}),
 ps AS (SELECT query_id, page_id, max(1 / (1 + distance)) top, sum(1 / (1 + distance)) s, arg_min(chunk_index, distance) chunk_index FROM hits GROUP BY 1, 2),
 pages_v AS (SELECT query_id, page_id, top + least(0.3 * (s - top), greatest(0, 1 - top)) vector_score, chunk_index FROM ps)"""


def queries():
    return {f.__name__: f for f in (keyword_search, keyword_hits, vector_topk, vector_page_scores, hybrid_search, orphaned_vector_hits, external_dedup)}


def oracle_sql():
    hits = _HITS.format(k=30)
    return {
        "keyword_search": f"WITH {_SCORED} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) place FROM scored QUALIFY place <= 20",
        "keyword_hits": f"WITH {_SCORED} SELECT query_id, title_match, count(*) n, CAST(sum(score) AS BIGINT) total FROM scored GROUP BY 1, 2",
        "vector_topk": f"WITH {hits} SELECT query_id, chunk_key, round(distance, 6) distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_key) hit_rank FROM hits",
        "vector_page_scores": f"WITH {hits} SELECT query_id, page_id, round(vector_score, 6) vector_score, CAST(chunk_index AS BIGINT) chunk_index FROM pages_v",
        "hybrid_search": f"""WITH {_SCORED}, {_HITS.format(k=60)},
            t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) tr FROM scored),
            r AS (SELECT query_id // 50 query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, page_id) vr FROM pages_v WHERE query_id <= 250 QUALIFY vr <= 20),
            b AS (SELECT coalesce(t.query_id, r.query_id) query_id, coalesce(t.page_id, r.page_id) page_id, score, tr, vr
              FROM t FULL JOIN (SELECT * FROM r WHERE page_id IN (SELECT page_id FROM pages)) r ON t.query_id = r.query_id AND t.page_id = r.page_id),
            f AS (SELECT query_id, page_id, CASE WHEN query_id IN (SELECT query_id FROM r) THEN round(coalesce(1.0::DOUBLE / (60 + tr), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0), 9) ELSE score END s,
              CASE WHEN query_id NOT IN (SELECT query_id FROM r) THEN 'keyword' WHEN bool_or(tr IS NOT NULL) OVER (PARTITION BY query_id) THEN 'hybrid' ELSE 'vector' END AS mode FROM b)
            SELECT query_id, page_id, round(s, 6) AS score, mode FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, page_id) <= 20""",
        "orphaned_vector_hits": f"WITH {_PAGES}, {hits} SELECT page_id, count(*) n_queries FROM pages_v WHERE page_id NOT IN (SELECT page_id FROM pages) GROUP BY 1",
        "external_dedup": """WITH o AS (SELECT page_id, vec_id, chunk_index, lower(trim(chunk_text)) k FROM chunk_vectors WHERE chunk_text IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY page_id, k ORDER BY chunk_index, vec_id) = 1)
            SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY chunk_index, vec_id) turn, vec_id FROM o QUALIFY turn <= 10""",
    }
