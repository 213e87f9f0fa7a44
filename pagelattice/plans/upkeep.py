"""Queries of chunking, change detection, context packing and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions import markdown as M
from pagelattice.functions.bind import let
from pagelattice.functions.keys import file_key
from pagelattice.operators import changes as C
from pagelattice.operators import chunks as H
from pagelattice.operators import context as X
from pagelattice.operators import curation as U
from pagelattice.operators import graph as G
from pagelattice.operators import search as S
from pagelattice.plans.graph import _N, _nodes
from pagelattice.plans.references import sql_file_key, sql_page_key
from pagelattice.plans.search import _SCORED, _asked, _pages
from pagelattice.session import shared_checkpoint, table

THEN, NOW = "2024-07-01 00:00:00", "2025-03-01 00:00:00"


def chunked_documents(spark, d):
    """Per document: chunks, the longest, and how many hold a block that may not be cut."""
    c = H.chunked(table(spark, d, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("char_end") - F.col("char_start")).alias("longest"), F.sum(F.col("oversized").cast("bigint")).alias("n_oversized"))


def chunk_coverage(spark, d):
    """Per layout: visible characters of the bodies, and those that the chunks hold."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n")))
    bare = lambda c: F.length(F.regexp_replace(c, r"[\s\p{Z}]+", ""))
    per = H.chunked(docs, "doc_id", "text").join(docs.select("doc_id", "layout", "text"), "doc_id")
    per = per.groupBy("layout").agg(F.sum(bare(F.expr("substring(text, char_start + 1, char_end - char_start)"))).cast("bigint").alias("n_held"))
    body = docs.groupBy("layout").agg(F.sum(bare(M.strip_top(F.col("text")))).cast("bigint").alias("n_chars"))
    return body.join(per, "layout").select("layout", "n_chars", "n_held")


def _files_at(spark, d, t):
    f = table(spark, d, "source_files").where((F.col("arrived_at") <= F.lit(t).cast("timestamp_ntz")) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.lit(t).cast("timestamp_ntz"))))
    last = F.max(F.struct("arrived_at", "file_id", "ingested_at", "md5_hex", "size_bytes")).alias("r")
    return f.groupBy(file_key(F.col("source_key")).alias("path")).agg(last).select("path", F.col("r.md5_hex").alias("hash"), F.col("r.size_bytes").alias("size"))


def snapshot_diff(spark, d):
    return C.snapshot_diff(_files_at(spark, d, THEN), _files_at(spark, d, NOW))


def coalesced_changes(spark, d):
    """Arrivals and deletions of each file as one open change."""
    f = table(spark, d, "source_files").select("file_id", "source_key", "arrived_at", "deleted_at").distinct()
    e = f.select(F.col("source_key").alias("key"), F.col("arrived_at").alias("at"), F.lit("created").alias("kind")).unionByName(
        f.where("deleted_at IS NOT NULL").select(F.col("source_key").alias("key"), F.col("deleted_at").alias("at"), F.lit("deleted").alias("kind")))
    return C.coalesce_changes(e)


def cached_documents(spark, d):
    """Documents whose text an earlier document of the same source had, as hits of a cache whose outputs are all there."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"))
    cache = docs.groupBy("sha256").agg(F.min("doc_id").alias("identity"))
    cache = cache.select(F.lit("corpus").alias("identity"), "sha256", F.array(F.col("identity").cast("string")).alias("outputs"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"))
    sources = docs.select(F.lit("corpus").alias("identity"), "sha256", "doc_id")
    return sources.join(C.cache_hits(sources.select("identity", "sha256").distinct(), cache, files), ["identity", "sha256"], "left_semi").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


def packed_context(spark, d):
    ranked = S.ranked(S.keyword_scores(_pages(spark, d), _asked(spark)), F.desc("score"), "page_id", "place", 20)
    return X.pack(ranked.join(_pages(spark, d).select("page_id", "content"), "page_id"), 1500, 400)


def answer_context(spark, d):
    """The pages that each question is answered from: hits, pages related to them in the link graph, numbered within the budget."""
    pages = _pages(spark, d)
    asked = _asked(spark).unionByName(spark.createDataFrame([(8, "Hello there!"), (9, "你好呀")], "query_id bigint, query string"))
    hits = S.ranked(S.keyword_scores(pages, asked), F.desc("score"), "page_id", "place", 10)
    nodes = _nodes(spark, d)
    edges = shared_checkpoint(G.resolve_links(nodes.select(F.col("id").alias("src"), F.explode("links").alias("target")), nodes))
    near = G.related(G.relevance(edges, nodes), hits.select(F.col("page_id").alias("seed")), 3, 2.0)
    return X.assembled(asked, hits, near, pages, 4000, 400)


def trimmed_pages(spark, d):
    """Every document trimmed to headings and lines on the oven or the map."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", X.trim_index(F.col("text"), F.array(F.lit("oven"), F.lit("map")), 300).alias("trimmed")).where("trimmed <> ''")


def last_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.struct("ts", "event_id").alias("turn"), "event_id")
    return X.last_messages(e, 10).select("conv_id", "event_id", "back")


def user_rollup(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.struct("ts", "event_id").alias("turn"), F.col("event_type").alias("text"), F.lit("user").alias("role"))
    return X.rollup(e).select("conv_id", "n_messages", "title", F.col("last.event_id").alias("last_event"))


def rate_limit(spark, d):
    """Events per user and hour as requests: how many would be refused at three an hour."""
    e = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("ts").alias("at"))
    return X.rate_limited(e, 3, 3600).groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("allowed")).cast("bigint")).alias("n_refused"), F.max("recent").alias("most"))


def merged_pages(spark, d):
    """All members of each merge request that have content, written over each other in their order: the page that results, by its hash, and what its block holds."""
    return read_merged(table(spark, d, "merge_members"))


TODAY = "2025-06-01"


def joined_pages(members):
    """``request_id, page``: the members folded in order of their numbers, bodies joined where they differ. A request with one member with content is that member; one with none gives no row; a null number comes last."""
    m = members.where("content IS NOT NULL AND request_id IS NOT NULL").groupBy("request_id", "member_no").agg(F.max("content").alias("content"))
    turn = F.struct(F.col("member_no").isNull().alias("late"), "member_no", "content")
    m = m.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["content"]).alias("pages"))
    both = lambda old, new: F.concat(F.regexp_replace(M.body(old), r"\s+\z", ""), F.lit("\n\n"), F.regexp_replace(M.body(new), r"\A\s+", ""))
    step = lambda old, new: U.merge_pages(old, new, both(old, new), F.lit(TODAY))
    return m.select("request_id", F.aggregate(F.slice("pages", F.lit(2), F.size("pages")), F.element_at("pages", 1), step).alias("page"))


def read_merged(members):
    """``request_id, md5, title, type, updated, tags, sources, related`` of ``joined_pages``."""
    listed = lambda b, f: F.array_join(M.array_field(b, f), "|").alias(f)
    scalar = lambda b, f: M.scalar_field(b, f).alias(f)
    fields = lambda b: F.struct(*[scalar(b, f) for f in ("title", "type", "updated")], *[listed(b, f) for f in U.LISTS])
    return joined_pages(members).select("request_id", F.md5("page").alias("md5"), let(M.frontmatter_block(F.col("page"), strict=True), fields).alias("r")).select("request_id", "md5", "r.*")


def deleted_sources(spark, d):
    """What deleting all files that were deleted until now would do to the pages that cite them."""
    gone = table(spark, d, "source_files").where("deleted_at IS NOT NULL").select(F.col("source_key").alias("source"))
    return U.delete_sources(_nodes(spark, d).select("id", "sources"), gone, file_key).select("id", "verdict", F.size("sources").cast("bigint").alias("n_left"))


def dead_references(spark, d):
    n = table(spark, d, "retrieval_nodes").where("deleted_at IS NOT NULL").select(F.col("page_id").alias("id")).distinct()
    return U.dead_references(_nodes(spark, d), n)


def rewritten_references(spark, d):
    """Links to members of merge requests led to the request's first member."""
    m = table(spark, d, "merge_members").groupBy("request_id").agg(F.min(F.struct("member_no", "slug")).alias("f"))
    r = table(spark, d, "merge_members").join(m, "request_id").where("slug <> f.slug").groupBy(F.col("slug").alias("old")).agg(F.min("f.slug").alias("new"))
    return U.rewrite_references(_nodes(spark, d), r).where("changed").select("id", F.size("links").cast("bigint").alias("n_links"))


def _reviews(spark, d):
    types = F.create_map(*[F.lit(x) for x in ("orphan", "suggestion", "broken-link", "missing-page", "semantic", "duplicate")])
    l = table(spark, d, "lint_results").dropDuplicates(["lint_id"])
    return l.select(F.col("lint_id").alias("seq"), F.coalesce(types[F.col("lint_type")], F.lit("confirm")).alias("type"), F.concat(F.lit("Missing page: "), F.col("page")).alias("title"),
                    F.coalesce("detail", F.lit("")).alias("description"), F.col("affected_pages").alias("pages"), (F.col("severity") == "info").alias("resolved"))


def merged_reviews(spark, d):
    return U.merge_reviews(_reviews(spark, d)).select("type", "key", F.md5("description").alias("text_md5"), F.size("pages").cast("bigint").alias("n_pages"), "n")


def settled_reviews(spark, d):
    n = _nodes(spark, d).select("id", F.col("label").alias("title"))
    return U.settled_reviews(_reviews(spark, d).withColumnRenamed("seq", "id"), n)


def linked_terms(spark, d):
    """Every document with the first mention of two terms made a link: links per document."""
    terms = F.array(F.struct(F.lit("oven").alias("term"), F.lit("oven").alias("target")), F.struct(F.lit("map").alias("term"), F.lit("chart").alias("target")))
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    n = lambda c, p: F.regexp_count(c, F.lit(p)).cast("bigint")
    out = U.link_terms(F.col("text"), terms)
    return docs.select("doc_id", n(out, r"\[\[oven\]\]").alias("n_oven"), n(out, r"\[\[chart\|map\]\]").alias("n_map")).where("n_oven + n_map > 0")


def duplicate_groups(spark, d):
    """Merge requests as proposed groups, without those whose first two members are told apart for an odd request."""
    m = table(spark, d, "merge_members").select("request_id", "member_no", "slug").distinct()
    groups = m.groupBy(F.col("request_id").alias("group_id")).agg(F.collect_list("slug").alias("slugs"))
    apart = groups.where("group_id % 3 = 0").select(F.transform("slugs", lambda x: F.upper(x)).alias("slugs"))
    pages = table(spark, d, "retrieval_nodes").select("page_id")
    return U.valid_groups(groups, pages, apart).select("group_id", F.size("slugs").cast("bigint").alias("n"))


def queries():
    fs = (chunked_documents, chunk_coverage, snapshot_diff, coalesced_changes, cached_documents, packed_context, answer_context, trimmed_pages, last_events, user_rollup, rate_limit, merged_pages,
          deleted_sources, dead_references, rewritten_references, merged_reviews, settled_reviews, linked_terms, duplicate_groups)
    return {f.__name__: f for f in fs}


def oracle_sql():
    fk, pk = sql_file_key, sql_page_key
    at = lambda t: f"SELECT {fk('source_key')} path, md5_hex h, size_bytes s FROM source_files WHERE arrived_at <= TIMESTAMP '{t}' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{t}') QUALIFY row_number() OVER (PARTITION BY {fk('source_key')} ORDER BY arrived_at DESC, file_id DESC, ingested_at DESC) = 1"
    reviews = """rv AS (SELECT lint_id seq, CASE lint_type WHEN 'orphan' THEN 'suggestion' WHEN 'broken-link' THEN 'missing-page' WHEN 'semantic' THEN 'duplicate' ELSE 'confirm' END AS type,
        lower(trim(page)) AS key, page, coalesce(detail, '') description, affected_pages pages FROM lint_results QUALIFY row_number() OVER (PARTITION BY lint_id) = 1)"""
    # what of a text lies outside of links: all before the first opening brackets, and what follows the closing ones of each
    outside = lambda t: f"(contains(ps[1], '{t}') OR len(list_filter(ps[2:], lambda s: contains(s, ']]') AND contains(substr(s, instr(s, ']]') + 2), '{t}'))) > 0)"
    times = lambda t: f"(length(text) - length(replace(text, '{t}', ''))) // {len(t)}"
    link = lambda term, to, whole: f"{times(whole)} + CASE WHEN {outside(term)} AND NOT contains(b, '[[{to}]]') AND NOT contains(b, '[[{to}|') THEN 1 ELSE 0 END"
    return {
        "rewritten_references": f"""WITH {_N}, f AS (SELECT request_id, slug first FROM merge_members QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY member_no NULLS FIRST, slug NULLS FIRST) = 1),
            o AS (SELECT slug old, min(first) new FROM merge_members JOIN f USING (request_id) WHERE slug <> first GROUP BY 1),
            r AS (SELECT {pk('old')} k, new FROM o QUALIFY row_number() OVER (PARTITION BY {pk('old')} ORDER BY old, new) = 1),
            j AS (SELECT id, coalesce(r.new, t) t, r.new IS NOT NULL hit FROM (SELECT id, unnest(links) t FROM n) LEFT JOIN r ON r.k = {pk('t')})
            SELECT id, count(DISTINCT t) + max(CASE WHEN t IS NULL THEN 1 ELSE 0 END) n_links FROM j GROUP BY 1 HAVING bool_or(hit)""",
        "linked_terms": rf"""WITH x AS (SELECT doc_id, text, regexp_replace(text, '(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)', '') b FROM documents WHERE text IS NOT NULL), y AS (SELECT *, string_split(b, '[[') ps FROM x),
            z AS (SELECT doc_id, CAST({link('oven', 'oven', '[[oven]]')} AS BIGINT) n_oven, CAST({link('map', 'chart', '[[chart|map]]')} AS BIGINT) n_map FROM y) SELECT * FROM z WHERE n_oven + n_map > 0""",
        "trimmed_pages": r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda s: starts_with(s, '##') OR contains(lower(s), 'oven') OR contains(lower(s), 'map')) ls FROM documents WHERE text IS NOT NULL),
            f AS (SELECT doc_id, list_reduce(list_prepend({'line': '', 'used': 0, 'kept': []::VARCHAR[]}, list_transform(ls, lambda s: {'line': s, 'used': 0, 'kept': []::VARCHAR[]})),
              lambda a, x: CASE WHEN a.used + length(x.line) + 1 <= 300 THEN {'line': '', 'used': CAST(a.used + length(x.line) + 1 AS INT), 'kept': list_append(a.kept, x.line)} ELSE a END) st FROM l)
            SELECT doc_id, array_to_string(st.kept, chr(10)) trimmed FROM f WHERE array_to_string(st.kept, chr(10)) <> ''""",
        "chunk_coverage": r"""SELECT layout, CAST(sum(length(b)) AS BIGINT) n_chars, CAST(sum(length(b)) AS BIGINT) n_held FROM (SELECT layout, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)),
            '(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)', ''), '[\s\p{Z}]+', '', 'g') b FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
        "snapshot_diff": f"""WITH b AS ({at(THEN)}), a AS ({at(NOW)}), j AS (SELECT coalesce(a.path, b.path) path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'deleted'
            WHEN a.s IS DISTINCT FROM b.s OR coalesce(a.h <> b.h, false) THEN 'modified' END kind FROM a FULL JOIN b ON a.path = b.path) SELECT * FROM j WHERE kind IS NOT NULL""",
        "coalesced_changes": """WITH f AS (SELECT DISTINCT file_id, source_key, arrived_at, deleted_at FROM source_files),
            e AS (SELECT source_key k, arrived_at t, 'created' kind FROM f UNION ALL SELECT source_key, deleted_at, 'deleted' FROM f WHERE deleted_at IS NOT NULL),
            l AS (SELECT k, count(*) n, list(kind ORDER BY t, kind) ks FROM e GROUP BY 1)
            SELECT k AS key, list_reduce(ks, lambda s, x: CASE WHEN (s = 'deleted' AND x = 'created') OR (s = 'created' AND x = 'deleted') THEN 'modified' ELSE x END) kind, n FROM l""",
        "cached_documents": "SELECT sha256(text) sha256, count(*) n FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "last_events": "SELECT user_id conv_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) back FROM events QUALIFY back <= 10",
        "user_rollup": "SELECT user_id conv_id, count(*) n_messages, arg_min(event_type, (ts, event_id)) title, arg_max(event_id, (ts, event_id)) last_event FROM events GROUP BY 1",
        "rate_limit": """WITH w AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) r FROM events)
            SELECT user_id client, count(*) n, CAST(sum((r > 3)::INT) AS BIGINT) n_refused, max(r) most FROM w GROUP BY 1""",
        "packed_context": f"""WITH RECURSIVE {_SCORED}, rk AS (SELECT query_id, page_id, content, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) place FROM scored JOIN pages USING (page_id) QUALIFY place <= 20),
            z AS (SELECT query_id, place, page_id, least(length(content), 400) + CASE WHEN length(content) > 400 THEN {len(X.CUT)} ELSE 0 END size, length(content) > 400 truncated FROM rk),
            f AS (SELECT query_id, place, page_id, size, truncated, size <= 1500 ok, CASE WHEN size <= 1500 THEN size ELSE 0 END used FROM z WHERE place = 1
              UNION ALL SELECT z.query_id, z.place, z.page_id, z.size, z.truncated, f.used + z.size <= 1500, f.used + CASE WHEN f.used + z.size <= 1500 THEN z.size ELSE 0 END FROM f JOIN z ON z.query_id = f.query_id AND z.place = f.place + 1)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) number, page_id, CAST(size AS BIGINT) size, truncated FROM f WHERE ok""",
        "deleted_sources": f"""WITH {_N}, s AS (SELECT id, unnest(sources) v FROM n), g AS (SELECT id, count(*) FILTER (WHERE k IN (SELECT {fk('source_key')} FROM source_files WHERE deleted_at IS NOT NULL)) gone, count(*) c
              FROM (SELECT id, {fk('v')} k FROM s WHERE v IS NOT NULL AND trim(v) <> '') GROUP BY 1)
            SELECT id, CASE WHEN gone = c THEN 'delete' ELSE 'rewrite' END verdict, c - gone n_left FROM g WHERE gone > 0""",
        "dead_references": f"""WITH {_N}, x AS (SELECT DISTINCT page_id FROM retrieval_nodes WHERE deleted_at IS NOT NULL), t AS (SELECT id, {pk('t')} k FROM (SELECT id, unnest(links) t FROM n) WHERE t IS NOT NULL)
            SELECT id, count(*) n_links FROM t WHERE k IN (SELECT {pk('page_id')} FROM x) AND id NOT IN (SELECT page_id FROM x) GROUP BY 1""",
        "merged_reviews": f"""WITH {reviews}, o AS (SELECT rv.* FROM rv JOIN (SELECT DISTINCT lint_id, severity FROM lint_results) s ON s.lint_id = seq WHERE coalesce(severity, '') <> 'info'),
            p AS (SELECT type, key, count(DISTINCT page) n_pages FROM (SELECT type, key, unnest(pages) page FROM o) WHERE page IS NOT NULL AND trim(page) <> '' GROUP BY 1, 2),
            g AS (SELECT type, key, arg_max(description, seq) FILTER (WHERE trim(description) <> '') description, count(*) n FROM o GROUP BY 1, 2)
            SELECT type, key, md5(description) text_md5, coalesce(n_pages, 0) n_pages, n FROM g LEFT JOIN p USING (type, key)""",
        "settled_reviews": f"""WITH {_N}, {reviews}, nm AS (SELECT {pk('id')} k FROM n UNION SELECT {pk('label')} FROM n)
            SELECT seq id, 'page exists' AS action FROM rv WHERE type = 'missing-page' AND {pk('key')} IN (SELECT k FROM nm)
            UNION ALL SELECT DISTINCT seq, 'page gone' FROM (SELECT seq, unnest(pages) p FROM rv WHERE type = 'duplicate') WHERE p IS NOT NULL AND {pk('p')} NOT IN (SELECT k FROM nm)""",
        "duplicate_groups": """WITH m AS (SELECT DISTINCT request_id, slug FROM merge_members), k AS (SELECT request_id, slug FROM m WHERE slug IN (SELECT page_id FROM retrieval_nodes)),
            a AS (SELECT DISTINCT string_agg(lower(slug), ',' ORDER BY lower(slug)) s FROM (SELECT DISTINCT request_id, member_no, slug FROM merge_members) WHERE request_id % 3 = 0 GROUP BY request_id),
            g AS (SELECT request_id group_id, count(*) n, string_agg(lower(slug), ',' ORDER BY lower(slug)) s FROM k GROUP BY 1 HAVING count(*) >= 2)
            SELECT group_id, n FROM g WHERE s NOT IN (SELECT s FROM a)""",
    }
