"""Queries of the graph and lint operators over the retrieval nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions import markdown as M
from pagelattice.operators import graph as G
from pagelattice.operators import lint as L
from pagelattice.plans.references import sql_page_key
from pagelattice.session import shared_checkpoint, shared_table, table


def _nodes(spark, d):
    """The latest record of each page: ``id, label, type, path, sources, links``."""
    return _latest(table(spark, d, "retrieval_nodes"))


def _latest(records):
    last = F.max(F.struct("updated_at", "node_id", "ingested_at", "title", "node_type", "path", "sources", "out_links")).alias("r")
    n = records.groupBy(F.col("page_id").alias("id")).agg(last)
    type_ = F.coalesce(F.nullif(F.lower(F.trim("r.node_type")), F.lit("")), F.lit("other"))
    return n.select("id", F.coalesce(F.nullif(F.trim("r.title"), F.lit("")), "id").alias("label"), type_.alias("type"), "r.path", "r.sources", F.col("r.out_links").alias("links"))


def numbered_nodes(records):
    """As ``_nodes``, as a table, with the page's name as ``name`` and as ``id`` a number in the order of the names, so that no later join carries names. Without pages that have none: nothing links to them or from them."""
    n = _latest(records.where("page_id IS NOT NULL").repartitionByRange("page_id")).withColumnRenamed("id", "name").drop("path")
    return shared_table(n.sortWithinPartitions("name").withColumn("id", F.monotonically_increasing_id()))


def _links(nodes):
    return nodes.select(F.col("id").alias("src"), F.explode("links").alias("target"))


def _edges(nodes):
    return shared_checkpoint(G.resolve_links(_links(nodes), nodes))


def _graph(spark, d):
    nodes = _nodes(spark, d)
    edges = _edges(nodes)
    pairs = G.undirected(edges)
    communities = nodes.select("id", F.substring("id", 1, 1).alias("community"))
    return nodes, edges, pairs, G.link_counts(pairs, every=True), communities


def link_resolution(spark, d):
    return _edges(_nodes(spark, d))


def page_degrees(spark, d):
    return G.degrees(_edges(_nodes(spark, d)))


def linked_pairs(spark, d):
    return G.undirected(_edges(_nodes(spark, d)))


def link_counts_all(spark, d):
    return G.link_counts(G.undirected(_edges(_nodes(spark, d))), every=True)


def link_counts_once(spark, d):
    return G.link_counts(G.undirected(_edges(_nodes(spark, d))), every=False)


def pair_relevance(spark, d):
    nodes = _nodes(spark, d)
    r = G.relevance(_edges(nodes), nodes)
    return r.select("a", "b", "ways", F.col("shared").cast("bigint").alias("shared"), F.round("aa", 6).alias("aa"), F.round("weight", 6).alias("weight"))


def related_pages(spark, d):
    nodes = _nodes(spark, d)
    seeds = nodes.select(F.col("id").alias("seed"))
    return G.related_pages(_edges(nodes), nodes, seeds, 3, 2.0).select("seed", "id", F.round("relevance", 6).alias("relevance"), "turn")


def communities(spark, d):
    """Communities by modularity: number, size and cohesion of each."""
    nodes = _nodes(spark, d)
    edges = _edges(nodes)
    w = shared_checkpoint(G.relevance(edges, nodes).select("a", "b", "weight"))
    c = G.louvain(w)
    return G.community_stats(w, c, nodes, G.link_counts(w.withColumn("times", F.lit(1)), every=False)).select("community", "n_nodes", F.round("cohesion", 6).alias("cohesion"), "top_nodes")


def initial_cohesion(spark, d):
    """Cohesion with a page's first letter as its community, which SQL can repeat."""
    nodes, _, pairs, counts, c = _graph(spark, d)
    return G.community_stats(pairs, c, nodes, counts).select("community", "n_nodes", F.round("cohesion", 6).alias("cohesion"), "top_nodes")


def _found(spark, d):
    """The graph as in ``_graph``, weighted, with the communities that ``louvain`` finds; a page without links has none. Pages are numbers."""
    nodes = numbered_nodes(table(spark, d, "retrieval_nodes"))
    return found_graph(nodes, G.resolve_links(_links(nodes), nodes.select(F.col("name").alias("id"), F.col("id").alias("n")), "n", summed=False))


def found_graph(nodes, edges):
    pairs = shared_table(G.undirected(edges))
    count = G.end_counts(pairs)
    weighted = shared_table(G.relevance(edges, nodes, pairs, count).select("a", "b", "weight"))
    return nodes, weighted, pairs, count.select("id", "link_count"), shared_table(G.louvain(weighted))


def louvain_surprising_links(spark, d):
    """Surprising links between the communities found; SQL can't repeat these."""
    nodes, weighted, _, counts, c = _found(spark, d)
    return G.surprising(weighted, nodes, c, counts)


def louvain_knowledge_gaps(spark, d):
    """Gaps of the communities found; SQL can't repeat these."""
    nodes, _, pairs, counts, c = _found(spark, d)
    return G.knowledge_gaps(pairs, nodes, c, counts)


def louvain_gap_report(spark, d):
    """The report of the gaps: isolated pages as one row, sparse communities, the foremost bridges, eight rows at most."""
    nodes, _, pairs, counts, c = _found(spark, d)
    stats = shared_table(G.community_stats(pairs, c, nodes, counts))
    return G.gap_report(shared_table(G.knowledge_gaps(pairs, nodes, c, counts, stats)), nodes, stats)


def gap_report(spark, d):
    """A check of the report against SQL, with a page's first letter as its community."""
    nodes, _, pairs, counts, c = _graph(spark, d)
    return G.gap_report(G.knowledge_gaps(pairs, nodes, c, counts), nodes, G.community_stats(pairs, c, nodes, counts))


def surprising_links(spark, d):
    """A check of the rules alone against SQL, with a page's first letter as its community; see louvain_surprising_links for the real chain."""
    nodes, edges, _, counts, c = _graph(spark, d)
    return G.surprising(G.relevance(edges, nodes), nodes, c, counts)


def knowledge_gaps(spark, d):
    """A check of the rules alone against SQL, with a page's first letter as its community; see louvain_knowledge_gaps for the real chain."""
    nodes, _, pairs, counts, c = _graph(spark, d)
    return G.knowledge_gaps(pairs, nodes, c, counts)


def graph_filters(spark, d):
    nodes, _, _, counts, _ = _graph(spark, d)
    v = G.visible(nodes.join(counts, "id", "left"), hidden_types=["query"], most=50)
    return v.groupBy(F.coalesce("hidden", F.lit("shown")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def graph_induced(spark, d):
    nodes, _, pairs, counts, _ = _graph(spark, d)
    v = G.visible(nodes.join(counts, "id", "left"), hidden_types=["query"], most=50).where("hidden IS NULL")
    return G.induced(pairs, v).select("a", "b")


def graph_text_search(spark, d):
    nodes, _, pairs, _, _ = _graph(spark, d)
    return G.induced(pairs, G.graph_search(nodes, "wiki concept")).select("a", "b")


def graph_api(spark, d):
    """Nodes and edges as the interface gives them: entities with an a in their id or label, and the links among them."""
    nodes, _, pairs, _, _ = _graph(spark, d)
    n, edges = G.api_graph(nodes, pairs, q="a", node_type="entity")
    none = F.lit(None).cast("string")
    return n.select(F.lit("node").alias("part"), "id", "label", "type", none.alias("target")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("a").alias("id"), none.alias("label"), none.alias("type"), F.col("b").alias("target")))


def image_sources(spark, d):
    """Raw sources of images: every file's summary folder and its bare stem as images' folders, and an unknown one."""
    files = table(spark, d, "source_files").select(F.concat(F.lit("raw/sources/"), "source_key").alias("path")).distinct()
    stem = F.regexp_replace(M.file_stem(F.col("path")), "[?#]", "")
    urls = files.select(F.concat(F.lit("media/"), stem, F.lit("/img-1.png")).alias("url")).unionByName(files.select(F.concat(F.lit("C:\\wiki\\media\\"), stem, F.lit("\\img-2.png")).alias("url")))
    odd = spark.createDataFrame([("media/no-such-source/img-1.png",), ("pictures/a.png",), (None,)], "url string")
    return G.raw_sources(urls.unionByName(odd), files).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"))


def lint_findings(spark, d):
    n = _nodes(spark, d)
    pages = n.select("id").unionByName(table(spark, d, "structural_pages").select(F.col("page_id").alias("id"))).distinct()
    return L.structural_findings(pages, _links(n))


def missing_pages(spark, d):
    n = _nodes(spark, d)
    pages = n.select("id").unionByName(table(spark, d, "structural_pages").select(F.col("page_id").alias("id")))
    return L.missing_targets(_links(n), pages)


def type_counts(spark, d):
    return _nodes(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first_label"))


_N = """n AS (SELECT page_id id, coalesce(nullif(trim(title), ''), page_id) AS label, coalesce(nullif(lower(trim(node_type)), ''), 'other') AS type, path, sources, out_links links FROM retrieval_nodes
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY updated_at DESC, node_id DESC, ingested_at DESC) = 1),
 l AS (SELECT id src, trim(target) target FROM (SELECT id, unnest(links) target FROM n) WHERE target IS NOT NULL AND trim(target) <> '')"""
_K = sql_page_key
_E = f"""{_N},
 t AS (SELECT DISTINCT target FROM l),
 r AS (SELECT target, id FROM (
   SELECT target, 1 p, id FROM t JOIN n ON id = target UNION ALL SELECT target, 2, id FROM t JOIN n ON lower(id) = regexp_replace(lower(target), '\\s+', '-', 'g')
   UNION ALL SELECT target, 3, id FROM t JOIN n ON lower(id) = lower(target) UNION ALL SELECT target, 4, id FROM t JOIN n ON {_K('id')} = {_K('target')})
   QUALIFY row_number() OVER (PARTITION BY target ORDER BY p, id) = 1),
 e AS (SELECT src, id dst, count(*) times FROM l JOIN r USING (target) WHERE src <> id GROUP BY 1, 2),
 p AS (SELECT least(src, dst) a, greatest(src, dst) b, CAST(sum(times) AS BIGINT) times, count(*) ways FROM e GROUP BY 1, 2),
 d AS (SELECT id, CAST(sum(o) AS BIGINT) n_out, CAST(sum(i) AS BIGINT) n_in, count(*) degree FROM (SELECT src id, 1 o, 0 i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1),
 lc AS (SELECT id, CAST(sum(times) AS BIGINT) link_count FROM (SELECT a id, times FROM p UNION ALL SELECT b, times FROM p) GROUP BY 1)"""
# fixed values, written out so that the SQL does not depend on the engine's tables
_AFF = """coalesce((SELECT v FROM (VALUES
   ('entity', 'entity', 0.8::DOUBLE), ('entity', 'concept', 1.2), ('entity', 'source', 1.0), ('entity', 'query', 0.8), ('entity', 'synthesis', 1.0),
   ('concept', 'entity', 1.2), ('concept', 'concept', 0.8), ('concept', 'source', 1.0), ('concept', 'query', 1.0), ('concept', 'synthesis', 1.2),
   ('source', 'entity', 1.0), ('source', 'concept', 1.0), ('source', 'source', 0.5), ('source', 'query', 0.8), ('source', 'synthesis', 1.0),
   ('query', 'entity', 0.8), ('query', 'concept', 1.0), ('query', 'source', 0.8), ('query', 'query', 0.5), ('query', 'synthesis', 1.0),
   ('synthesis', 'entity', 1.0), ('synthesis', 'concept', 1.2), ('synthesis', 'source', 1.0), ('synthesis', 'query', 1.0), ('synthesis', 'synthesis', 0.8)) f(s, t, v)
   WHERE f.s = x.type AND f.t = y.type), 0.5::DOUBLE)"""
_W = f"""{_E},
 u AS (SELECT a x, b y FROM p UNION ALL SELECT b, a FROM p),
 aa AS (SELECT p.a, p.b, sum(1 / ln(greatest(d.degree, 2))) aa FROM p JOIN u u1 ON u1.x = p.a JOIN u u2 ON u2.x = p.b AND u2.y = u1.y JOIN d ON d.id = u1.y GROUP BY 1, 2),
 w AS (SELECT p.a, p.b, ways, CAST(len(list_intersect(list_filter(coalesce(x.sources, []), lambda s: s IS NOT NULL AND s <> ''), coalesce(y.sources, []))) AS BIGINT) shared, coalesce(aa.aa, 0) aa,
   ways * 3.0 + shared * 4.0 + coalesce(aa.aa, 0) * 1.5 + {_AFF} weight, x.type ta, y.type tb
   FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b LEFT JOIN aa ON aa.a = p.a AND aa.b = p.b)"""
_COH = """c AS (SELECT id, substr(id, 1, 1) community FROM n),
 coh AS (SELECT community, count(*) n_nodes FROM c GROUP BY 1),
 inn AS (SELECT substr(a, 1, 1) community, count(*) k FROM p WHERE substr(a, 1, 1) = substr(b, 1, 1) GROUP BY 1),
 st AS (SELECT community, n_nodes, coalesce(k, 0) / greatest(n_nodes * (n_nodes - 1) / 2.0, 1.0) cohesion FROM coh LEFT JOIN inn USING (community))"""
_HID = """CASE WHEN type = 'query' THEN 'type' WHEN lower(id) IN ('index', 'overview', 'log', 'schema', 'purpose') OR regexp_matches(path, '(?i)(?:^|/)(?:index|overview|log|schema|purpose)\\.md$') THEN 'structural'
   WHEN coalesce(link_count, 0) <= 0 THEN 'isolated' WHEN link_count > 50 THEN 'links' ELSE 'shown' END"""


def queries():
    fs = (link_resolution, page_degrees, linked_pairs, link_counts_all, link_counts_once, pair_relevance, related_pages, communities, initial_cohesion, surprising_links, knowledge_gaps, louvain_surprising_links, louvain_knowledge_gaps, louvain_gap_report, gap_report, image_sources,
          graph_filters, graph_induced, graph_text_search, graph_api, lint_findings, missing_pages, type_counts)
    return {f.__name__: f for f in fs}


def oracle_sql():
    far = "(ta, tb) IN (('source', 'concept'), ('concept', 'source'), ('source', 'synthesis'), ('synthesis', 'source'), ('query', 'entity'), ('entity', 'query'))"
    pages = "pages AS (SELECT id FROM n UNION SELECT page_id FROM structural_pages)"
    return {
        "link_resolution": f"WITH {_E} SELECT * FROM e",
        "page_degrees": f"WITH {_E} SELECT * FROM d",
        "linked_pairs": f"WITH {_E} SELECT * FROM p",
        "link_counts_all": f"WITH {_E} SELECT * FROM lc",
        "link_counts_once": f"WITH {_E} SELECT id, count(*) link_count FROM (SELECT a id FROM p UNION ALL SELECT b FROM p) GROUP BY 1",
        "pair_relevance": f"WITH {_W} SELECT a, b, ways, shared, round(aa, 6) aa, round(weight, 6) weight FROM w",
        "related_pages": f"""WITH {_E}, u AS (SELECT a x, b y, ways FROM p UNION ALL SELECT b, a, ways FROM p),
            aa AS (SELECT u1.x a, u2.x b, sum(1 / ln(greatest(d.degree, 2))) aa FROM u u1 JOIN u u2 ON u1.y = u2.y AND u1.x <> u2.x JOIN d ON d.id = u1.y GROUP BY 1, 2),
            s AS (SELECT x.id seed, y.id id, round(coalesce(u.ways, 0) * 3.0 + len(list_intersect(list_filter(coalesce(x.sources, []), lambda s: s IS NOT NULL AND s <> ''), coalesce(y.sources, []))) * 4.0
              + coalesce(aa.aa, 0) * 1.5 + {_AFF}, 9) rel FROM n x JOIN n y ON x.id <> y.id LEFT JOIN u ON u.x = x.id AND u.y = y.id LEFT JOIN aa ON aa.a = x.id AND aa.b = y.id)
            SELECT seed, id, round(rel, 6) relevance, row_number() OVER (PARTITION BY seed ORDER BY rel DESC, id) turn FROM s WHERE rel >= 2 QUALIFY turn <= 3""",
        "initial_cohesion": f"""WITH {_E}, {_COH}, top AS (SELECT c.community, n.label, row_number() OVER (PARTITION BY c.community ORDER BY coalesce(link_count, 0) DESC, id) r FROM c JOIN n USING (id) LEFT JOIN lc USING (id) QUALIFY r <= 5)
            SELECT community, n_nodes, round(cohesion, 6) cohesion, (SELECT string_agg(top.label, '|' ORDER BY r) FROM top WHERE top.community = st.community) top_nodes FROM st""",
        "surprising_links": f"""WITH {_W}, j AS (SELECT w.*, la.link_count na, lb.link_count nb, (SELECT max(link_count) FROM lc) most FROM w JOIN lc la ON la.id = a JOIN lc lb ON lb.id = b
              WHERE lower(a) NOT IN ('index', 'overview', 'log') AND lower(b) NOT IN ('index', 'overview', 'log')),
            f AS (SELECT a, b, substr(a, 1, 1) <> substr(b, 1, 1) x1, ({far}) x2, ta <> tb AND NOT ({far}) x3, least(na, nb) <= 2 AND greatest(na, nb) >= 0.5 * most x4, weight > 0 AND weight < 2 x5 FROM j),
            s AS (SELECT a, b, CAST(x1::INT * 3 + x2::INT * 2 + x3::INT + x4::INT * 2 + x5::INT AS BIGINT) score, concat_ws('|', CASE WHEN x1 THEN 'communities' END, CASE WHEN x2 THEN 'distant types' END,
              CASE WHEN x3 THEN 'types' END, CASE WHEN x4 THEN 'edge and hub' END, CASE WHEN x5 THEN 'weak' END) reasons FROM f)
            SELECT *, row_number() OVER (ORDER BY score DESC, a, b) turn FROM s WHERE score >= 3 QUALIFY turn <= 5""",
        "knowledge_gaps": f"""WITH {_E}, {_COH}, o AS (SELECT a id, substr(b, 1, 1) c FROM p UNION SELECT b, substr(a, 1, 1) FROM p)
            SELECT 'isolated' kind, id AS key, coalesce(link_count, 0) n FROM n LEFT JOIN lc USING (id) WHERE coalesce(link_count, 0) <= 1 AND lower(id) NOT IN ('index', 'overview', 'log')
            UNION ALL SELECT 'sparse', community, n_nodes FROM st WHERE cohesion < 0.15 AND n_nodes >= 3
            UNION ALL SELECT 'bridge', id, count(*) FROM o GROUP BY id HAVING count(*) >= 3""",
        "graph_filters": f"WITH {_E} SELECT {_HID} AS state, count(*) n FROM n LEFT JOIN lc USING (id) GROUP BY 1",
        "graph_induced": f"WITH {_E}, v AS (SELECT id FROM n LEFT JOIN lc USING (id) WHERE {_HID} = 'shown') SELECT a, b FROM p WHERE a IN (SELECT id FROM v) AND b IN (SELECT id FROM v)",
        "graph_text_search": f"""WITH {_E}, v AS (SELECT id FROM n WHERE contains(lower(label || ' ' || id || ' ' || type || ' ' || path), 'wiki') AND contains(lower(label || ' ' || id || ' ' || type || ' ' || path), 'concept'))
            SELECT a, b FROM p WHERE a IN (SELECT id FROM v) AND b IN (SELECT id FROM v)""",
        "graph_api": f"""WITH {_E}, v AS (SELECT id, label, type FROM n WHERE type = 'entity' AND (contains(lower(id), 'a') OR contains(lower(label), 'a')) ORDER BY id LIMIT 200)
            SELECT 'node' AS part, id, label, type, NULL AS target FROM v UNION ALL SELECT 'edge', a, NULL, NULL, b FROM p WHERE a IN (SELECT id FROM v) AND b IN (SELECT id FROM v)""",
        "gap_report": f"""WITH {_E}, {_COH}, o AS (SELECT a id, substr(b, 1, 1) c FROM p UNION SELECT b, substr(a, 1, 1) FROM p),
            iso AS (SELECT id, label FROM n LEFT JOIN lc USING (id) WHERE coalesce(link_count, 0) <= 1 AND lower(id) NOT IN ('index', 'overview', 'log')),
            top AS (SELECT c.community, n.label, row_number() OVER (PARTITION BY c.community ORDER BY coalesce(link_count, 0) DESC, id) r FROM c JOIN n USING (id) LEFT JOIN lc USING (id) QUALIFY r <= 5),
            g AS (SELECT 0 part, 0::BIGINT a, '' b, 'isolated' kind, count(*) || ' isolated pages' title, count(*) n, (SELECT string_agg(label, ', ' ORDER BY id) FROM (SELECT * FROM iso ORDER BY id LIMIT 5)) AS names FROM iso HAVING count(*) > 0
              UNION ALL SELECT 1, try_cast(st.community AS BIGINT), st.community, 'sparse', (SELECT top.label FROM top WHERE top.community = st.community AND r = 1), n_nodes, (SELECT string_agg(top.label, ', ' ORDER BY r) FROM top WHERE top.community = st.community)
                FROM st WHERE cohesion < 0.15 AND n_nodes >= 3
              UNION ALL SELECT * FROM (SELECT 2, -count(*), id, 'bridge', any_value(label), count(*), id FROM o JOIN n USING (id) WHERE lower(id) NOT IN ('index', 'log', 'overview') GROUP BY id HAVING count(*) >= 3 ORDER BY count(*) DESC, id LIMIT 3))
            SELECT row_number() OVER (ORDER BY part, a NULLS FIRST, b) turn, kind, title, n, names FROM g QUALIFY turn <= 8""",
        "image_sources": r"""WITH f AS (SELECT DISTINCT 'raw/sources/' || source_key path FROM source_files),
            k AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(path, '^.*[/\\]', ''), '(.)\.[^.]*$', '\1'), '[?#]', '', 'g') s FROM f),
            u AS (SELECT 'media/' || s || '/img-1.png' url, s FROM k UNION ALL SELECT 'C:\wiki\media\' || s || '\img-2.png', s FROM k),
            lo AS (SELECT s, min(path) path FROM k GROUP BY 1)
            SELECT path, count(*) n, min(url) first_url FROM u LEFT JOIN lo USING (s) GROUP BY 1
            UNION ALL SELECT NULL, 3, 'media/no-such-source/img-1.png'""",
        "lint_findings": f"""WITH {_N}, {pages}, k AS (SELECT src, target, {_K('target')} k, {_K('src')} sk FROM l WHERE {_K('src')} NOT IN ('index', 'log')), pk AS (SELECT id, {_K('id')} k FROM pages)
            SELECT 'orphan' kind, id page, NULL target, 1 n FROM pk WHERE k NOT IN ('index', 'log') AND k NOT IN (SELECT k FROM k WHERE k <> sk)
            UNION ALL SELECT 'broken-link', src, target, count(*) FROM k WHERE k NOT IN (SELECT k FROM pk) GROUP BY src, target
            UNION ALL SELECT 'no-outlinks', id, NULL, 1 FROM pk WHERE k NOT IN ('index', 'log') AND id NOT IN (SELECT src FROM l)""",
        "missing_pages": f"WITH {_N}, {pages} SELECT {_K('target')} AS key, count(*) n_links, count(DISTINCT src) n_pages FROM l WHERE {_K('target')} NOT IN (SELECT {_K('id')} FROM pages) GROUP BY 1",
        "type_counts": f"WITH {_N} SELECT type, count(*) n, min(label) first_label FROM n GROUP BY 1",
    }
