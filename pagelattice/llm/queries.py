"""Queries of this subpackage's operators over the whole test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.keys import file_key, is_blank, page_key, tag_key
from pagelattice.llm import encode, leakage, nearcopies, neighbours, sentences, setjoin, splitting, survivors
from pagelattice.plans.references import sql_file_key, sql_page_key, sql_tag_key
from pagelattice.session import table


def p1_found(spark, d):
    return survivors.surviving_values(table(spark, d, "merge_members")).select("request_id", "field_name", "slug")


def p1_canonical_pages(spark, d):
    return survivors.canonical_pages(table(spark, d, "merge_members"))


def _pieces(spark, d):
    return splitting.split_sources(table(spark, d, "long_sources"))


def p2_found(spark, d):
    """The blocks of which the splitter made pieces that are parts of a block."""
    return _pieces(spark, d).where("cut_inside").select("source_id", F.col("first_block").alias("block_no")).distinct()


def p2_pieces(spark, d):
    return _pieces(spark, d).select("source_id", "piece_no", "heading_path", "overlap_before", "main")


def p9_found(spark, d):
    return sentences.sentence_units(table(spark, d, "documents")).select("doc_id", "end_pos")


def p9_units_per_language(spark, d):
    docs = table(spark, d, "documents")
    per = sentences.sentence_units(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lang = F.lower(F.trim(F.coalesce("lang", F.lit("")))).alias("lang")
    return docs.select("doc_id", lang).join(per, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_units"))


ORIGINS = ["chunk_vectors", "entity_summaries"]


def _texts(spark, d):
    chunks = table(spark, d, "chunk_vectors").select(F.lit(0).alias("origin"), F.col("vec_id").alias("id"), F.col("chunk_text").alias("text"))
    s = table(spark, d, "entity_summaries").where(~is_blank(F.col("description")))
    return chunks.unionByName(s.select(F.lit(1).alias("origin"), F.col("summary_id").alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "description").alias("text")))


def _origin(c="origin"):
    return F.element_at(F.array(*map(F.lit, ORIGINS)), F.col(c) + 1).alias("origin")


def p5_found(spark, d):
    return nearcopies.expand(*nearcopies.near_copies(_texts(spark, d))).select(_origin(), "id_a", "id_b")


def p5_groups(spark, d):
    """Each record with the group of near-copies that it belongs to."""
    return nearcopies.groups(*nearcopies.near_copies(_texts(spark, d))).select(_origin(), "id", "group_id")


def _sets(spark, d):
    nodes, tags = table(spark, d, "retrieval_nodes"), table(spark, d, "entity_summaries")
    keyed = lambda c, key: F.transform(c, key)
    parts = [
        nodes.select(F.lit("out_links").alias("set_field"), F.col("node_id").alias("id"), keyed("out_links", page_key).alias("values")),
        nodes.select(F.lit("sources").alias("set_field"), F.col("node_id").alias("id"), keyed("sources", file_key).alias("values")),
        tags.select(F.lit("tags").alias("set_field"), F.col("summary_id").alias("id"), keyed("tags", tag_key).alias("values")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("values", F.filter("values", lambda v: v != ""))


def p6_found(spark, d):
    return setjoin.expand(*setjoin.similar_sets(_sets(spark, d))).select(F.col("field").alias("set_field"), "id_a", "id_b")


def p6_classes(spark, d):
    """Each record with its class of equal sets and the class's number of links to different sets."""
    pairs, members = setjoin.similar_sets(_sets(spark, d))
    ends = pairs.select("field", F.explode(F.array("a", "b")).alias("cls")).groupBy("field", "cls").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, ["field", "cls"], "left").select(F.col("field").alias("set_field"), F.col("key").alias("id"), F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def p4_found(spark, d):
    return neighbours.nearest(table(spark, d, "chunk_vectors")).select(F.col("id").alias("vec_id"), F.col("near").alias("near_id"))


def p7_ids(spark, d):
    return encode.encode_corpus(table(spark, d, "documents"))


def p7_roundtrip(spark, d):
    """Documents per layout and how many of them decode to their own bytes again."""
    docs = table(spark, d, "documents")
    raw = encode.decode_ids(encode.encode_corpus(docs.select(F.struct("doc_id", "layout", F.xxhash64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h")).alias("doc_id"), "text")))
    return raw.groupBy("doc_id.layout").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.xxhash64("raw") == F.col("doc_id.h")).cast("bigint")).alias("n_same"))


def p8_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id")


def _leaks(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark, d):
    """Per evaluation item: documents that hold a passage of it, and its longest one in words."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


def p8_clean(spark, d):
    """Per layout: the documents that stay in the corpus."""
    docs = table(spark, d, "documents")
    return leakage.without_leaks(docs, _leaks(spark, d)).groupBy("layout").agg(F.count(F.lit(1)).alias("n_docs"))


_FIELDS, _TEXTS = ["title", "page_type", "description", "created_on"], ["content", "path"]
# fixed values, written out once more so that the SQL does not depend on the operator's list
_STAND_INS = """'n/a', 'na', 'n.a.', 'todo', 'tbd', 'tba', 'tbc', 'null', 'none', 'nil', 'nan', 'unknown', 'undefined', 'unspecified', 'not known',
  'not available', 'not set', 'not specified', 'missing', 'empty', 'placeholder', 'pending', 'to be written', 'to be determined',
  'to be decided', 'to be defined', 'to be confirmed', 'to be added', 'coming soon', 'fixme', 'xxx', '待定', '未知', '暂无', '无', '不明', '未定', 'なし'"""


def _usable(c: str) -> str:
    bare = rf"lower(regexp_replace(regexp_replace({c}, '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g'), '^[(\[<{{]+\s*|\s*[)\]>}}.…:]+$', '', 'g'))"
    return rf"coalesce(regexp_matches({c}, '[\p{{L}}\p{{N}}]') AND {bare} NOT IN ({_STAND_INS}), false)"


# k: members with what the policy looks at; rep: the newest of each cell; w: the records that can fill a field, in the policy's order
_SQL_P1 = rf"""
WITH RECURSIVE c AS (SELECT DISTINCT request_id, member_no, slug, origin, trim(updated_on) s, {", ".join(_FIELDS + _TEXTS)} FROM merge_members WHERE request_id IS NOT NULL),
k AS (SELECT *, CASE lower(trim(origin)) WHEN 'reviewed' THEN 4 WHEN 'ingested' THEN 3 WHEN 'clipped' THEN 2 WHEN 'guessed' THEN 1 ELSE 0 END tr,
  CASE WHEN s IS NULL OR s = '' THEN -1e18
       WHEN regexp_matches(s, '^\d+$') THEN CAST(s AS BIGINT) * 1000.0
       WHEN regexp_matches(s, '^\d{{4}}-\d\d-\d\d$') THEN epoch_us(strptime(s, '%Y-%m-%d'))
       WHEN regexp_matches(s, 'Z$') THEN epoch_us(strptime(s, '%Y-%m-%dT%H:%M:%SZ'))
       WHEN regexp_matches(s, '[+-]\d\d:\d\d$') THEN epoch_us(strptime(s[1:19], '%Y-%m-%dT%H:%M:%S'))
            - (CASE WHEN s[20] = '-' THEN -1 ELSE 1 END) * (CAST(s[21:22] AS BIGINT) * 3600 + CAST(s[24:25] AS BIGINT) * 60) * 1000000.0
       WHEN regexp_matches(s, '/') THEN epoch_us(strptime(s, '%Y/%m/%d %H:%M'))
       ELSE epoch_us(strptime(s, '%d %b %Y')) END ts,
  {" || ".join(f"CASE WHEN {_usable(f)} THEN '1' ELSE '0' END" for f in _FIELDS + _TEXTS)} cell,
  {" + ".join(f"CAST({_usable(f)} AS INT)" for f in _FIELDS)} filled FROM c),
rep AS (SELECT *, row_number() OVER (ORDER BY request_id, tr, cell) rid FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY request_id, tr, cell ORDER BY ts DESC, member_no) = 1)),
w AS (SELECT request_id, rid, slug, field_name, v, row_number() OVER (PARTITION BY request_id, field_name ORDER BY tr DESC, ts DESC, filled DESC, member_no) r
  FROM ({" UNION ALL ".join(f"SELECT request_id, member_no, rid, slug, tr, ts, filled, '{f}' field_name, {f} v FROM rep WHERE {_usable(f)}" for f in _FIELDS + _TEXTS)}))
"""
_SQL_SETS = f"""
WITH raw AS (
  SELECT DISTINCT 'out_links' set_field, node_id id, {sql_page_key('v')} k FROM (SELECT node_id, unnest(out_links) v FROM retrieval_nodes)
  UNION ALL SELECT DISTINCT 'sources', node_id, {sql_file_key('v')} FROM (SELECT node_id, unnest(sources) v FROM retrieval_nodes)
  UNION ALL SELECT DISTINCT 'tags', summary_id, {sql_tag_key('v')} FROM (SELECT summary_id, unnest(tags) v FROM entity_summaries)),
s AS (SELECT * FROM raw WHERE k IS NOT NULL AND k <> ''),
n AS (SELECT set_field, id, count(*) n FROM s GROUP BY ALL HAVING count(*) >= 4),
e AS (SELECT s.*, n.n FROM s JOIN n USING (set_field, id))
"""
_HAN = "々-〇ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ𠀀-𯨟"
_WORDS = rf"regexp_extract_all(regexp_replace(lower(text), '([{_HAN}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


def _grams(key: str, t: str) -> str:
    return (
        f"SELECT DISTINCT {key}, array_to_string(w[i:i+11], ' ') g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) i "
        f"FROM (SELECT {key}, {_WORDS} w FROM {t} WHERE text IS NOT NULL) WHERE len(w) >= 12)"
    )

def _placed(key: str, t: str) -> str:
    return (
        f"SELECT DISTINCT {key}, i, array_to_string(w[i:i+11], ' ') g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) i "
        f"FROM (SELECT {key}, {_WORDS} w FROM {t} WHERE text IS NOT NULL) WHERE len(w) >= 12)"
    )


# lines in turn, folded from a state that knows the open fence, whether a block is open, and each line's block
_MARK = "regexp_extract(x.line, '^[ \\t]*(`{3,}|~{3,})', 1)"
_BEHIND = "regexp_extract(x.line, '^[ \\t]*(?:`{3,}|~{3,})(.*)$', 1)"
_EMPTY = r"regexp_matches(x.line, '^[\s\p{Z}]*$')"
_SHUTS = rf"{_MARK} <> '' AND {_MARK}[1] = s.fence[1] AND length({_MARK}) >= length(s.fence) AND regexp_matches({_BEHIND}, '^[\s\p{{Z}}]*$')"
_OPENS = f"{_MARK} <> '' AND NOT ({_MARK}[1] = '`' AND contains({_BEHIND}, '`'))"
_NUMBER = f"CASE WHEN s.fence <> '' OR {_EMPTY} THEN s.n WHEN {_OPENS} OR NOT s.held THEN s.n + 1 ELSE s.n END"
_SQL_P2 = rf"""
WITH l AS (SELECT source_id, max_chars, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) ls FROM long_sources
  WHERE content IS NOT NULL AND max_chars > 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY length(content) DESC, max_chars) = 1),
f AS (SELECT source_id, max_chars, ls, list_reduce(list_prepend({{'line': '', 'fence': '', 'held': false, 'n': 0, 'nos': []::INT[]}}, list_transform(ls, lambda v: {{'line': v, 'fence': '', 'held': false, 'n': 0, 'nos': []::INT[]}})),
  lambda s, x: {{'line': x.line,
    'fence': CASE WHEN s.fence <> '' THEN CASE WHEN {_SHUTS} THEN '' ELSE s.fence END WHEN {_OPENS} THEN {_MARK} ELSE '' END,
    'held': CASE WHEN s.fence <> '' THEN NOT ({_SHUTS}) ELSE NOT {_EMPTY} END,
    'n': {_NUMBER}, 'nos': list_append(s.nos, CASE WHEN s.fence = '' AND {_EMPTY} THEN 0 ELSE {_NUMBER} END)}}) st FROM l),
b AS (SELECT source_id, max_chars, unnest(st.nos) no, unnest(ls) line, unnest(range(len(ls))) i FROM f)
SELECT source_id, CAST(no AS BIGINT) block_no FROM b WHERE no > 0 GROUP BY source_id, max_chars, no
HAVING length(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) > max_chars
"""


_SQL_RUNS = r"""
WITH t AS (SELECT 'chunk_vectors' origin, vec_id id, chunk_text x FROM chunk_vectors
  UNION ALL SELECT 'entity_summaries', summary_id, coalesce(title, '') || ' ' || description FROM entity_summaries WHERE regexp_matches(description, '[^\p{Z}\s]')),
c AS (SELECT DISTINCT origin, id, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) x FROM t WHERE x IS NOT NULL),
s AS (SELECT DISTINCT origin, id, substr(x, i, 5) g FROM (SELECT origin, id, x, unnest(range(1, length(x) - 3)) i FROM c WHERE length(x) >= 5)),
n AS (SELECT origin, id, count(*) n FROM s GROUP BY ALL),
e AS (SELECT s.*, n.n FROM s JOIN n USING (origin, id))
"""


def queries():
    return {
        "p1_found": p1_found, "p1_canonical_pages": p1_canonical_pages, "p2_found": p2_found, "p2_pieces": p2_pieces, "p4_found": p4_found, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_classes": p6_classes,
        "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p8_found": p8_found, "p8_items": p8_items, "p8_clean": p8_clean,
        "p9_found": p9_found, "p9_units_per_language": p9_units_per_language,
    }


def oracle_sql():
    return {
        "p1_found": _SQL_P1 + f"SELECT request_id, field_name, slug FROM w WHERE r = 1 AND field_name NOT IN ('{_TEXTS[0]}', '{_TEXTS[1]}')",
        "p2_found": _SQL_P2,
        "p4_found": """
            WITH v AS (SELECT vec_id, any_value(CAST(embedding AS DOUBLE[])) e FROM chunk_vectors
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
            s AS (SELECT a.vec_id, b.vec_id near_id, list_cosine_similarity(a.e, b.e) c FROM v a JOIN v b ON a.vec_id <> b.vec_id)
            SELECT vec_id, near_id FROM s WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, near_id) <= 5""",
        "p5_found": _SQL_RUNS + """SELECT a.origin, a.id id_a, b.id id_b FROM e a JOIN e b ON a.origin = b.origin AND a.g = b.g AND a.id < b.id
            GROUP BY a.origin, a.id, b.id, a.n, b.n HAVING 5 * count(*) >= 3 * (a.n + b.n - count(*))""",
        "p6_found": _SQL_SETS + """SELECT a.set_field, a.id id_a, b.id id_b FROM e a JOIN e b ON a.set_field = b.set_field AND a.k = b.k AND a.id < b.id
            GROUP BY a.set_field, a.id, b.id, a.n, b.n HAVING 5 * count(*) >= 3 * (a.n + b.n - count(*))""",
        "p1_canonical_pages": _SQL_P1 + f""", f AS (SELECT request_id, {", ".join(f"max(v) FILTER (WHERE field_name = '{x}') {x}" for x in _FIELDS + _TEXTS)}, max(slug) FILTER (WHERE field_name = 'title') ts FROM w WHERE r = 1 GROUP BY 1),
            dom AS (SELECT a.rid better, b.rid worse FROM rep a JOIN rep b USING (request_id) WHERE a.tr >= b.tr AND a.ts >= b.ts AND a.filled >= b.filled AND (a.tr > b.tr OR a.ts > b.ts OR a.filled > b.filled)),
            ch AS (SELECT rid, 1 AS layer FROM rep UNION SELECT worse, layer + 1 FROM ch JOIN dom ON better = rid),
            lay AS (SELECT request_id, max(layer) deepest FROM (SELECT request_id, field_name, max(layer) layer FROM w JOIN ch USING (rid) WHERE r = 1 GROUP BY 1, 2) GROUP BY 1),
            m AS (SELECT request_id, min(slug) lowest FROM merge_members WHERE request_id IS NOT NULL GROUP BY 1),
            nm AS (SELECT request_id, min(trim(canonical_slug)) named FROM merge_members a WHERE trim(canonical_slug) IN (SELECT slug FROM merge_members b WHERE b.request_id = a.request_id) GROUP BY 1),
            t AS (SELECT request_id, string_agg(k, ',' ORDER BY k) tags FROM (SELECT DISTINCT request_id, {sql_tag_key('v')} k FROM (SELECT request_id, unnest(tags) v FROM merge_members) WHERE v IS NOT NULL) WHERE k <> '' GROUP BY 1)
            SELECT m.request_id, coalesce(named, ts, lowest) canonical_slug, {", ".join(_FIELDS + _TEXTS)}, coalesce(t.tags, '') tags, coalesce(deepest, 0)::BIGINT deepest_layer
            FROM m LEFT JOIN nm USING (request_id) LEFT JOIN f USING (request_id) LEFT JOIN t USING (request_id) LEFT JOIN lay USING (request_id)""",
        "p5_groups": _SQL_RUNS.replace("WITH t", "WITH RECURSIVE t", 1) + """, p AS (SELECT a.origin, a.id x, b.id y FROM e a JOIN e b ON a.origin = b.origin AND a.g = b.g AND a.id <> b.id
              GROUP BY a.origin, a.id, b.id, a.n, b.n HAVING 5 * count(*) >= 3 * (a.n + b.n - count(*))),
            reach AS (SELECT origin, id, id AS root FROM n UNION SELECT p.origin, y, root FROM reach JOIN p ON p.origin = reach.origin AND x = reach.id WHERE root < y)
            SELECT origin, id, min(root) group_id FROM reach GROUP BY 1, 2""",
        "p8_items": f"""WITH d AS ({_placed('doc_id', 'documents')}), q AS ({_placed('item_id', 'eval_items')}), m AS (SELECT doc_id, item_id, d.i, d.i - q.i dg FROM d JOIN q USING (g)),
            r AS (SELECT doc_id, item_id, dg, i - row_number() OVER (PARTITION BY doc_id, item_id, dg ORDER BY i) run FROM m), l AS (SELECT doc_id, item_id, count(*) + 11 n FROM r GROUP BY doc_id, item_id, dg, run)
            SELECT item_id, count(DISTINCT doc_id) n_docs, max(n) longest FROM l GROUP BY 1""",
        "p6_classes": _SQL_SETS + """, c AS (SELECT set_field, id, string_agg(k, chr(1) ORDER BY k) sig FROM e GROUP BY 1, 2), cl AS (SELECT *, min(id) OVER (PARTITION BY set_field, sig) class_id FROM c),
            p AS (SELECT a.set_field, a.id x, b.id y FROM e a JOIN e b ON a.set_field = b.set_field AND a.k = b.k AND a.id <> b.id GROUP BY a.set_field, a.id, b.id, a.n, b.n HAVING 5 * count(*) >= 3 * (a.n + b.n - count(*))),
            l AS (SELECT u.set_field, u.class_id, count(DISTINCT v.class_id) n_links FROM p JOIN cl u ON u.set_field = p.set_field AND u.id = x JOIN cl v ON v.set_field = p.set_field AND v.id = y WHERE u.class_id <> v.class_id GROUP BY 1, 2)
            SELECT cl.set_field, id, cl.class_id, coalesce(n_links, 0) n_links FROM cl LEFT JOIN l ON l.set_field = cl.set_field AND l.class_id = cl.class_id""",
        "p8_clean": f"""WITH d AS ({_grams('doc_id', 'documents')}), q AS ({_grams('item_id', 'eval_items')})
            SELECT layout, count(*) n_docs FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d JOIN q USING (g)) GROUP BY 1""",
        "p7_roundtrip": "SELECT layout, count(*) n_docs, count(*) n_same FROM documents GROUP BY 1",
        "p8_found": f"WITH d AS ({_grams('doc_id', 'documents')}), q AS ({_grams('item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN q USING (g)",
    }
