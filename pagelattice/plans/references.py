"""Queries of the core's reference operators, with the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.operators import references as R
from pagelattice.session import table

_B = r"[\p{Z}\t\n\x0B\f\r\x{85}]"
_Q = "\"''`“”„‘’‚«»‹›"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g')"


def sql_page_key(c: str) -> str:
    c = f"regexp_replace({_strip(c)}, '^!?\\[+|\\]+$', '', 'g')"
    c = f"regexp_replace({c}, '(?s)[|#].*$', '')"
    c = f"regexp_replace({_strip(c)}, '(?s)^.*[/\\\\]', '')"
    c = f"regexp_replace({c}, '(?i)\\.md$', '')"
    return f"regexp_replace(lower({_strip(c)}), '[\\p{{Z}}\\t\\n\\x0B\\f\\r\\x{{85}}_-]+', '-', 'g')"


def sql_file_key(c: str) -> str:
    e = f"(?:{_B}|[{_Q}])+"
    c = f"regexp_replace({c}, '^{e}|{e}$', '', 'g')"
    c = f"regexp_replace({c}, '(?s)^.*[/\\\\]', '')"
    return f"lower(regexp_replace({c}, '^{e}|{e}$', '', 'g'))"


def sql_tag_key(c: str) -> str:
    c = f"regexp_replace({_strip(c)}, '^#+', '')"
    return f"regexp_replace(lower({_strip(c)}), '[\\p{{Z}}\\t\\n\\x0B\\f\\r\\x{{85}}_-]+', '-', 'g')"


SQL_ORPHANS = f"""
refs AS (
  SELECT DISTINCT 'out_links' ref_field, node_id ref_id, updated_at t, v target, {sql_page_key('v')} k, 'p' kind
  FROM (SELECT node_id, updated_at, unnest(out_links) v FROM retrieval_nodes) WHERE v IS NOT NULL AND {_strip('v')} <> ''
  UNION ALL
  SELECT DISTINCT 'sources', node_id, updated_at, v, {sql_file_key('v')}, 'f'
  FROM (SELECT node_id, updated_at, unnest(sources) v FROM retrieval_nodes) WHERE v IS NOT NULL AND {_strip('v')} <> ''
  UNION ALL
  SELECT DISTINCT 'affected_pages', lint_id, detected_at, v, {sql_page_key('v')}, 'p'
  FROM (SELECT lint_id, detected_at, unnest(affected_pages) v FROM lint_results) WHERE v IS NOT NULL AND {_strip('v')} <> ''),
parents AS (
  SELECT 'p' kind, {sql_page_key('page_id')} k, created_at s, deleted_at e FROM retrieval_nodes
  UNION ALL SELECT 'p', {sql_page_key('page_id')}, created_at, NULL FROM structural_pages
  UNION ALL SELECT 'f', {sql_file_key('source_key')}, arrived_at, deleted_at FROM source_files),
orphans AS (
  SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.kind = r.kind AND p.k = r.k AND p.s <= r.t AND (p.e IS NULL OR p.e > r.t)))
"""


def _wiki(spark, d):
    return [table(spark, d, t) for t in ("retrieval_nodes", "lint_results", "structural_pages", "source_files")]


def p3_found(spark, d):
    return R.wiki_orphans(*_wiki(spark, d)).select("ref_field", "ref_id", "target").distinct()


def p3_report(spark, d):
    return R.wiki_orphan_report(*_wiki(spark, d))


def p3_integer_runs(spark, d):
    """Line items per block of order keys whose order isn't among the finished ones, by integer runs."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    li = table(spark, d, "lineitem")
    lost = R.orphan_keys(li, "l_orderkey", done, "o_orderkey")
    return lost.groupBy(F.floor(F.col("key") / F.lit(10000)).cast("bigint").alias("key_block")).agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows")
    )


def queries():
    return {"p3_found": p3_found, "p3_report": p3_report, "p3_integer_runs": p3_integer_runs}


def oracle_sql():
    return {
        "p3_found": f"WITH {SQL_ORPHANS} SELECT DISTINCT ref_field, ref_id, target FROM orphans",
        "p3_report": f"""WITH {SQL_ORPHANS}
            SELECT CASE WHEN ref_field = 'affected_pages' THEN 'lint_results' ELSE 'retrieval_nodes' END table_name, ref_field,
                   strftime(t, '%Y-%m') AS month, count(*) n_orphans, count(DISTINCT ref_id) n_records
            FROM orphans GROUP BY ALL""",
        "p3_integer_runs": """SELECT CAST(floor(l_orderkey / 10000) AS BIGINT) key_block, count(DISTINCT l_orderkey) n_keys, count(*) n_rows
            FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
    }
