"""Queries of the page, text and language functions over the whole documents and file tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions import blocks, language, text
from pagelattice.functions import markdown as M
from pagelattice.session import table

_FM = r"(?s)\A(?:[^\n]*\n){0,5}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
_BLOCK = f"CASE WHEN regexp_matches(text, '{_FM}') THEN regexp_extract(text, '{_FM}', 1) END"
_BODY = f"regexp_replace(text, '{_FM}', '')"


def _sql_scalar(f: str, b: str = "b") -> str:
    v = rf"regexp_replace(trim(regexp_extract({b}, '(?m)^{f}:[ \t]*([^\r\n\[]*?)[ \t]*\r?$', 1)), '^\"(.*)\"$', '\1')"
    return f"nullif({v}, '')"


def frontmatter_fields(spark, d):
    b = M.frontmatter_block(F.col("text"))
    return table(spark, d, "documents").select("doc_id", b.alias("b"), F.length(M.body(F.col("text"))).cast("bigint").alias("body_chars")).select(
        "doc_id", *[M.scalar_field(F.col("b"), f).alias(f"fm_{f}") for f in ("type", "title", "updated")], F.array_join(M.array_field(F.col("b"), "tags"), "|").alias("tags"), "body_chars"
    )


def frontmatter_map(spark, d):
    b = M.frontmatter_block(F.col("text"))
    e = table(spark, d, "documents").where(b.isNotNull()).select("doc_id", F.explode(M.fields_map(b)).alias("field", "value"))
    return e.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("value").alias("n_values"))


def page_titles(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", M.title(t, F.col("source")).alias("title"), M.page_type(t).alias("page_type"))


def wikilinks(spark, d):
    t = F.col("text")
    z = F.arrays_zip(M.wikilinks(t).alias("target"), M.wikilink_labels(t).alias("label"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(z).alias("pos", "x")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "x.target", "x.label")


def wikilinks_as_markdown(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(M.links_as_markdown(F.col("text"))).alias("md5"))


def paths_and_categories(spark, d):
    k = F.col("source_key")
    rules = text.matches_glob(text.slashes(k), ["*.csv", "raw/sources/survey/*"])
    return table(spark, d, "source_files").select("source_key").distinct().select(
        "source_key", text.source_identity(k).alias("identity"), text.file_name(k).alias("file_name"), M.file_stem(k).alias("stem"), text.file_category(k).alias("category"),
        text.folder_context(k).alias("folders"), rules.alias("matched"), M.ref_key(k).alias("ref_key"),
    )


def title_slugs(spark, d):
    t = F.col("title")
    e = table(spark, d, "entity_summaries").where("title IS NOT NULL").select("title").distinct()
    return e.select("title", text.query_slug(t).alias("slug"), text.normalise_review_title(t).alias("review_key"), M.type_of_path(F.concat(F.lit("wiki/entities/"), t)).alias("type"))


def query_tokens(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.array_join(text.token_array(F.col("text")), " ").alias("tokens"), text.phrase(F.col("text")).alias("phrase"))


def languages(spark, d):
    return table(spark, d, "documents").select("doc_id", language.detect_language(F.col("text")).alias("language"))


def script_shares(spark, d):
    n = language.script_counts(F.col("text"))
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy("layout").agg(*[F.sum(n[s]).cast("bigint").alias(s.lower()) for s in ("Chinese", "Japanese", "Thai", "Hindi", "Arabic", "Russian")])


def language_guard(spark, d):
    """Per stated language: texts that the guard would let pass as English."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    ok = language.matches_language(F.col("text"), F.lit("English"))
    return docs.groupBy(F.lower(F.coalesce("lang", F.lit(""))).alias("lang")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(ok.cast("bigint")).alias("n_pass"))


def page_summaries(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.entity_summary(F.col("text")).alias("summary")).where("summary IS NOT NULL")


def generated_blocks(spark, d):
    """Every document wrapped into a model's answer of two file blocks, one of them unsafe, parsed again."""
    answer = F.concat(F.lit("preface\n---FILE: wiki/notes/"), F.col("doc_id").cast("string"), F.lit(".md---\n"), F.regexp_replace(F.col("text"), "\r\n", "\n"),
                      F.lit("\n---END FILE---\n---FILE: ../escape.md---\nx\n--- end file ---\n---FILE: wiki/open.md---\nunclosed"))
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    b = docs.select("doc_id", "text", F.explode(blocks.parse_file_blocks(answer)).alias("b"))
    same = F.col("b.content") == F.regexp_replace(F.col("text"), "\r\n", "\n")
    return b.groupBy(F.coalesce("b.problem", F.lit("")).alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(same, F.lit(False)).cast("bigint")).alias("n_same"))


def repaired_pages(spark, d):
    """Every page wrapped in a fence and a stray key, repaired: the number per layout that comes out as it was."""
    t = F.regexp_replace(F.col("text"), "\r\n", "\n")
    bad = F.concat(F.lit("```markdown\nfrontmatter:\n"), t, F.lit("\n```\n"))
    docs = table(spark, d, "documents").where(F.col("text").startswith("---"))
    return docs.groupBy("layout").agg(F.count(F.lit(1)).alias("n"), F.sum((blocks.sanitize(bad) == t).cast("bigint")).alias("n_same"))


def snippets(spark, d):
    docs = table(spark, d, "documents").where(F.lower("text").contains("letters"))
    return docs.select("doc_id", text.snippet(F.col("text"), F.lit("letters")).alias("snippet"))


def content_hashes(spark, d):
    """Texts that occur more than once, by SHA-256, with their lowest document."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.sha2(F.col("text"), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def _sql_language() -> str:
    low = "lower(text)"
    out = "'English'"
    for name, marks, ws, mode in reversed(language.LATIN):
        t = [f"regexp_matches({low}, '[{marks}]')"] if marks else []
        if ws:
            t.append(f"regexp_matches({low}, '{language.word_pattern(ws, edge=True)}')")
        out = f"CASE WHEN {(' AND ' if mode == 'both' else ' OR ').join(t)} THEN '{name}' ELSE {out} END"
    n = {s: f"(length(text) - length(regexp_replace(text, '{language.script_class(s)}', '', 'g')))" for s in language.SCRIPTS}
    script = "NULL"
    for s in reversed(language.SCRIPTS):
        script = f"CASE WHEN n_{s.lower()} = most THEN '{s}' ELSE {script} END"
    count = lambda m: f"(length(text) - length(regexp_replace(text, '[{m}]', '', 'g')))"
    spaced = r"(' ' || regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g') || ' ')"
    holds = lambda ws: " + ".join(f"CASE WHEN contains({spaced}, ' {w} ') THEN 2 ELSE 0 END" for w in ws)
    p = " + ".join(f"{count(m)} * {k}" for m, k in language.PERSIAN) + " + " + holds(language.PERSIAN_WORDS)
    a = " + ".join(f"{count(m)} * {k}" for m, k in language.ARABIC) + " + " + holds(language.ARABIC_WORDS)
    cols = ", ".join(f"{v} n_{s.lower()}" for s, v in n.items())
    return f"""WITH c AS (SELECT doc_id, text, {cols} FROM documents WHERE text IS NOT NULL),
        m AS (SELECT *, greatest({", ".join(f"n_{s.lower()}" for s in n)}) most FROM c),
        s AS (SELECT *, {script} script, {out} latin FROM m)
        SELECT doc_id, CASE WHEN n_japanese > 0 AND n_chinese > 0 THEN 'Japanese' WHEN most < 2 THEN latin
          WHEN script = 'Arabic' THEN CASE WHEN {p} >= 3 AND {p} > {a} THEN 'Persian' ELSE 'Arabic' END ELSE script END AS language FROM s
        UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"""


def queries():
    return {f.__name__: f for f in (frontmatter_fields, frontmatter_map, page_titles, wikilinks, wikilinks_as_markdown, paths_and_categories, title_slugs, query_tokens, languages,
            script_shares, language_guard, page_summaries, generated_blocks, repaired_pages, snippets, content_hashes)}


def oracle_sql():
    link = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
    n = lambda s: f"CAST(sum(length(text) - length(regexp_replace(text, '{language.script_class(s)}', '', 'g'))) AS BIGINT) {s.lower()}"
    # fixed values, written out so that the SQL does not depend on the engine's tables
    stop = """'的', '是', '了', '什么', '在', '有', '和', '与', '对', '从', 'the', 'is', 'a', 'an', 'what', 'how', 'are', 'was', 'were', 'do', 'does', 'did', 'be', 'been',
        'being', 'have', 'has', 'had', 'it', 'its', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'this', 'that', 'these', 'those'"""
    cut = text._CUT.replace("'", "''")
    cats = """WHEN ext IN ('md', 'mdx') THEN 'markdown' WHEN ext IN ('txt', 'rtf', 'log') THEN 'text' WHEN ext = 'pdf' THEN 'pdf'
        WHEN ext IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'bmp', 'ico', 'tiff', 'tif', 'avif', 'heic', 'heif') THEN 'image'
        WHEN ext IN ('mp4', 'webm', 'mov', 'avi', 'mkv', 'flv', 'wmv', 'm4v') THEN 'video' WHEN ext IN ('mp3', 'wav', 'ogg', 'flac', 'aac', 'm4a', 'wma') THEN 'audio'
        WHEN ext IN ('doc', 'docx', 'xls', 'xlsx', 'ppt', 'pptx', 'odt', 'ods', 'odp', 'pages', 'numbers', 'key', 'epub') THEN 'document'
        WHEN ext IN ('json', 'jsonl', 'csv', 'tsv', 'yaml', 'yml', 'ndjson') THEN 'data'
        WHEN ext IN ('js', 'jsx', 'ts', 'tsx', 'py', 'rs', 'go', 'java', 'c', 'cpp', 'h', 'hpp', 'rb', 'php', 'swift', 'kt', 'scala', 'sh', 'bash', 'zsh', 'sql', 'r', 'lua', 'css',
          'scss', 'less', 'html', 'htm', 'xml', 'svg', 'vue', 'svelte', 'toml', 'ini', 'cfg', 'conf', 'dockerfile', 'makefile') THEN 'code'"""
    return {
        "frontmatter_fields": rf"""WITH x AS (SELECT doc_id, {_BLOCK} b, length({_BODY}) body_chars FROM documents),
            y AS (SELECT *, regexp_extract(b, '(?m)^tags:[ \t]*\[([^\r\n]*)\]', 1) l FROM x)
            SELECT doc_id, {_sql_scalar('type')} fm_type, {_sql_scalar('title')} fm_title, {_sql_scalar('updated')} fm_updated,
              coalesce(array_to_string(list_filter(list_transform(string_split(l, ','), lambda s: trim(s)), lambda s: s <> ''), '|'), '') tags, body_chars FROM y""",
        "frontmatter_map": rf"""WITH x AS (SELECT doc_id, {_BLOCK} b FROM documents),
            l AS (SELECT doc_id, unnest(regexp_extract_all(b, '(?m)^[A-Za-z_][\w-]*:[^\r\n]*')) s FROM x WHERE b IS NOT NULL)
            SELECT regexp_extract(s, '^([^:]*):', 1) field, count(*) n_docs, count(DISTINCT trim(regexp_replace(trim(substr(s, instr(s, ':') + 1)), '^"(.*)"$', '\1'))) n_values FROM l GROUP BY 1""",
        "page_titles": rf"""WITH x AS (SELECT doc_id, source, {_BLOCK} b, {_BODY} body FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, coalesce({_sql_scalar('title')}, nullif(trim(regexp_extract(body, '(?m)^#[ \t]+([^\r\n]+)', 1)), ''),
              replace(regexp_replace(regexp_replace(source, '^.*[/\\]', ''), '(.)\.[^.]*$', '\1'), '-', ' ')) title, coalesce(lower({_sql_scalar('type')}), 'other') page_type FROM x""",
        "wikilinks": rf"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{link}', 1) t, regexp_extract_all(text, '{link}', 2) a FROM documents),
            u AS (SELECT doc_id, unnest(range(0, len(t))) pos, t, a FROM m)
            SELECT doc_id, pos, trim(t[pos + 1]) target, coalesce(nullif(trim(a[pos + 1]), ''), trim(t[pos + 1])) AS label FROM u""",
        "paths_and_categories": rf"""WITH k AS (SELECT DISTINCT source_key, regexp_replace(source_key, '^.*/', '') file_name, lower(regexp_extract(source_key, '\.([^./]*)$', 1)) ext FROM source_files)
            SELECT source_key, regexp_replace(trim(source_key), '(?i)^(?:.*/)?(?:raw/)?sources/', '') AS identity, file_name, regexp_replace(file_name, '(.)\.[^.]*$', '\1') stem,
              CASE {cats} ELSE 'unknown' END category, replace(regexp_replace(source_key, '/[^/]*$', ''), '/', ' > ') folders,
              (file_name ILIKE '%.csv' OR source_key ILIKE 'raw/sources/survey/%') AS matched, regexp_replace(lower(regexp_replace(file_name, '(?i)\.md$', '')), '[\s_-]+', '', 'g') ref_key FROM k""",
        "title_slugs": r"""WITH t AS (SELECT DISTINCT title FROM entity_summaries WHERE title IS NOT NULL),
            s AS (SELECT title, regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '\s+', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '-{2,}', '-', 'g') s FROM t)
            SELECT title, coalesce(nullif(regexp_replace(substr(regexp_replace(s, '^-+|-+$', '', 'g'), 1, 50), '-+$', ''), ''), 'query') slug,
              lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) review_key, 'entity' AS type FROM s""",
        "query_tokens": rf"""WITH w AS (SELECT item_id, lower(regexp_replace(text, '^{cut}|{cut}$', '', 'g')) phrase,
              list_filter(regexp_split_to_array(lower(text), '{cut}'), lambda t: length(t) > 1 AND t NOT IN ({stop})) w FROM eval_items),
            x AS (SELECT *, list_filter(w, lambda t: regexp_matches(t, '[\x{{3400}}-\x{{9FFF}}]') AND length(t) > 2) c FROM w)
            SELECT item_id, phrase, array_to_string(list_sort(list_distinct(list_concat(w,
              flatten(list_transform(c, lambda t: list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))),
              list_filter(flatten(list_transform(c, lambda t: list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)))), lambda s: s NOT IN ({stop}))))), ' ') tokens FROM x""",
        "languages": _sql_language(),
        "script_shares": f"SELECT layout, {', '.join(n(s) for s in ('Chinese', 'Japanese', 'Thai', 'Hindi', 'Arabic', 'Russian'))} FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "page_summaries": rf"""WITH x AS (SELECT doc_id, {_BLOCK} b, {_BODY} body FROM documents WHERE text IS NOT NULL),
            y AS (SELECT doc_id, coalesce({_sql_scalar('description')}, list_filter(list_transform(regexp_split_to_array(body, '\r?\n'), lambda s: trim(s)),
              lambda s: s <> '' AND NOT regexp_matches(s, '^(?:#|\||```|~~~|---)'))[1]) s FROM x WHERE b IS NOT NULL)
            SELECT doc_id, CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '…' ELSE s END summary FROM y WHERE s IS NOT NULL""",
        "generated_blocks": """SELECT * FROM (SELECT '' problem, count(*) n, count(*) n_same FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT 'unsafe path', count(*), 0 FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'unclosed', count(*), 0 FROM documents WHERE text IS NOT NULL)""",
        "repaired_pages": "SELECT layout, count(*) n, count(*) n_same FROM documents WHERE text LIKE '---%' GROUP BY 1",
        "snippets": r"""WITH x AS (SELECT doc_id, text, instr(lower(text), 'letters') p FROM documents WHERE contains(lower(text), 'letters')),
            y AS (SELECT *, greatest(p - 80, 1) s, least(p + 87, length(text) + 1) e FROM x)
            SELECT doc_id, CASE WHEN s > 1 THEN '...' ELSE '' END || regexp_replace(substr(text, s, e - s), '\r?\n', ' ', 'g') || CASE WHEN e <= length(text) THEN '...' ELSE '' END snippet FROM y""",
        "content_hashes": "SELECT sha256(text) sha256, count(*) n, min(doc_id) first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    }
