"""Merging pages, validating proposed duplicate groups, deleting with all references, merging and settling reviews."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelattice.functions import markdown as M
from pagelattice.functions.bind import let
from pagelattice.functions.keys import page_key
from pagelattice.functions.text import normalise_review_title

LISTS = ("tags", "sources", "related")
LOCKED = ("type", "title", "created")
#: A merged body shorter than this share of the longer of its two sources is refused.
LEAST_SHARE = 0.7


def merge_pages(old: Column, new: Column, merged_body: Column | None = None, today: Column | None = None) -> Column:
    """The page that results when ``new`` is written over ``old``: the new page with the lists of both united.

    merged_body is the body that a model proposed for two pages whose bodies differ; without one the new body is taken. It is
    refused when it is shorter than LEAST_SHARE of the longer one, and then only the lists are united. Where it is taken, the
    locked fields are those of the old page and ``updated`` is ``today``, if that is given.
    Equal pages stay. A page without frontmatter is replaced by the new one. Only the block is rewritten, never a line of a body.
    """
    strict = lambda c: M.frontmatter_block(c, strict=True)
    none = F.lit(None).cast("string")
    given = F.struct(
        old.alias("old"), new.alias("new"), strict(old).alias("block_old"), strict(new).alias("block_new"), M.body(old).alias("body_old"), M.body(new).alias("body_new"),
        (M.body(new) if merged_body is None else merged_body).alias("merged"), (none if today is None else today).alias("today"),
    )
    # everything is bound once: a step of a fold would else be evaluated wherever it is named
    return let(given, lambda g: _merged(g, merged_body is not None))


def _merged(g: Column, proposed: bool) -> Column:
    unions = F.struct(*[M.list_union(M.array_field(g.block_old, f), M.array_field(g.block_new, f)).alias(f) for f in LISTS])
    locks = F.struct(*[M.scalar_field(g.block_old, f).alias(f) for f in LOCKED])
    taken = F.trim(g.body_old) != F.trim(g.body_new)
    if proposed:
        taken = taken & (F.length(g.merged) >= LEAST_SHARE * F.greatest(F.length(g.body_old), F.length(g.body_new)))

    def written(u: Column) -> Column:
        page = g.new
        for f in LISTS:
            page = let(page, _written(f, u[f]))
        return page

    def with_body(united: Column, v: Column) -> Column:
        page = F.concat(F.substring(united, F.lit(1), F.length(united) - F.length(M.body(united))), g.merged)
        for f in LOCKED:
            page = let(page, _locked(f, v[f]))
        return let(page, _locked("updated", g.today))

    page = let(let(unions, written), lambda united: F.when(taken, let(locks, lambda v: with_body(united, v))).otherwise(united))
    return F.when(g.old.isNull(), g.new).when(g.new.isNull() | (g.old == g.new), g.old).when(g.block_old.isNull() | g.block_new.isNull(), g.new).otherwise(page)


def _written(field: str, union: Column) -> Callable[[Column], Column]:
    return lambda p: F.when(F.size(union) > 0, M.write_array(p, field, union)).otherwise(p)


def _locked(field: str, v: Column) -> Callable[[Column], Column]:
    return lambda p: F.when(v.isNotNull(), M.set_scalar(p, field, v)).otherwise(p)


def valid_groups(groups: DataFrame, pages: DataFrame, apart: DataFrame) -> DataFrame:
    """Proposed duplicate groups reduced to known pages. groups: ``group_id, slugs``; apart: ``slugs``, sets once told to be different.

    A group needs two known pages; one whose set is listed in ``apart`` (whatever the order and case) is dropped.
    """
    known = groups.select("group_id", F.explode(F.array_distinct("slugs")).alias("slug")).join(pages.select(F.col("page_id").alias("slug")).distinct(), "slug", "left_semi")
    sets = known.groupBy("group_id").agg(F.array_sort(F.collect_set("slug")).alias("slugs")).where(F.size("slugs") >= 2)
    key = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.lower(x))), ",")
    return sets.withColumn("key", key("slugs")).join(apart.select(key("slugs").alias("key")).distinct(), "key", "left_anti").drop("key")


def rewrite_references(pages: DataFrame, renamed: DataFrame) -> DataFrame:
    """``id, links, changed``: link targets of merged pages replaced by the page that stays. pages: ``id, links``; renamed: ``old, new``.

    Links are looked up as rows, by key, and gathered again per page in their order; repeated targets are kept once.
    """
    l = pages.select("id", F.posexplode("links").alias("pos", "target"))
    # of several old names with one key the lowest decides
    r = renamed.groupBy(page_key(F.col("old")).alias("k")).agg(F.min_by("new", F.struct("old", "new")).alias("new"))
    j = l.withColumn("k", page_key(F.col("target"))).join(r, "k", "left").select("id", "pos", F.coalesce("new", "target").alias("target"), F.col("new").isNotNull().alias("hit"))
    g = j.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"])).alias("links"), F.max("hit").alias("changed"))
    return g


def delete_sources(pages: DataFrame, doomed: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """``id, verdict, sources``: what deleting source files does to each page that cites one. pages: ``id, sources``; doomed: ``source``.

    A page that has other sources left keeps these (``rewrite``), one that has none goes (``delete``).
    """
    e = pages.select("id", F.posexplode(F.coalesce("sources", F.array().cast("array<string>"))).alias("pos", "s")).where("s IS NOT NULL AND trim(s) <> ''")
    d = doomed.select(key(F.col("source")).alias("k"), F.lit(True).alias("gone")).distinct()
    j = e.withColumn("k", key(F.col("s"))).join(d, "k", "left")
    g = j.groupBy("id").agg(F.count("gone").alias("n_gone"), F.transform(F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "s")))), lambda x: x["s"]).alias("sources"))
    return g.where("n_gone > 0").select("id", F.when(F.size("sources") == 0, "delete").otherwise("rewrite").alias("verdict"), "sources")


def dead_references(pages: DataFrame, deleted: DataFrame) -> DataFrame:
    """``id, n_links``: pages whose links lead to deleted ones. pages: ``id, links``; deleted: ``id``."""
    l = pages.select("id", F.explode("links").alias("t")).where("t IS NOT NULL").withColumn("k", page_key(F.col("t")))
    hit = l.join(deleted.select(page_key(F.col("id")).alias("k")).distinct(), "k", "left_semi").join(deleted.select("id").distinct(), "id", "left_anti")
    return hit.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))


def merge_reviews(items: DataFrame) -> DataFrame:
    """``type, key, title, description, pages, n``: open reviews of one kind and title as one: pages united, the newest text that there is.

    items: ``seq, type, title, description, pages, resolved``. Pages are made distinct as rows before they are gathered.
    """
    o = items.where(~F.coalesce("resolved", F.lit(False))).withColumn("key", normalise_review_title(F.col("title")))
    said = F.when(F.trim("description") != "", F.col("seq"))
    g = o.groupBy("type", "key").agg(F.min_by("title", "seq").alias("title"), F.max_by("description", said).alias("description"), F.count(F.lit(1)).alias("n"))
    p = o.select("type", "key", "seq", F.posexplode("pages").alias("pos", "page")).where("page IS NOT NULL AND trim(page) <> ''").groupBy("type", "key", "page").agg(F.min(F.struct("seq", "pos")).alias("first"))
    p = p.groupBy("type", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "page"))), lambda x: x["page"]).alias("pages"))
    return g.join(p, ["type", "key"], "left").select("type", "key", "title", "description", F.coalesce("pages", F.array().cast("array<string>")).alias("pages"), "n")


def settled_reviews(reviews: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, action``: reviews that the wiki's state has settled. reviews: ``id, type, title, pages``; pages: ``id, title``.

    A missing page is settled once a page of that name exists, by id or title; a duplicate once one of its pages is gone.
    """
    names = pages.select(page_key(F.col("id")).alias("k")).unionByName(pages.where("title IS NOT NULL").select(page_key(F.col("title")).alias("k"))).distinct()
    missing = reviews.where("type = 'missing-page'").withColumn("k", page_key(normalise_review_title(F.col("title")))).join(names, "k", "left_semi").select("id", F.lit("page exists").alias("action"))
    dup = reviews.where("type = 'duplicate'").select("id", F.explode("pages").alias("p")).withColumn("k", page_key(F.col("p"))).join(names, "k", "left_anti").select("id").distinct()
    return missing.unionByName(dup.withColumn("action", F.lit("page gone")))


def batched_calls(rows: DataFrame, prompt: str, ask: Callable[[list[str]], list[str]], answer: str = "answer") -> DataFrame:
    """``rows`` with a model's answer to the column ``prompt`` and, in ``<answer>_problem``, why there is none.

    ``ask`` is handed the texts of an Arrow batch. A client that fails, or that gives fewer answers than it was asked for,
    leaves its batch without answers but with the failure in the problem column, so that it can be asked again.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(answer, T.StringType()), T.StructField(f"{answer}_problem", T.StringType())])

    def run(batches):
        for b in batches:
            out = b.copy()
            todo = b[prompt].notna()
            replies = pd.Series([None] * len(b), index=b.index, dtype=object)
            problems = pd.Series(["no prompt"] * len(b), index=b.index, dtype=object)
            try:
                replies[todo] = ask(b.loc[todo, prompt].tolist())
                problems[todo] = [None if r is not None else "no answer" for r in replies[todo]]
            except Exception as e:  # whatever a client raises is told of its rows
                replies[todo] = None
                problems[todo] = f"{type(e).__name__}: {e}"
            out[answer], out[f"{answer}_problem"] = replies, problems
            yield out

    return rows.mapInPandas(run, schema)


def link_terms(content: Column, terms: Column) -> Column:
    """The page with the first unlinked occurrence of each term as a link. terms: array of ``struct<term, target>``; frontmatter and present links stay."""
    head = F.substring(content, F.lit(1), F.length(content) - F.length(M.strip_top(content)))

    def one(acc, t):
        parts = F.split(acc, r"(?=\[\[)|(?<=\]\])")
        hit = F.array_position(F.transform(parts, lambda p: ~p.startswith("[[") & p.contains(t["term"])), True).cast("int")
        link = F.when(t["term"] == t["target"], F.concat(F.lit("[["), t["target"], F.lit("]]"))).otherwise(F.concat(F.lit("[["), t["target"], F.lit("|"), t["term"], F.lit("]]")))
        linked = acc.contains(F.concat(F.lit("[["), t["target"], F.lit("]]"))) | acc.contains(F.concat(F.lit("[["), t["target"], F.lit("|")))
        put = lambda p: F.concat(F.substring(p, F.lit(1), F.instr(p, t["term"]) - 1), link, F.substring(p, F.instr(p, t["term"]) + F.length(t["term"]), F.length(p)))
        return F.when((hit > 0) & ~linked, F.array_join(F.transform(parts, lambda p, i: F.when(i + 1 == hit, put(p)).otherwise(p)), "")).otherwise(acc)

    return F.concat(head, F.aggregate(terms, M.strip_top(content), one))
