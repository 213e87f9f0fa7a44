"""Structural checks of the wiki: pages nobody links to, links to no page, pages without links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.keys import page_key

EXEMPT = ["index", "log"]


def structural_findings(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``kind, page, target, n``: orphans, broken links (once per occurrence in n) and pages without links.

    pages: ``id``; links: ``src, target``. index and log are neither checked nor do their links save a page. A target is
    known by its normalised key. All three are anti-joins on that key.
    """
    checked = pages.select("id").distinct().withColumn("k", page_key(F.col("id"))).where(~F.col("k").isin(EXEMPT))
    keys = pages.select(page_key(F.col("id")).alias("k")).distinct()
    l = links.where(F.col("src").isNotNull() & (F.coalesce(F.trim("target"), F.lit("")) != "")).select("src", F.trim("target").alias("target"), page_key(F.col("target")).alias("k"))
    l = l.where(~page_key(F.col("src")).isin(EXEMPT))
    orphans = checked.join(l.where(page_key(F.col("src")) != F.col("k")).select("k").distinct(), "k", "left_anti").select(F.lit("orphan").alias("kind"), F.col("id").alias("page"), F.lit(None).cast("string").alias("target"), F.lit(1).cast("bigint").alias("n"))
    broken = l.groupBy("src", "target", "k").agg(F.count(F.lit(1)).alias("n")).join(keys, "k", "left_anti").select(F.lit("broken-link").alias("kind"), F.col("src").alias("page"), "target", "n")
    silent = checked.join(l.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select(F.lit("no-outlinks").alias("kind"), F.col("id").alias("page"), F.lit(None).cast("string").alias("target"), F.lit(1).cast("bigint").alias("n"))
    return orphans.unionByName(broken).unionByName(silent)


def missing_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``key, n_links, n_pages``: names that links use and no page has, most wanted first."""
    l = links.where(F.coalesce(F.trim("target"), F.lit("")) != "").select("src", page_key(F.col("target")).alias("key"))
    return l.join(pages.select(page_key(F.col("id")).alias("key")).distinct(), "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("src").alias("n_pages"))
