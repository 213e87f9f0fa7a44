"""References to records that do not exist.

Two operators share one idea: the instants (or integers) at which a parent exists are compressed into contiguous runs,
every reference is as-of matched to the run that starts at or before it, and what lies beyond that run's end is an orphan.

Periods are compressed twice, per (key, hour) and then per key, by windows that stream; what is left of a key is its gaps. A
key's runs are kept as short sorted arrays of CHUNK runs, so a reference meets one row however many periods its parent had.
References are shuffled once, by key, and nothing is gathered or ordered on their side: a key that holds a third of them is
split over tasks by the engine's skew handling, and where the runs are small they are broadcast, which Spark decides by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.keys import file_key, is_blank, page_key

FOREVER = "9999-12-31 00:00:00"
#: Runs of a key in one row.
CHUNK = 1024


def time_runs(parents: DataFrame, grain: str = "hour") -> DataFrame:
    """``key, start, end, n``: the contiguous runs of each key's periods, numbered from 1 in order of time.

    parents: ``key, since, until``; a period ends before ``until``, null means never. Periods that overlap or touch are one
    run. A null key or ``since`` and an empty period are left out.
    """
    p = (
        parents.where(F.col("key").isNotNull() & F.col("since").isNotNull())
        .select("key", F.col("since").alias("start"), F.coalesce("until", F.lit(FOREVER).cast("timestamp_ntz")).alias("end"))
        .where(F.col("end") > F.col("start"))
        .groupBy("key", "start")
        .agg(F.max("end").alias("end"))
    )

    def compressed(d: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("start")
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
        islands = d.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return islands.groupBy(*by, "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))

    hours = compressed(p.withColumn("slot", F.date_trunc(grain, "start")), "key", "slot")
    return compressed(hours.select("key", "start", "end"), "key").select("key", "start", "end", "n")


def orphans_as_of(refs: DataFrame, parents: DataFrame, grain: str = "hour") -> DataFrame:
    """Rows of ``refs`` whose parent does not exist at the time of the reference.

    refs: ``key, at`` and any other columns. parents: ``key, since, until``; a parent exists at t if since <= t and until is
    null or later than t; of several records of a key any one suffices. Columns of ``parents`` beyond these are ignored.

    Defined results: a reference with a null key or a null ``at`` names nothing that could be looked up and is dropped;
    a parent with a null key or a null ``since`` never existed; with no parents every reference is an orphan; repeated
    rows of ``refs`` come out as often as they went in.
    """
    payload = [c for c in refs.columns if c not in ("key", "at")]
    runs = time_runs(parents, grain).groupBy("key", F.floor((F.col("n") - 1) / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    # a chunk is good until the next one begins; most keys have one
    behind = runs.select("key", (F.col("chunk") - 1).alias("chunk"), F.element_at("runs", 1).start.alias("until"))
    chunks = runs.join(behind.where("chunk >= 0"), ["key", "chunk"], "left").select(F.col("key").alias("_key"), "runs", F.element_at("runs", 1).start.alias("_since"), F.col("until").alias("_until"))
    r = refs.where(F.col("key").isNotNull() & F.col("at").isNotNull()).select("key", "at", F.struct(*([F.col(c) for c in payload] or [F.lit(1).alias("_")])).alias("_ref"))
    here = (F.col("key") == F.col("_key")) & (F.col("at") >= F.col("_since")) & (F.col("_until").isNull() | (F.col("at") < F.col("_until")))
    before = F.element_at(F.filter("runs", lambda x: x.start <= F.col("at")), -1)
    lost = r.join(chunks, here, "left").where(F.col("_key").isNull() | (F.col("at") >= before.end))
    return lost.select("key", "at", *[F.col(f"_ref.`{c}`").alias(c) for c in payload])


def contiguous_runs(keys: DataFrame, key: str = "key", block: int = 1 << 16) -> DataFrame:
    """Runs ``block, run_start, run_end`` of the integers in ``keys``; a run ends at a gap or at its block's border.

    Blocks keep the window bounded: no task sees more than ``block`` different integers. Nulls are left out.
    """
    d = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k")).distinct()
    d = d.withColumn("block", F.floor(F.col("k") / F.lit(block)).cast("bigint"))
    w = Window.partitionBy("block").orderBy("k")
    return (
        d.withColumn("island", F.col("k") - F.row_number().over(w))
        .groupBy("block", "island")
        .agg(F.min("k").alias("run_start"), F.max("k").alias("run_end"))
        .drop("island")
    )


def orphan_keys(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str, block: int = 1 << 16) -> DataFrame:
    """Distinct integer keys of ``children`` with no parent, with the number of child rows: ``key, n_rows``.

    Child rows are counted per key on the map side before anything is matched, so a hot key is one row. Each key is then
    as-of matched to the run of its block that starts at or before it and is an orphan beyond that run's end.
    """
    runs = contiguous_runs(parents, parent_key, block)
    c = (
        children.where(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).cast("bigint").alias("k"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("block", F.floor(F.col("k") / F.lit(block)).cast("bigint"))
    )
    none = F.lit(None).cast("bigint")
    both = c.select("block", "k", F.lit(1).alias("turn"), none.alias("run_end"), "n_rows").unionByName(
        runs.select("block", F.col("run_start").alias("k"), F.lit(0).alias("turn"), "run_end", none.alias("n_rows"))
    )
    w = Window.partitionBy("block").orderBy("k", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = both.withColumn("end_here", F.last("run_end", ignorenulls=True).over(w)).where(F.col("turn") == 1)
    return m.where(F.col("end_here").isNull() | (F.col("k") > F.col("end_here"))).select(F.col("k").alias("key"), "n_rows")


def exploded(records: DataFrame, ref_id: str, at: str, fields: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per different non-blank entry of the array columns ``fields``: ``ref_field, ref_id, at, target, key``. Values of ``fields``: kind and key of an entry ``target``.

    Repeated deliveries of a record are collapsed before its arrays are unfolded.
    """
    once = records.select(F.col(ref_id).cast("bigint").alias("ref_id"), F.col(at).alias("at"), *fields).distinct()
    named = lambda f: F.transform(F.array_distinct(F.coalesce(f, F.array().cast("array<string>"))), lambda v: F.struct(F.lit(f).alias("ref_field"), v.alias("target")))
    entries = F.concat(*map(named, fields))
    e = once.select("ref_id", "at", F.explode(entries).alias("e")).select("e.ref_field", "ref_id", "at", "e.target").where(~is_blank(F.col("target")))
    key = F.lit(None).cast("string")
    for f, (kind, k) in fields.items():
        key = F.when(F.col("ref_field") == f, F.concat(F.lit(kind), k)).otherwise(key)
    return e.withColumn("key", key)


def wiki_references(nodes: DataFrame, lint: DataFrame) -> DataFrame:
    """All references of the wiki: ``ref_field, ref_id, at, target, key``. Equal records count once; a reference of two unlike records of one id and time comes twice."""
    target = F.col("target")
    of_nodes = exploded(nodes, "node_id", "updated_at", {"out_links": ("p:", page_key(target)), "sources": ("f:", file_key(target))})
    return of_nodes.unionByName(exploded(lint, "lint_id", "detected_at", {"affected_pages": ("p:", page_key(target))}))


def wiki_parents(nodes: DataFrame, structural: DataFrame, files: DataFrame) -> DataFrame:
    """All periods of existence of the wiki's pages and files: ``key, since, until``."""
    never = F.lit(None).cast("timestamp_ntz")
    return (
        nodes.select(F.concat(F.lit("p:"), page_key(F.col("page_id"))).alias("key"), F.col("created_at").alias("since"), F.col("deleted_at").alias("until"))
        .unionByName(structural.select(F.concat(F.lit("p:"), page_key(F.col("page_id"))).alias("key"), F.col("created_at").alias("since"), never.alias("until")))
        .unionByName(files.select(F.concat(F.lit("f:"), file_key(F.col("source_key"))).alias("key"), F.col("arrived_at").alias("since"), F.col("deleted_at").alias("until")))
    )


def wiki_orphans(nodes: DataFrame, lint: DataFrame, structural: DataFrame, files: DataFrame) -> DataFrame:
    """Orphan references of the wiki, once each: ``ref_field, ref_id, target, at``."""
    return orphans_as_of(wiki_references(nodes, lint), wiki_parents(nodes, structural, files)).select("ref_field", "ref_id", "target", "at").distinct()


def wiki_orphan_report(nodes: DataFrame, lint: DataFrame, structural: DataFrame, files: DataFrame) -> DataFrame:
    """Per referring table, field and month: ``table_name, ref_field, month, n_orphans, n_records``."""
    o = wiki_orphans(nodes, lint, structural, files)
    name = F.when(F.col("ref_field") == "affected_pages", "lint_results").otherwise("retrieval_nodes")
    return o.groupBy(name.alias("table_name"), "ref_field", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("ref_id").alias("n_records")
    )
