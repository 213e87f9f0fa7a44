"""Change detection between snapshots, coalescing of changes, cached work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["created", "modified", "deleted"]


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, kind``: created, modified or deleted. Both: ``path, hash, size``; a file is modified if its size or, where both are known, its hash differs. One full outer join; null paths are left out."""
    b = before.where("path IS NOT NULL").select("path", F.col("hash").alias("h0"), F.col("size").alias("s0"), F.lit(1).alias("was"))
    a = after.where("path IS NOT NULL").select("path", F.col("hash").alias("h1"), F.col("size").alias("s1"), F.lit(1).alias("now"))
    differs = ~F.col("s0").eqNullSafe(F.col("s1")) | (F.col("h0") != F.col("h1"))
    kind = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "deleted").when(F.coalesce(differs, F.lit(False)), "modified")
    return b.join(a, "path", "full_outer").select("path", kind.alias("kind")).where("kind IS NOT NULL")


def _step(state: Column, kind: Column) -> Column:
    """The open change after one more: undoing each other makes a modification, a modification wins, else the newest."""
    opposite = ((state == "deleted") & (kind == "created")) | ((state == "created") & (kind == "deleted"))
    return F.when(kind == "modified", "modified").when(opposite, "modified").otherwise(kind)


def coalesce_changes(changes: DataFrame, grain: str = "hour") -> DataFrame:
    """``key, kind, n``: one open change per key. changes: ``key, at, kind``; of equal times the order is created, deleted, modified.

    Folding changes is a composition of maps from state to state, which is associative: the changes of one hour are folded
    from every state they could meet, and only these short maps are folded in turn. So no key's whole history is gathered.
    """
    starts = ["", *KINDS]
    c = changes.where(F.col("key").isNotNull() & F.col("kind").isin(KINDS) & F.col("at").isNotNull())
    hours = c.groupBy("key", F.date_trunc(grain, "at").alias("slot")).agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("events"), F.count(F.lit(1)).alias("n"))
    maps = hours.select("key", "slot", "n", F.map_from_arrays(F.array(*map(F.lit, starts)), F.array(*[F.aggregate("events", F.lit(s), lambda acc, e: _step(acc, e["kind"])) for s in starts])).alias("m"))
    folded = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slot", F.array(*[F.element_at("m", s) for s in starts]).alias("to")))).alias("ms"), F.sum("n").alias("n"))
    at = lambda acc: F.array_position(F.array(*map(F.lit, starts)), acc).cast("int")
    return folded.select("key", F.aggregate("ms", F.lit(""), lambda acc, m: F.element_at(m["to"], at(acc))).alias("kind"), "n")


def without_own_writes(changes: DataFrame, writes: DataFrame, seconds: int = 4) -> DataFrame:
    """Changes that no own write of the same path precedes by ``seconds`` or less. Both: ``path, at``; the join is on path and time slot."""
    slot = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)
    w = writes.select("path", F.col("at").alias("written"), slot(F.col("at")).alias("slot")).distinct()
    w = w.unionByName(w.withColumn("slot", F.col("slot") + 1))
    near = (F.col("c.at") >= F.col("w.written")) & (F.col("c.at") <= F.col("w.written") + F.expr(f"INTERVAL {seconds} SECONDS"))
    c = changes.withColumn("slot", slot(F.col("at"))).alias("c")
    return c.join(w.alias("w"), (F.col("c.path") == F.col("w.path")) & (F.col("c.slot") == F.col("w.slot")) & near, "left_anti").drop("slot")


def cache_hits(sources: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """Sources whose content was processed before and whose outputs all exist still. sources: ``identity, sha256``; cache: ``identity, sha256, outputs``; files: ``path``."""
    hit = sources.select("identity", "sha256").join(cache, ["identity", "sha256"])
    gone = hit.select("identity", F.explode("outputs").alias("path")).join(files.select("path").distinct(), "path", "left_anti").select("identity").distinct()
    return hit.join(gone, "identity", "left_anti").select("identity", "sha256")


def open_tasks(tasks: DataFrame, retries: int = 3) -> DataFrame:
    """Counts per state of the latest record of each task. tasks: ``id, at, status, retry_count``; a failed one with tries left is pending."""
    last = tasks.groupBy("id").agg(F.max(F.struct("at", "status", "retry_count")).alias("r"))
    state = F.when((F.col("r.status") == "failed") & (F.col("r.retry_count") < retries), "pending").otherwise(F.col("r.status"))
    return last.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
