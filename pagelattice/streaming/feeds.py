"""Structured Streaming: watching files, coalescing their changes, suppressing own writes, debouncing, counting requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelattice.operators.changes import snapshot_diff


def file_feed(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """New and rewritten files below ``root`` as a stream of ``path, at, hash, size, text``."""
    s = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).schema("value string").load(root)
    m = F.col("_metadata")
    return s.select(m["file_path"].alias("path"), m["file_modification_time"].alias("at"), F.md5("value").alias("hash"), m["file_size"].alias("size"), F.col("value").alias("text"))


def rescan(before: DataFrame, after: DataFrame, at: str) -> DataFrame:
    """Changes between two listings as rows of the change feed: ``key, at, kind``."""
    return snapshot_diff(before, after).select(F.col("path").alias("key"), F.lit(at).cast("timestamp").alias("at"), "kind")


def _fold(state: str, kind: str) -> str:
    return "modified" if kind == "modified" or {state, kind} == {"created", "deleted"} else kind


def coalesced(changes: DataFrame, lateness: str = "10 minutes", quiet_ms: int = 700) -> DataFrame:
    """``key, kind, n``: one change per key and burst. A burst ends when the watermark is ``quiet_ms`` past its last change.

    State per key is one kind, one count and one time, however long the burst is.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kind, n, _ = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "kind": [kind], "n": [n]})
            return
        kind, n, last = state.get if state.exists else ("", 0, 0)
        for b in batches:
            for k, at in b.sort_values(["at", "kind"])[["kind", "at"]].itertuples(index=False):
                kind, n, last = _fold(kind, k), n + 1, max(last, int(at.timestamp() * 1000))
        state.update((kind, n, last))
        state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))

    return changes.withWatermark("at", lateness).groupBy("key").applyInPandasWithState(step, "key string, kind string, n bigint", "kind string, n bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def without_own_writes(changes: DataFrame, writes: DataFrame, seconds: int = 4) -> DataFrame:
    """Changes no own write of the path precedes by ``seconds`` or less; both streams: ``path, at``. A left outer interval join whose unmatched rows are kept."""
    c = changes.select(F.col("path"), F.col("at")).withWatermark("at", "10 seconds").alias("c")
    w = writes.select(F.col("path").alias("w_path"), F.col("at").alias("w_at")).withWatermark("w_at", "10 seconds").alias("w")
    near = (F.col("path") == F.col("w_path")) & (F.col("at") >= F.col("w_at")) & (F.col("at") <= F.col("w_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return c.join(w, near, "left_outer").where("w_path IS NULL").select("path", "at")


def debounced(changes: DataFrame, within: str = "1 minute") -> DataFrame:
    """Each (key, kind) once per watermark span."""
    return changes.withWatermark("at", within).dropDuplicatesWithinWatermark(["key", "kind"])


def request_counts(requests: DataFrame, span: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """``client, start, n`` per window of ``span``; requests later than ``lateness`` are not counted."""
    w = requests.withWatermark("at", lateness).groupBy(F.window("at", span).alias("w"), "client").agg(F.count(F.lit(1)).alias("n"))
    return w.select("client", F.col("w.start").alias("start"), "n")


def run_batches(feed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each micro-batch to ``handle``; restarting from ``checkpoint`` resumes where it ended, so ``handle`` must stand being given a batch twice."""
    return feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
