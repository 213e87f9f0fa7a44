"""Putting ranked pages into a prompt's budget, trimming an index, windows over conversations, rate windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.text import is_greeting

#: The whole budget in characters and the shares of answer, index and pages; a page's share of the pages' and its least size.
TOTAL, ANSWER, INDEX, PAGES, PAGE, PAGE_LEAST = 204_800, 0.15, 0.05, 0.5, 0.3, 5_000
CUT = "\n\n[...truncated...]"


def budgets(total: int = TOTAL) -> dict[str, int]:
    pages = int(total * PAGES)
    return {"answer": int(total * ANSWER), "index": int(total * INDEX), "pages": pages, "page": min(pages, max(PAGE_LEAST, int(pages * PAGE)))}


def pack(ranked: DataFrame, budget: int, most: int, per: str = "query_id") -> DataFrame:
    """``per, number, page_id, size, truncated``: pages taken in order of ``place`` while they fit; one that doesn't is skipped and the next is tried.

    ranked: ``per, place, page_id, content``. A page longer than ``most`` is cut to it and marked. Which pages fit depends
    on all before, so the ranked list of a query is folded as one array of sizes; it is the short result of a top-k.
    """
    size = F.least(F.length("content"), F.lit(most)) + F.when(F.length("content") > most, len(CUT)).otherwise(0)
    lists = ranked.where("content IS NOT NULL").groupBy(per).agg(F.array_sort(F.collect_list(F.struct("place", "page_id", size.alias("size"), (F.length("content") > most).alias("truncated")))).alias("items"))
    kept = F.aggregate(
        "items",
        F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<place:bigint,page_id:string,size:int,truncated:boolean>>").alias("out")),
        lambda acc, x: F.when(
            acc["used"] + x["size"] <= budget,
            F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["place"].cast("bigint").alias("place"), x["page_id"].alias("page_id"), x["size"].alias("size"), x["truncated"].alias("truncated")))).alias("out")),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    return lists.select(per, F.posexplode(kept).alias("n", "x")).select(per, (F.col("n") + 1).cast("bigint").alias("number"), "x.page_id", F.col("x.size").cast("bigint").alias("size"), "x.truncated")


def assembled(queries: DataFrame, hits: DataFrame, related: DataFrame, pages: DataFrame, budget: int, most: int, top: int = 10) -> DataFrame:
    """``query_id, number, page_id, part, size, truncated``: the numbered pages that a question is answered from.

    queries: ``query_id, query``; one that is a mere greeting gets none. hits: ``query_id, page_id, place, title_match``, of
    which the first ``top`` count; related: ``seed, id, relevance``; pages: ``page_id, content``. Pages whose title matches
    come first, then the other hits, then pages related to a hit by their relevance to it; each page once, packed as in ``pack``.
    """
    asked = queries.where(~is_greeting(F.col("query"))).select("query_id")
    h = hits.join(asked, "query_id", "left_semi").where(F.col("place") <= top)
    found = h.select("query_id", "page_id", F.when(F.col("title_match"), 0).otherwise(1).alias("part"), F.col("place").cast("double").alias("turn"))
    near = h.select("query_id", F.col("page_id").alias("seed")).join(related.select("seed", F.col("id").alias("page_id"), "relevance"), "seed")
    near = near.select("query_id", "page_id", F.lit(2).alias("part"), (-F.col("relevance")).alias("turn"))
    once = found.unionByName(near).groupBy("query_id", "page_id").agg(F.min(F.struct("part", "turn")).alias("o"))
    known = once.join(pages.select("page_id", "content"), "page_id")
    w = Window.partitionBy("query_id").orderBy("o.part", "o.turn", "page_id")
    placed = known.withColumn("place", F.row_number().over(w))
    return pack(placed.select("query_id", "place", "page_id", "content"), budget, most).join(once.select("query_id", "page_id", F.col("o.part").cast("bigint").alias("part")), ["query_id", "page_id"]).select("query_id", "number", "page_id", "part", "size", "truncated")


def trim_index(text: Column, tokens: Column, budget: int) -> Column:
    """Section headings and lines that hold a token, as many from the top as the budget allows; a line that doesn't fit is skipped."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.startswith("##") | F.exists(tokens, lambda t: F.lower(s).contains(t)))
    kept = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(acc["used"] + F.length(s) + 1 <= budget, F.struct((acc["used"] + F.length(s) + 1).alias("used"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc),
        lambda acc: F.array_join(acc["out"], "\n"),
    )
    return kept


def last_messages(messages: DataFrame, n: int = 10, per: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` messages of each conversation. Spark limits each map task's groups before the shuffle."""
    w = Window.partitionBy(per).orderBy(F.desc(order))
    return messages.withColumn("back", F.row_number().over(w).cast("bigint")).where(F.col("back") <= n)


def rollup(messages: DataFrame, per: str = "conv_id", order: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """``per, n_messages, title, last``: the title is the first 50 characters of the first user message."""
    mine = F.when(F.col(role) == "user", F.col(order))
    return messages.groupBy(per).agg(F.count(F.lit(1)).alias("n_messages"), F.substring(F.min_by(F.when(F.col(role) == "user", F.col(text)), mine), 1, 50).alias("title"), F.max(order).alias("last"))


def rate_limited(requests: DataFrame, limit: int = 120, seconds: float = 1.0, per: str = "client", at: str = "at") -> DataFrame:
    """Requests with ``recent``, the number of the client's requests in the window that ends with them, and ``allowed``.

    The window is partitioned by client and slot, a slot being a day or, if that is longer, the window's own length, and each
    slot also has the tail of the slot before. So a busy client is spread over slots, and none misses a request.
    """
    span = int(seconds * 1_000_000)
    slot = max(span, 86_400_000_000)
    r = requests.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_d", F.floor(F.col("_t") / slot))
    tail = r.where(F.floor((F.col("_t") + span) / slot) > F.col("_d")).withColumn("_d", F.col("_d") + 1).withColumn("_copy", F.lit(True))
    w = Window.partitionBy(per, "_d").orderBy("_t").rangeBetween(-span + 1, 0)
    both = r.withColumn("_copy", F.lit(False)).unionByName(tail).withColumn("recent", F.count(F.lit(1)).over(w))
    return both.where(~F.col("_copy")).withColumn("allowed", F.col("recent") <= limit).drop("_t", "_d", "_copy")
