"""All similar pairs between set-valued records, exactly.

Metric pivot partitioning was the first choice and can't do this: at a likeness of 0.6 the Jaccard ball has a radius of
0.4, while nearly all records lie at distance 1 from nearly all pivots, so the triangle inequality lets no cell be left
out and every record is replicated to every cell (measured in the README). Cells are therefore cut by shared values.

Values are numbered exactly (a dictionary, no hashes) and ordered by ascending frequency. A set of n values whose partner must share at least o = ceil(0.6 n) has, in
its n - o + 2 rarest values, at least two of those that it shares (Jaccard prefix filter with prefix depth 2). Its cells
are the pairs of these values, so that common tags alone make no large cell. Cells hold ids and sizes alone; the pairs
that pass a bound by size and place are made distinct and checked on their sets. Equal sets are collapsed first. A cell that
a sample shows to hold more than BLOCK sets is cut into blocks, each joined with the whole cell in a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.session import shared_checkpoint

#: Sets of one block of a cell; hot cells are looked for among one in SHARE of the sets.
BLOCK, SHARE = 1 << 13, 64


def similar_sets(df: DataFrame, numerator: int = 3, denominator: int = 5, least: int = 4, field: str = "set_field", key: str = "id", values: str = "values") -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs of classes of equal sets, and each record's class.

    pairs: ``field, a, b, common, united`` with a < b, class ids being the lowest key of a class; members: ``field, key, cls, n``.
    A pair needs common / united >= numerator / denominator, compared in integers. Sets of fewer than ``least`` values are
    left out; nulls don't count; repeated rows count once; with the prefix depth of two, ``least`` must let partners share
    two values.

    Defined results: null keys and null or empty arrays are no records; the values of all rows of a key are one set; no
    records give no pairs.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(values).isNotNull()).select(F.col(field).alias("field"), F.col(key).alias("key"), F.filter(values, lambda v: v.isNotNull()).alias("values"))
    whole = rows.groupBy("field", "key").agg(F.array_distinct(F.flatten(F.collect_set("values"))).alias("values")).where(F.size("values") >= least)
    e = whole.select("field", "key", F.explode("values").alias("v"))
    # numbers stand for the values from here on
    freq = shared_checkpoint(e.groupBy("field", "v").agg(F.count(F.lit(1)).alias("df")).withColumn("h", F.monotonically_increasing_id()))
    ranked = e.join(freq, ["field", "v"]).groupBy("field", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "h"))), lambda x: x.h).alias("vs"))
    classes = ranked.groupBy("field", "vs").agg(F.min("key").alias("cls"))
    placed = shared_checkpoint(ranked.join(classes, ["field", "vs"]).select("field", "key", "cls", F.size("vs").alias("n"), "vs"))
    sets = placed.where("key = cls").select("field", "cls", "n", "vs")

    cells = _cells(sets, numerator, denominator)
    hot = _cells(sets.where(F.pmod(F.xxhash64("cls"), F.lit(SHARE)) == 0), numerator, denominator).groupBy("field", "v1", "v2").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= BLOCK // SHARE)
    blocks = F.coalesce(F.ceil(F.col("k") * SHARE / BLOCK), F.lit(1).cast("bigint"))
    spread = cells.join(shared_checkpoint(hot), ["field", "v1", "v2"], "left").withColumn("blocks", blocks)
    a = spread.select("field", "v1", "v2", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"))
    b = spread.select("field", "v1", "v2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    # in the cell of their two rarest common values, what lies behind these in both bounds what two sets share
    fits = (F.least("na", "nb") * denominator >= F.greatest("na", "nb") * numerator) & ((F.least("la", "lb") + 2) * (numerator + denominator) >= (F.col("na") + F.col("nb")) * numerator)
    met = a.join(b, ["field", "v1", "v2", "block"]).where((F.col("a") < F.col("b")) & fits).select("field", "a", "b").distinct()
    side = lambda x: sets.select("field", F.col("cls").alias(x), F.col("vs").alias(f"v{x}"))
    both = met.join(side("a"), ["field", "a"]).join(side("b"), ["field", "b"])
    checked = both.select("field", "a", "b", F.size(F.array_intersect("va", "vb")).alias("common"), (F.size("va") + F.size("vb")).alias("total"))
    pairs = checked.select("field", "a", "b", "common", (F.col("total") - F.col("common")).alias("united")).where(F.col("common") * denominator >= F.col("united") * numerator)
    return pairs, placed.select("field", "key", "cls", "n")


def _cells(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """``field, cls, n, v1, v2, left``: a row for every two values of a set's prefix; ``left``: values of the set behind the second."""
    need = F.ceil(F.col("n") * F.lit(numerator) / F.lit(denominator)).cast("int")
    depth = F.least(F.col("n"), F.col("n") - need + 2)
    heads = sets.select("field", "cls", "n", F.slice("vs", F.lit(1), depth).alias("head"))
    first = heads.select("field", "cls", "n", "head", F.posexplode("head").alias("i", "v1"))
    rest = F.slice("head", F.col("i") + 2, F.greatest(F.size("head") - F.col("i") - 1, F.lit(0)))
    return first.select("field", "cls", "n", "v1", "i", F.posexplode(rest).alias("j", "v2")).select("field", "cls", "n", "v1", "v2", (F.col("n") - F.col("i") - F.col("j") - 2).alias("left"))


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``field, id_a, id_b``: class pairs and classes written out as pairs of records, the smaller key first."""
    m = members.select("field", "cls", "key")
    left, right = m.select("field", F.col("cls").alias("a"), F.col("key").alias("x")), m.select("field", F.col("cls").alias("b"), F.col("key").alias("y"))
    across = pairs.select("field", "a", "b").join(left, ["field", "a"]).join(right, ["field", "b"])
    within = left.join(right.withColumnRenamed("b", "a"), ["field", "a"]).where("x < y")
    return across.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(within.select("field", F.col("x").alias("id_a"), F.col("y").alias("id_b")))
