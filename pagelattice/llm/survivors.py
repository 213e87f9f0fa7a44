"""Best representative of each duplicate group, by skyline selection, filled from its dominance layers.

The records of a group are peeled into dominance layers over completeness (how many fields are usable), recency and trust in
the origin: layer 1 is the skyline, the records that no other is at least as good as in all three and better in one; layer
n + 1 is the skyline of what lies behind layer n. The survivor of a field is found by a walk over the layers, front first: a
layer's best record that can fill the field, by the policy (trust, recency, completeness, lowest member number), is taken if
there is none yet or if it precedes the one taken so far in the policy's order. So nulls and stand-ins of the front are
filled from successive layers, and a less trusted value of a front layer never hides a more trusted one of a deeper layer,
as it would if the walk ended at the first layer that has a value (how often: see the README).

Only the most recent record of a cell (group, trust, set of usable fields) can survive anywhere, and a partial aggregate on
the map side finds it. What remains of a group is bounded by the number of cells (trust levels x sets of fields) however
large the group is, so no group is gathered in one task, and the layers are those of these records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.bind import let
from pagelattice.functions.keys import strip_blanks, tag_key

#: What stands in for something not known or not yet written, in lower case.
STAND_INS = [
    "n/a", "na", "n.a.", "todo", "tbd", "tba", "tbc", "null", "none", "nil", "nan", "unknown", "undefined", "unspecified", "not known",
    "not available", "not set", "not specified", "missing", "empty", "placeholder", "pending", "to be written", "to be determined",
    "to be decided", "to be defined", "to be confirmed", "to be added", "coming soon", "fixme", "xxx", "待定", "未知", "暂无", "无", "不明", "未定", "なし",
]
#: Origins from the least to the most trusted.
ORIGINS = ["guessed", "clipped", "ingested", "reviewed"]
FIELDS = ["title", "page_type", "description", "created_on"]
#: What a canonical page has besides: selected like the fields, but not counted for a record's completeness.
TEXTS = ["content", "path"]
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def usable(c: Column) -> Column:
    """False for null, blank, text without letter or digit, and stand-ins, also in brackets; never null."""
    bare = F.lower(F.regexp_replace(strip_blanks(c), r"^[(\[<{]+\s*|\s*[)\]>}.…:]+$", ""))
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]") & ~bare.isin(STAND_INS), F.lit(False))


def trust(c: Column) -> Column:
    name = F.lower(strip_blanks(c))
    out = F.lit(0)
    for i, o in enumerate(ORIGINS, 1):
        out = F.when(name == o, i).otherwise(out)
    return out


def instant(c: Column) -> Column:
    """Microseconds since 1970 of a date in any of several notations, UTC where no offset is written; null if it is none.

    A run of 11 digits or more is epoch milliseconds, of 9 or 10 epoch seconds. Day and month names may be in either order.
    """
    s = strip_blanks(c)
    month = F.lit(None).cast("string")
    for i, m in enumerate(MONTHS, 1):
        month = F.when(F.lower(s).contains(m), f"{i:02d}").otherwise(month)
    day = F.regexp_extract(s, r"(?i)(?:^|[^\d:])(\d{1,2})(?:st|nd|rd|th)?(?=[\s,.]|$)", 1)
    named = F.concat(F.regexp_extract(s, r"(\d{4})", 1), F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"))
    parts = [F.regexp_extract(s, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", i) for i in (1, 2, 3)]
    date = F.when(parts[0] != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))).when(s.rlike(r"(?i)[a-z]{3}"), named)
    clock = F.regexp_extract(s, r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)", 1)
    clock = F.when(clock == "", "00:00:00").when(clock.rlike(r"^\d{1,2}:\d{2}$"), F.concat(clock, F.lit(":00"))).otherwise(clock)
    clock = F.when(clock.rlike(r"^\d:"), F.concat(F.lit("0"), clock)).otherwise(clock)
    offset = F.regexp_extract(s, r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*([+-]\d{2}:?\d{2})$", 1)
    offset = F.when(offset == "", "+00:00").when(offset.contains(":"), offset).otherwise(F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2)))
    when = F.unix_micros(F.try_to_timestamp(F.concat(date, F.lit(" "), clock, offset)))
    number = s.rlike(r"^\d{9,16}$")
    digits = F.when(number, s).try_cast("bigint")
    epoch = F.when(F.length(s) >= 11, digits * 1000).otherwise(digits * 1000000)
    return F.when(number, epoch).otherwise(when)


def candidates(members: DataFrame, fields: list[str], more: list[str] = ()) -> DataFrame:
    """One row per cell: ``request_id, p(trust, at, filled, turn, slug, v)``, ``v`` being the usable values. ``more``: fields that don't count in ``filled``."""
    m = members.where(F.col("request_id").isNotNull()).select(
        "request_id", "member_no", "slug", trust(F.col("origin")).alias("trust"), F.coalesce(instant(F.col("updated_on")), F.lit(-(1 << 62))).alias("at"),
        *[F.when(usable(F.col(f)), F.col(f)).alias(f"v_{f}") for f in [*fields, *more]],
    )
    has = [F.col(f"v_{f}").isNotNull().cast("int") for f in [*fields, *more]]
    cell = sum((h * (1 << i) for i, h in enumerate(has)), F.lit(0))
    values = F.struct(*[F.col(f"v_{f}").alias(f) for f in [*fields, *more]])
    turn = -F.coalesce(F.col("member_no").cast("bigint"), F.lit(1 << 40))
    best = m.groupBy("request_id", "trust", cell.alias("cell"), sum(has[: len(fields)], F.lit(0)).alias("filled")).agg(F.max(F.struct("at", turn.alias("turn"), "slug", values.alias("v"))).alias("b"))
    return best.select("request_id", F.struct("trust", "b.at", "filled", "b.turn", "b.slug", "b.v").alias("p"))


def layered(cells: DataFrame) -> DataFrame:
    """``request_id, points``: a group's records in the policy's order, best first, each with its dominance ``layer``.

    A record's layer is one more than the deepest layer of those that dominate it, and all of these stand before it.
    """
    grouped = cells.groupBy("request_id").agg(F.reverse(F.array_sort(F.collect_list("p"))).alias("points"))
    beats = lambda a, b: (a.trust >= b.trust) & (a.at >= b.at) & (a.filled >= b.filled) & ((a.trust > b.trust) | (a.at > b.at) | (a.filled > b.filled))
    none = F.array().cast("array<int>")
    above = lambda acc, p: F.zip_with(F.slice("points", F.lit(1), F.size(acc)), acc, lambda q, layer: F.when(beats(q, p), layer))
    layers = F.aggregate("points", none, lambda acc, p: F.concat(acc, F.array(F.coalesce(F.array_max(above(acc, p)), F.lit(0)) + 1)))
    both = F.zip_with("points", layers, lambda p, layer: p.withField("layer", layer))
    return grouped.select("request_id", both.alias("points"))


def survivor(field: str) -> Column:
    """Struct ``slug, value, layer`` of the record whose value of the field survives, by the walk over ``points``; null if none has one."""
    key = lambda p: F.struct(p.trust, p.at, p.filled, p.turn)
    front_first = F.array_sort(F.transform("points", lambda p: F.struct(p.layer.alias("layer"), (-p.trust).alias("t"), (-p.at).alias("a"), (-p.filled).alias("f"), (-p.turn).alias("n"), p.alias("p"))))
    able = F.filter(F.transform(front_first, lambda x: x.p), lambda p: p.v[field].isNotNull())
    taken = F.aggregate(able, F.element_at(able, 1), lambda best, p: F.when(key(p) > key(best), p).otherwise(best))
    return let(F.when(F.size(able) > 0, taken), lambda w: F.when(w.isNotNull(), F.struct(w.slug.alias("slug"), w.v[field].alias("value"), w.layer.cast("bigint").alias("layer"))))


def surviving_values(members: DataFrame, fields: list[str] = FIELDS, more: list[str] = ()) -> DataFrame:
    """``request_id, field_name, slug, value, layer``: the value that survives in each field that some member can fill, and the dominance layer that it came from.

    Defined results: a field that no member fills gives no row; an unreadable or missing date is the earliest; an unknown
    origin is the least trusted; repeated rows count once; ties go to the lowest member number; a null request is no group.
    """
    found = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), survivor(f).alias("w")) for f in [*fields, *more]]))
    return layered(candidates(members, fields, more)).select("request_id", found.alias("x")).where("x.w IS NOT NULL").select("request_id", "x.field_name", "x.w.slug", "x.w.value", "x.w.layer")


def canonical_pages(members: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """One row per request: ``request_id, canonical_slug``, the surviving fields, the surviving ``content`` and ``path``
    (those of them that ``members`` has), ``tags``: all tags united, sorted, by key, and ``deepest_layer``, the deepest
    dominance layer that a field came from (0 if there is no usable value).

    canonical_slug is the request's own, if it names a member, else the slug of the member whose title survives, else the
    lowest slug of all.
    """
    texts = [f for f in TEXTS if f in members.columns]
    every = [*fields, *texts]
    wide = layered(candidates(members, fields, texts)).select("request_id", *[survivor(f).alias(f"w_{f}") for f in every])
    deepest = F.greatest(F.lit(0).cast("bigint"), *[F.coalesce(F.col(f"w_{f}.layer"), F.lit(0).cast("bigint")) for f in every])
    tags = (
        members.select("request_id", F.explode("tags").alias("t")).where(F.col("t").isNotNull() & (tag_key(F.col("t")) != ""))
        .select("request_id", tag_key(F.col("t")).alias("t")).distinct().groupBy("request_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("t"))).alias("tags"))
    )
    slugs = members.where(F.col("request_id").isNotNull()).select("request_id", "slug", strip_blanks(F.col("canonical_slug")).alias("named")).distinct()
    named = slugs.select("request_id", "named").distinct().join(slugs.select("request_id", F.col("slug").alias("named")).distinct(), ["request_id", "named"])
    named = named.groupBy("request_id").agg(F.min("named").alias("named"))
    lowest = slugs.groupBy("request_id").agg(F.min("slug").alias("lowest"))
    out = lowest.join(named, "request_id", "left").join(wide, "request_id", "left").join(tags, "request_id", "left")
    first = F.coalesce("named", f"w_{fields[0]}.slug", "lowest") if fields else F.coalesce("named", "lowest")
    return out.select("request_id", first.alias("canonical_slug"), *[F.col(f"w_{f}.value").alias(f) for f in every], F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce(deepest, F.lit(0).cast("bigint")).alias("deepest_layer"))
