"""Ranking with ties within groups: distributed multi-select over pairs.

A row's pair is encoded as one whole number, smaller for earlier places. The places that count end at some pair of each group; a binary search finds it for
all groups at once. A pass counts each group's distinct pairs up to seven numbers that cut what is left into eighths, exactly, and so halves it three times. Only rows up
to the cut that is found are then sorted, by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import unused
from kgspark.operators.ranks import numbered
from kgspark.session import cut


def encoded(rows: DataFrame, larger: Column, smaller: Column, name: str) -> tuple[DataFrame, int]:
    """``rows`` with the pair of the whole numbers ``larger`` (descending) and ``smaller`` (ascending) as one number from 0 on, and the size of that space.

    Nulls come behind all values of their column and equal each other. One pass finds the bounds; four numbers reach the driver.
    """
    x = rows.agg(F.max(larger).alias("top"), F.min(larger).alias("bottom"), F.min(smaller).alias("low"), F.max(smaller).alias("high")).first()
    top, low = int(x.top or 0), int(x.low or 0)
    spans = top - int(x.bottom or 0) + 2, int(x.high or 0) - low + 2
    space = spans[0] * spans[1]
    whole = "long" if space < 1 << 61 else "decimal(38,0)"
    place = lambda value, last: F.coalesce(value.cast(whole), F.lit(last - 1).cast(whole))
    exact = "decimal(38,0)"
    first = place(F.lit(top).cast(exact) - larger.cast(exact), spans[0])
    second = place(smaller.cast(exact) - F.lit(low).cast(exact), spans[1])
    return rows.withColumn(name, (first * F.lit(spans[1]).cast(whole) + second).cast(whole)), space


#: Parts into which a pass cuts what is left of a group's codes.
PARTS = 8


def cuts(pairs: DataFrame, by: list[str], code: str, space: int, places: int) -> DataFrame:
    """``(group, cut)``: for each group the code of its ``places``-th distinct pair, or of its last if it has fewer.

    ``pairs`` holds each group's distinct codes once, with the struct ``group`` of ``by``. The passes needed follow from ``space``, the range of the codes; groups that are decided leave the search.
    A pass joins by the struct and counts by its fields, so the counts are partial before they are shuffled, and a group of very many pairs can be split.
    """
    kind = pairs.schema[code].dataType.simpleString()
    fields = [F.col(f"group.`{c}`").alias(c) for c in by]
    again = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in by]).alias("group")
    state = cut(
        pairs.groupBy("group").agg(F.min(code).alias("lo"), F.max(code).alias("hi"), F.count("*").alias("there"))
        .select("group", "lo", "hi", F.least("there", F.lit(places)).alias("wanted"), (F.col("there") <= places).alias("whole"))
    )
    done = [state.where("whole OR lo = hi").select("group", F.col("hi").alias("cut"))]
    left = state.where("NOT whole AND lo < hi").drop("whole")
    middle = lambda j: F.least(F.col("lo") + F.col("step") * F.lit(j).cast(kind) - F.lit(1).cast(kind), F.col("hi")).cast(kind)
    for _ in range(space.bit_length()):
        if left.isEmpty():
            break
        stepped = left.withColumn("step", (F.floor((F.col("hi") - F.col("lo")) / PARTS) + 1).cast(kind))
        counts = [F.count_if(F.col(code) <= middle(j)).alias(f"seen{j}") for j in range(1, PARTS)]
        seen = pairs.select("group", code).join(stepped.hint("merge"), "group").select(*fields, code, "lo", "hi", "step", "wanted").groupBy(*by, "lo", "hi", "step", "wanted").agg(*counts)
        hi, lo = F.col("hi"), middle(PARTS - 1) + F.lit(1).cast(kind)
        for j in reversed(range(1, PARTS)):
            enough = F.col(f"seen{j}") >= F.col("wanted")
            hi = F.when(enough, middle(j)).otherwise(hi)
            lo = F.when(enough, middle(j - 1) + F.lit(1).cast(kind) if j > 1 else F.col("lo")).otherwise(lo)
        state = cut(seen.select(again, F.least(lo, hi).cast(kind).alias("lo"), hi.cast(kind).alias("hi"), "wanted"))
        done.append(state.where("lo = hi").select("group", F.col("hi").alias("cut")))
        left = state.where("lo < hi")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def first_places(rows: DataFrame, by: list[str], larger: Column, smaller: Column, order: list[str], places: int = 5) -> DataFrame:
    """The rows whose place within their group is at most ``places``, with ``pos``, ``place`` and ``tied``.

    The columns ``by`` make groups, nulls among them. ``place`` is 1 plus the number of the group's distinct earlier pairs (``larger`` descending, then ``smaller`` ascending, whole
    numbers, nulls last and equal), ``tied`` the number of the group's rows with the same pair, and ``pos`` counts from 1 in order of pairs and then of
    ``order``, ascending, nulls last. Equal rows are rows of their own; no rows give no rows; other columns stay, but for those of the three names.

    Rows are counted by group and pair before anything is shuffled. No group meets in one task, however large: what is joined by group can be split, and what is
    left is dealt by range. Nothing that grows with the rows is broadcast or collected.
    """
    rows = rows.drop("pos", "place", "tied")
    group, code = unused("__group", rows.columns), unused("__code", rows.columns)
    coded, space = encoded(rows, larger, smaller, code)
    others = [c for c in rows.columns if c not in by]
    coded = coded.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in by]).alias(group), code, *[F.col(f"`{c}`") for c in others])
    pairs = cut(coded.groupBy(F.col(group).alias("group"), F.col(code).alias("code")).agg(F.count("*").alias("tied")))
    w = Window.partitionBy("group").orderBy("code")  # at most ``places`` rows a group
    best = pairs.join(cuts(pairs, by, "code", space, places).hint("merge"), "group").where("code <= cut").select(F.col("group").alias(group), F.col("code").alias(code), "tied", F.row_number().over(w).cast("long").alias("place"))
    kept = cut(coded.join(cut(best).hint("merge"), [group, code]))
    ranked = numbered(kept, [group], [F.asc(code), *[F.asc_nulls_last(c) for c in order]])
    return ranked.select(*[F.col(f"{group}.`{c}`").alias(c) if c in by else F.col(f"`{c}`") for c in rows.columns], "pos", "place", "tied")


def sale_line_places(lines: DataFrame, places: int = 5, share: int = 5) -> DataFrame:
    """``first_places`` of sale lines by vendor, part (item modulo 2) and month shipped; see there for ties, nulls, repeats and empty tables.

    Lines whose sale's number, as text, has a crc32 divisible by ``share`` are one group, whose three columns are -1. A missing item or date is part or month -1;
    a discount that isn't a number counts as missing.
    """
    pooled = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % share == 0, F.lit(False))
    own = lambda c: F.when(pooled, F.lit(-1)).otherwise(c).cast("long")
    shipped = F.col("shipped_at")
    rows = lines.select(
        own(F.col("vendor_id")).alias("vendor_id"), own(F.coalesce(F.col("item_id") % 2, F.lit(-1))).alias("part"),
        own(F.coalesce(100 * F.year(shipped) + F.month(shipped), F.lit(-1))).alias("month"), F.col("sale_id").cast("long"), F.col("line_no").cast("long"),
        F.col("quantity").cast("long"), F.floor(100 * F.nanvl("discount", F.lit(None).cast("double")) + 0.5).cast("long").alias("percent"),
        F.floor(100 * F.nanvl("amount", F.lit(None).cast("double")) + 0.5).cast("long").alias("amount_cents"),
    )
    found = first_places(rows, ["vendor_id", "part", "month"], F.floor(F.col("quantity") / 10), F.col("percent"), ["sale_id", "line_no", "quantity", "amount_cents"], places)
    return found.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")
