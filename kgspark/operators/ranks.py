"""Numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.session import cut


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 ... within each group of the columns ``by``, in ``order``.

    Rows are dealt by range over group and order, so a group that holds most of the rows is spread over many partitions; each partition numbers its
    slice of a group, and slices are offset by the sizes of those before them. No task holds a group, nothing is broadcast or collected.
    Rows that are equal in ``order`` get different numbers in no particular order; null groups are groups; no rows give no rows. ``rows`` should be
    cheap to read twice (a table or a cut frame).
    """
    group, tie, part, size = "__n_group", "__n_tie", "__n_part", "__n_size"
    tagged = rows.withColumn(tie, F.monotonically_increasing_id()).withColumn(group, F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in by]))
    dealt = cut(tagged.repartitionByRange(F.col(group), *order, F.col(tie)).withColumn(part, F.spark_partition_id()))
    # one row for each group and each partition that has rows of it
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part, group).agg(F.count("*").alias(size)).select(part, group, F.coalesce(F.sum(size).over(before), F.lit(0)).alias("__n_start"))
    inner = F.row_number().over(Window.partitionBy(part, group).orderBy(*order, tie))
    return dealt.withColumn("__n_in", inner).join(starts.hint("merge"), [part, group]).withColumn(name, F.col("__n_start") + F.col("__n_in")).drop(tie, part, group, "__n_start", "__n_in")
