"""Ordered folds over streams: what earlier micro-batches added is the store from which the next one goes on.

A micro-batch is folded in rounds over all its rows, as in batches (``operators.ordered``), so no key and no collection is one task. What batch N adds to
the store lies below ``store/batch=N`` and is never written again by others; a batch reads the additions of smaller numbers alone. So a batch that is
run again after a failure starts from the same store, overwrites its own folders only and gives the same rows, and a stream that is started again from
its checkpoint goes on where it was. Results lie below ``out/batch=N``.

Documents have to arrive in order: the fold is the one over all rows if every batch's documents come before those of the next. Within a batch any order will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.operators import ordered as O

RELATIONS = "label string, embedding array<double>, ord long"
ENTITIES = "number long, embedding array<double>, ord long, founds boolean"
Candidates = Callable[[DataFrame], DataFrame]


def stored(spark: SparkSession, path: str, ddl: str, before: int) -> DataFrame:
    """What batches smaller than ``before`` added, with their number as ``batch``; nothing where nothing was written yet."""
    try:
        return spark.read.schema(f"{ddl}, batch long").parquet(f"{path}/store").where(F.col("batch") < before)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{ddl}, batch long")


def _in_order(store: DataFrame) -> DataFrame:
    """The store with one number over batches as ``ord``; a batch has fewer than 2^40 rows."""
    return store.withColumn("ord", F.shiftleft("batch", 40) + F.col("ord")).drop("batch")


def _started(rows: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fold_relations(rows: DataFrame, opened: DataFrame, number: int, path: str, threshold: float) -> None:
    """One batch of ``canonicalize_stream``."""
    spark = rows.sparkSession
    base = opened.select("label", "embedding", F.lit(-1).cast("long").alias("ord"))
    out, added = O.canonicalize_on(rows, base.unionAll(_in_order(stored(spark, path, RELATIONS, number))), threshold)
    out.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    added.write.mode("overwrite").parquet(f"{path}/store/batch={number}")


def canonicalize_stream(rows: DataFrame, opened: DataFrame, path: str, threshold: float, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the strict fold over a stream of (doc_id, pos, rel, embedding); ``opened`` (label, embedding) is there from the start.

    Its results are those of ``canonicalize_ordered`` over all rows. Repeated rows are relations of their own, a relation without a vector matches nothing.
    """
    return _started(rows, lambda df, number: fold_relations(df, opened, number, path, threshold), checkpoint, trigger)


def fold_entities(rows: DataFrame, candidates: Candidates | None, number: int, path: str, threshold: float, kg_threshold: float) -> None:
    """One batch of ``link_stream``."""
    store = stored(rows.sparkSession, path, ENTITIES, number)
    start = store.where("founds").count()
    out, added = O.nil_fold_on(rows, _in_order(store).drop("founds"), start, threshold, candidates and candidates(rows), kg_threshold)
    out.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    added.write.mode("overwrite").parquet(f"{path}/store/batch={number}")


def link_stream(rows: DataFrame, path: str, threshold: float, checkpoint: str, candidates: Candidates | None = None, kg_threshold: float = 0.5, **trigger) -> StreamingQuery:
    """Start sequential linking over a stream of (doc_id, ent_pos, embedding).

    ``candidates`` gives a batch's KG candidates (doc_id, ent_pos, cand_id, score). The results are those of ``nil_fold`` over all rows; a document has to be in one batch as a whole.
    """
    return _started(rows, lambda df, number: fold_entities(df, candidates, number, path, threshold, kg_threshold), checkpoint, trigger)
