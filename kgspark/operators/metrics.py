"""Ranking, detection and retrieval metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.ranks import numbered
from kgspark.session import cut


def ranking(rows: DataFrame, k: int = 10) -> DataFrame:
    """``(queries, map, mrr, ndcg)`` over (query, item, score, relevant 0/1).

    Ranks by score, ties by item. MRR and nDCG look at the first ``k``; queries without a relevant item don't count. Ranks are numbers of rows dealt by range, and a relevant row's
    number among its query's relevant rows is how many were found by then: no task holds a query, and only relevant rows are numbered twice.
    """
    ranked = numbered(cut(rows.select("query", "item", "score", "relevant")), ["query"], [F.desc("score"), F.asc("item")], "rank")
    found = numbered(cut(ranked.where("relevant = 1").select("query", "rank")), ["query"], [F.asc("rank")], "hits")
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    each = found.groupBy("query").agg(F.count("*").alias("n"), F.sum(F.col("hits") / F.col("rank")).alias("ap"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.element_at(F.array(*[F.lit(sum(1 / math.log2(i + 2) for i in range(n + 1))) for n in range(k)]), F.least("n", F.lit(k)).cast("int"))
    return each.agg(
        F.count("*").alias("queries"), F.avg(F.col("ap") / F.col("n")).alias("map"), F.avg(F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0)).alias("mrr"),
        F.avg(F.col("dcg") / ideal).alias("ndcg"),
    )


def detection(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(tp, fp, fn, precision, recall, f1)`` of scores at a threshold; only a query's first relevant item counts as positive, of equal ones that of the lowest score."""
    from kgspark.operators.evaluation import prf

    said = lambda c: F.coalesce(c >= threshold, F.lit(False))
    first = rows.where("relevant = 1").groupBy("query").agg(F.min(F.struct("item", "score")).alias("x"))
    truth = first.agg(F.count_if(said(F.col("x.score"))).alias("tp"), F.count_if(~said(F.col("x.score"))).alias("fn"))
    other = rows.where("relevant = 0").agg(F.count_if(said(F.col("score"))).alias("fp"))
    return prf(truth.join(F.broadcast(other)).select("tp", "fp", "fn"))  # a row each


def score_ranges(rows: DataFrame) -> DataFrame:
    """Smallest, mean and largest score of relevant and other items."""
    return rows.groupBy("relevant").agg(F.min("score").alias("least"), F.avg("score").alias("mean"), F.max("score").alias("most"), F.count("*").alias("items"))


def pairwise_accuracy(rows: DataFrame) -> DataFrame:
    """Share of rows whose positive scores at least as high as the negative."""
    return rows.agg(F.coalesce(F.avg((F.col("positive_score") >= F.col("negative_score")).cast("double")), F.lit(0.0)).alias("accuracy"))


def relevant_documents(rows: DataFrame) -> DataFrame:
    """``(query, documents)``: sorted distinct ids of a query's relevant documents; ids are dense numbers of texts in first-seen order."""
    first = rows.groupBy("text").agg(F.min("pos").alias("seen"))
    return rows.join(first, "text").groupBy("query").agg(F.sort_array(F.collect_set("seen")).alias("documents"))


def info_nce(rows: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Mean contrastive loss of (query, score, positive 0/1): log-sum-exp of scores less the positive's; sums are partial, no query's scores are gathered."""
    s = F.col("score") / temperature
    top = rows.groupBy("query").agg(F.max(s).alias("top"), F.max(F.when(F.col("positive") == 1, s)).alias("own"))
    each = rows.join(top, "query").groupBy("query", "top", "own").agg(F.sum(F.exp(s - F.col("top"))).alias("sum"))
    return each.agg(F.avg(F.col("top") + F.log("sum") - F.col("own")).alias("loss"))
