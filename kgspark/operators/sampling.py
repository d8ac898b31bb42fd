"""Dataset builders: negatives, splits, pairs. All draws are hashes of ids and a seed, so that reruns and other plans agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier and modulus of the arithmetic draw, which SQL engines agree on.
MULTIPLIER, MODULUS = 2_654_435_761, 2_147_483_647


def draw(*ids: Column, seed: int = 0) -> Column:
    """A pseudo-random long from integer ids, by modular arithmetic that any engine can repeat."""
    value = F.lit(seed + 1).cast("long")
    for x in ids:
        value = F.pmod(F.pmod(value * 31 + F.pmod(x.cast("long"), F.lit(MODULUS)) + 7, F.lit(MODULUS)) * MULTIPLIER, F.lit(MODULUS))
    return value


def negatives(queries: DataFrame, pool: DataFrame, positives: DataFrame, per_positive: int = 1, seed: int = 0) -> DataFrame:
    """``(query_id, positive_id, cand_id)``: ``per_positive`` elements of the pool for each positive, never one of the query's positives.

    ``queries`` is (query_id, n), n positives each; ``pool`` is (cand_id, pos), pos a dense number; ``positives`` (query_id, positive_id, i). Each
    query draws places in the pool, about twice as many as needed, so the pool is never crossed with queries.
    """
    size = pool.count()
    want = F.col("n") * per_positive
    drawn = queries.select("query_id", "n", F.explode(F.sequence(F.lit(0), 2 * want + 7)).alias("k")).withColumn("pos", F.pmod(draw(F.col("query_id"), F.col("k"), seed=seed), F.lit(size)))
    got = drawn.join(pool, "pos").groupBy("query_id", "n", "cand_id").agg(F.min("k").alias("k"))
    free = got.join(positives.select("query_id", F.col("positive_id").alias("cand_id")), ["query_id", "cand_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("k")) - 1
    return (
        free.withColumn("r", rank).where(F.col("r") < want)
        .withColumn("i", F.floor(F.col("r") / per_positive).cast("int"))
        .join(positives, ["query_id", "i"]).select("query_id", "positive_id", "cand_id")
    )


def split(df: DataFrame, *ids: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``split`` by hash buckets of a thousand; stable whatever the plan."""
    bucket = F.pmod(draw(*[F.col(i) for i in ids], seed=seed), F.lit(1000))
    out, upto = F.lit(None).cast("string"), 0.0
    for name, share in shares.items():
        out = F.when(out.isNull() & (bucket < round(1000 * (upto + share))), name).otherwise(out) if upto else F.when(bucket < round(1000 * share), name)
        upto += share
    return df.withColumn("split", F.coalesce(out, F.lit(next(reversed(shares)))))


def one_of_each(df: DataFrame, by: str, *ids: str, seed: int = 0) -> DataFrame:
    """One pseudo-random row for each value of ``by``; rows of equal ids go by their other columns."""
    rest = [c for c in df.columns if c != by and c not in ids]
    w = Window.partitionBy(by).orderBy(draw(*[F.col(i) for i in ids], seed=seed), *ids, *rest)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def with_none_case(rows: DataFrame, share: float = 0.25, seed: int = 0) -> DataFrame:
    """Each example ``(mention_id, gold, candidates)`` with its label; a share of them also without the gold candidate, labelled ``None``.

    Where the candidates don't hold the gold one the label is ``None``.
    """
    label = F.when(F.array_contains("candidates", F.col("gold")), F.col("gold"))
    again = F.pmod(draw(F.col("mention_id"), seed=seed), F.lit(1000)) < round(1000 * share)
    first = F.struct(F.col("candidates").alias("candidates"), label.alias("label"))
    second = F.struct(F.array_except("candidates", F.array("gold")).alias("candidates"), F.lit(None).cast(rows.schema["gold"].dataType).alias("label"))
    cases = F.explode(F.when(again & label.isNotNull(), F.array(first, second)).otherwise(F.array(first)))
    return rows.select("mention_id", "gold", cases.alias("x")).select("mention_id", "gold", "x.candidates", "x.label")


def gold_in_candidates(rows: DataFrame, most: int = 10) -> DataFrame:
    """The gold candidate appended where it is missing, then the first ``most``; examples that lose it by that are dropped."""
    full = F.when(F.array_contains("candidates", F.col("gold")), F.col("candidates")).otherwise(F.concat("candidates", F.array("gold")))
    return rows.withColumn("candidates", F.slice(full, 1, most)).where(F.array_contains("candidates", F.col("gold")))


def mention_pairs(mentions: DataFrame, hard: DataFrame, positives: int = 10, per_negative: int = 2, negatives_: int = 10) -> DataFrame:
    """``(qid, query, other, label)``: neighbours among a qid's mentions as positives, mentions of its hard negatives as negatives.

    ``mentions`` is (qid, mention_id), ``hard`` (qid, neg_qid, rank). At most ``positives`` pairs of a qid, ``per_negative`` mentions of
    each of its first ``negatives_`` negatives.
    """
    w = Window.partitionBy("qid").orderBy("mention_id")
    pos = (
        mentions.withColumn("other", F.lead("mention_id").over(w)).withColumn("i", F.row_number().over(w))
        .where(F.col("other").isNotNull() & (F.col("i") <= positives)).select("qid", F.col("mention_id").alias("query"), "other", F.lit(1).alias("label"))
    )
    first = mentions.groupBy("qid").agg(F.min("mention_id").alias("query"))
    few = mentions.withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_negative).select(F.col("qid").alias("neg_qid"), F.col("mention_id").alias("other"))
    known = hard.join(mentions.select(F.col("qid").alias("neg_qid")).distinct(), "neg_qid", "left_semi")
    top = known.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "neg_qid"))).where(F.col("i") <= negatives_)
    neg = top.join(few, "neg_qid").join(first, "qid").select("qid", "query", "other", F.lit(0).alias("label"))
    return pos.unionAll(neg)


def chunks_of(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Round-robin chunk numbers of dense ids."""
    return df.withColumn("chunk", F.pmod(id_col, F.lit(n)))


def long_format(rows: DataFrame) -> DataFrame:
    """``(query, text, label)`` of (query, positive, negatives)."""
    pairs = F.concat(
        F.array(F.struct(F.col("positive").alias("text"), F.lit(1).alias("label"))), F.transform("negatives", lambda n: F.struct(n.alias("text"), F.lit(0).alias("label")))
    )
    return rows.select("query", F.explode(pairs).alias("x")).select("query", "x.text", "x.label")


def false_negative_mask(batch: DataFrame) -> DataFrame:
    """``(row, other, masked)`` for the labels of a training batch ``(batch_id, row, label, positives)``.

    Another row's label that is among a row's positives mustn't count as its negative; the diagonal stays. Batches have a fixed size.
    """
    other = batch.select("batch_id", F.col("row").alias("other"), F.col("label").alias("other_label"))
    return batch.join(other, "batch_id").select("batch_id", "row", "other", (F.array_contains("positives", F.col("other_label")) & (F.col("row") != F.col("other"))).alias("masked"))
