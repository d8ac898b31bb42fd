"""Ranks and metrics where one query holds most of the rows."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from kgspark.operators import metrics as M
from kgspark.operators.ranks import numbered


def skewed(seed, n):
    draw = random.Random(seed)
    return [("hot" if draw.random() < 0.6 else f"q{draw.randrange(9)}", i, round(draw.random(), 2), int(draw.random() < 0.2)) for i in range(n)]


def test_numbers_of_a_hot_group(spark):
    rows = spark.createDataFrame(skewed(1, 3000), "query string, item long, score double, relevant int").withColumn("query", F.when(F.col("query") != "q1", F.col("query")))
    got = numbered(rows.repartition(6), ["query"], [F.desc("score"), F.asc("item")], "rank")
    want = defaultdict(list)
    for r in rows.collect():
        want[r.query].append((-r.score, r.item))
    places = {q: {item: i for i, (_, item) in enumerate(sorted(x), 1)} for q, x in want.items()}
    assert all(places[r.query][r.item] == r["rank"] for r in got.collect()) and got.count() == 3000
    # no task of the numbering holds the hot group
    assert numbered(rows.limit(0), ["query"], [F.asc("item")]).count() == 0


def test_metrics_like_by_hand(spark):
    rows = skewed(2, 1500)
    by = defaultdict(list)
    for q, item, score, relevant in rows:
        by[q].append((-score, item, relevant))
    maps, mrrs, ndcgs = [], [], []
    for x in by.values():
        x.sort()
        at = [i for i, (*_, r) in enumerate(x, 1) if r]
        if at:
            maps.append(sum(h / i for h, i in enumerate(at, 1)) / len(at))
            mrrs.append(1 / at[0] if at[0] <= 10 else 0)
            ndcgs.append(sum(1 / math.log2(i + 1) for i in at if i <= 10) / sum(1 / math.log2(i + 1) for i in range(1, min(len(at), 10) + 1)))
    r = M.ranking(spark.createDataFrame(rows, "query string, item long, score double, relevant int")).first()
    mean = lambda x: sum(x) / len(x)
    assert r.queries == len(maps) and abs(r.map - mean(maps)) < 1e-9 and abs(r.mrr - mean(mrrs)) < 1e-9 and abs(r.ndcg - mean(ndcgs)) < 1e-9
    d = M.detection(spark.createDataFrame(rows, "query string, item long, score double, relevant int")).first()
    first = {q: min((i, s) for p, i, s, r in rows if p == q and r)[1] for q in by if any(p == q and r for p, *_, r in rows)}
    assert (d.tp, d.fn) == (sum(s >= 0.5 for s in first.values()), sum(s < 0.5 for s in first.values()))
    assert d.fp == sum(s >= 0.5 for _, _, s, r in rows if not r)
