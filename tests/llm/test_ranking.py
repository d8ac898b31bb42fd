import datetime as dt
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kgspark.llm import queries as Q
from kgspark.llm import ranking as R
from kgspark.operators.ranks import numbered

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp, pos string, tied int, cut int"
INF = float("inf")


def by_hand(rows, places=5):
    """Places from the contract's words, one group at a time."""
    groups = defaultdict(list)
    for sale, line, item, vendor, quantity, amount, discount, _, shipped, *_ in rows:
        key = (vendor, -1 if item is None else int(math.fmod(item, 2)), -1 if shipped is None else 100 * shipped.year + shipped.month)
        if sale is not None and zlib.crc32(str(sale).encode()) % 5 == 0:
            key = (-1, -1, -1)
        percent = None if discount is None else math.floor(100 * discount + 0.5)
        cents = None if amount is None else math.floor(100 * amount + 0.5)
        last = lambda x: INF if x is None else x
        pair = (INF if quantity is None else -(quantity // 10), last(percent))
        groups[key].append((pair, tuple(map(last, (sale, line, quantity, cents))), (sale, line, quantity, percent, cents)))
    out = []
    for key, lines in groups.items():
        lines.sort(key=lambda x: x[:2])
        pairs = sorted({x[0] for x in lines})
        for pos, (pair, _, (sale, line, quantity, percent, cents)) in enumerate(lines, 1):
            if (place := pairs.index(pair) + 1) <= places:
                out.append((*key, pos, place, sale, line, quantity, percent, cents, sum(x[0] == pair for x in lines)))
    return sorted(out, key=str)


def lines(seed, n, wide=False):
    draw = random.Random(seed)
    maybe = lambda x: None if draw.random() < 0.05 else x
    rows = []
    for _ in range(n):
        quantity = draw.randint(-(10**9), 10**9) if wide else draw.randint(1, 50)
        discount = draw.uniform(-1e15, 1e15) if wide else draw.randint(0, 10) / 100
        rows.append((
            maybe(draw.randint(0, 60)), maybe(draw.randint(1, 7)), maybe(draw.randint(-3, 9)), maybe(draw.choice([1, 1, 1, 2, 3])), maybe(quantity), maybe(draw.randint(1, 9000) / 7), maybe(discount),
            "kept", maybe(dt.datetime(2024, draw.randint(1, 2), draw.randint(1, 28))), "x", 7, 8,
        ))
    return rows + rows[: n // 10] * 2


@pytest.mark.parametrize("seed, n, wide", [(1, 400, False), (2, 900, False), (3, 300, True), (4, 1, False)])
def test_like_sorting_each_group(spark, seed, n, wide):
    rows = lines(seed, n, wide)
    got = R.sale_line_places(spark.createDataFrame(rows, LINES)).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)


def test_empty_and_all_null(spark):
    assert R.sale_line_places(spark.createDataFrame([], LINES)).count() == 0
    rows = [(None,) * 12] * 7
    got = R.sale_line_places(spark.createDataFrame(rows, LINES)).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)


def test_other_columns_stay_and_names_may_clash(spark):
    rows = spark.createDataFrame([(1, 5, 1, "a", "g"), (1, 5, 2, "b", "h"), (2, None, None, "c", None)], "k long, x long, y long, place string, cut string")
    got = R.first_places(rows, ["k"], F.col("x"), F.col("y"), ["cut"], 1)
    assert got.columns == ["k", "x", "y", "cut", "pos", "place", "tied"]
    assert sorted(map(tuple, got.collect())) == [(1, 5, 1, "g", 1, 1, 1), (2, None, None, None, 1, 1, 1)]


def test_searches_of_many_pairs(spark):
    """Groups of different sizes end at different passes."""
    rows = [(g, 10 * i, i % 7) for g in range(12) for i in range(g * g)]
    got = R.first_places(spark.createDataFrame(rows, "g long, x long, y long"), ["g"], F.col("x"), F.col("y"), [], 3).collect()
    want = [(g, 10 * i, i % 7, pos, pos, 1) for g in range(12) for pos, i in enumerate(sorted(range(g * g), reverse=True)[:3], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_numbers_of_one_large_group(spark):
    rows = spark.range(5000).selectExpr("if(id % 10 < 8, null, id % 3) AS g", "id * 7919 % 5000 AS x")
    got = defaultdict(list)
    for r in numbered(rows.repartition(5), ["g"], [rows["x"].asc()]).collect():
        got[r.g].append((r.pos, r.x))
    assert len(got) == 4
    for pairs in got.values():
        pairs.sort()
        assert [p for p, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [x for _, x in pairs] == sorted(x for _, x in pairs)


def test_query_like_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sale_lines AS SELECT * FROM '{sf}/sale_lines.parquet'")
    want = con.execute(Q.OP11)
    names = [d[0] for d in want.description]
    got = Q.op11_ranking(spark, sf)
    assert got.columns == names and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
