import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from kgspark.llm import middle as M
from kgspark.llm import queries as Q


def by_hand(doc_id, text):
    """The arrangement of one text, from the contract's words."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, mid, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{mid}"


NASTY = ["<P", "<S", "<M", "P>", "<", "<<", "><P", "a<S>b", "<M>", "<P>x", "\n\r \x85", "\U0001f600" * 50, "é" * 20, "|]*.\\", "日本" * 9]


@pytest.fixture(scope="module")
def nasty(spark):
    rows = [(100 * k + i, text * (1 + k % 3)) for k in range(12) for i, text in enumerate(NASTY)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_odd_rows(odd, empty):
    made = M.arranged(odd).withColumn("back", M.restored(F.col("output"), F.col("form")))
    assert set(odd.columns) < set(made.columns) and made.count() == odd.count()
    for r in made.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert M.arranged(empty).count() == M.digests(empty).count() == 0


def test_sentinels_and_code_points(nasty):
    made = M.arranged(nasty).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in made} == {"plain", "spm", "psm"}
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text)
        assert r.back == r.text


def test_clashing_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, "abc", "x", 9)], "doc_id long, text string, output string, __units int")
    made = M.arranged(rows).first()
    assert made.output == by_hand(1, "abc")[-1] and made["__units"] == 9


def test_built_in_functions_only(spark, sf):
    plan = Q.op12_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("regexp_extract_all") == 1


def test_query_like_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(Q.OP12)
    names = [d[0] for d in want.description]
    got = Q.op12_fill_in_middle(spark, sf)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
