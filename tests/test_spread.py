"""Work that is dear by the row isn't left to the one split of a small table."""

import os

import pytest
from pyspark.sql import functions as F

from kgspark.functions import parsers as P
from kgspark.functions.text import strip
from kgspark.operators import container as C
from kgspark.plans import generation as G
from kgspark.plans import texts as X
from kgspark.sources import readers as R

SF = os.environ.get("KGSPARK_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_small_tables_are_dealt_out(spark):
    assert X.part_lines(spark, SF).rdd.getNumPartitions() >= 4
    assert G.generated_definitions(spark, SF).rdd.getNumPartitions() >= 4


def test_the_container_is_read_once(spark):
    plan = C.index_candidates(X.container_of(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_generated_objects_keep_the_first_of_equal_keys(spark):
    text = '[{"entity":" a ","type":"1"}, {"entity":"b"}, {"entity":"a","type":"2"}, 5, {"entity":"c","type":"3"}]'
    rows = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select(P.parse_generated("t", ["entity", "type"]).alias("x"))
    assert [[tuple(o) for o in r.x] for r in rows.collect()] == [[("a", "1"), ("c", "3")], [], []]


ODD_LINES = [
    '<a> <b> "c" .', '  <a>\t<b> "c d . e"@en .\n', "# <a> <b> <c> .", " # x y z .", "", None, "a b .", "a b c", "a  b  . .", '<a> <b> "x\ny" .', "a b c .\r\n", "a b c .\u0085", "a b c . ", "a\nb\nc .",
    "\va\fb c .", "a b $1 \\1 .", "a b c . d", "a b c. .", " a b c .\u0085 ", "a b é\u0085z .",
]


def test_odd_lines_are_parsed_like_group_by_group(spark):
    rows = spark.createDataFrame([(x,) for x in ODD_LINES], "value string")
    groups = rows.where(F.col("value").rlike(R.NT) & ~F.col("value").rlike(r"^\s*#")).select(*[F.regexp_extract("value", R.NT, i + 1).alias(c) for i, c in enumerate("spo")])
    want = sorted(map(tuple, groups.collect()))
    assert sorted(map(tuple, R.parse_nt(rows).collect())) == want and len(want) >= 8


def test_conditions_on_terms_do_not_repeat_the_parsing(spark):
    parts = X.container_of(spark, SF).where("identifier LIKE 'http://kg/part/%' AND identifier <> 'x'")
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    # once for each of the three kinds of elements, and not in the conditions
    assert plan.count("regexp_replace(") - plan.count('(?<=")@en$') <= 3 and plan.count("regexp_extract(") <= 2 * 3
    assert not any("regexp_" in line or "RLIKE" in line for line in plan.splitlines() if "+- Filter" in line or ":- Filter" in line)


def test_strip_takes_white_space_from_both_ends(spark):
    texts = ["", " ", "a", " \t\n\v\f\ra b\r\f\v\n\t ", "\u0085a\u0085", " a ", " a", "\x1ca\x1f", None, "a\n\nb\n"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(strip(F.col("x")).alias("a"), F.regexp_replace("x", r"^[\s]+|[\s]+$", "").alias("b")).collect()
    assert all(r.a == r.b for r in rows)
