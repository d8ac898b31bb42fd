"""Gold and system graphs derived from orders and lineitem, and the queries that score them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.names import GOLD_PREFIX
from kgspark.names import NEW_PREFIX as NEW
from kgspark.operators import evaluation as E
from kgspark.plans.registry import query, table



def gold(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    order = F.concat(F.lit("order:"), F.col("k"))
    o = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    placed = o.select(
        (F.col("k") % 500).alias("doc_id"),
        F.when(F.col("c") % 5 == 0, F.concat(F.lit("_:c"), F.col("c"))).otherwise(F.concat(F.lit("cust:"), F.col("c"))).alias("s"),
        F.lit("placed").alias("p"), order.alias("o"),
    )
    li = li.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("t"), F.col("l_linenumber").alias("n"))
    supplied = li.select(
        (F.col("k") % 500).alias("doc_id"), order.alias("s"), F.lit("supplied_by").alias("p"),
        F.when(F.col("u") % 4 == 0, F.concat(F.lit("_:s"), F.col("u"))).otherwise(F.concat(F.lit("supp:"), F.col("u"))).alias("o"),
    )
    parts = li.select(
        (F.col("k") % 500).alias("doc_id"), order.alias("s"), F.when(F.col("n") == 1, "_:r1").otherwise("has_part").alias("p"), F.concat(F.lit("part:"), F.col("t")).alias("o")
    )
    return placed.unionAll(supplied).unionAll(parts)


def system(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    k, order = F.col("k"), F.concat(F.lit("order:"), F.col("k"))
    new = lambda kind, n: F.concat(F.lit(f"{NEW}{kind}/"), n.cast("string"))
    o = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).where("k % 7 <> 0")
    placed = o.select(
        "k", F.when(F.col("c") % 5 == 0, new("entities", (F.col("c") + k % 3) % 37)).otherwise(F.concat(F.lit("cust:"), F.col("c"))).alias("s"),
        F.when(k % 11 == 0, "ordered").otherwise("placed").alias("p"), order.alias("o"),
    )
    li = li.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("t"), F.col("l_linenumber").alias("n")).where("k % 7 <> 0")
    supplied = li.select(
        "k", order.alias("s"), F.lit("supplied_by").alias("p"),
        F.when(F.col("u") % 4 == 0, new("entities", 100 + (F.col("u") + k % 3) % 13)).otherwise(F.concat(F.lit("supp:"), F.col("u"))).alias("o"),
    )
    parts = li.select(
        "k", order.alias("s"), F.when(F.col("n") == 1, new("relations", k % 2)).otherwise("has_part").alias("p"), F.concat(F.lit("part:"), F.col("t")).alias("o")
    )
    rows = placed.unionAll(supplied).unionAll(parts)
    twice = F.explode(F.when(k % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select((k % 500).alias("doc_id"), "s", "p", "o", twice.alias("copy")).drop("copy")


GOLD_SQL = """gold0 AS (
  SELECT o_orderkey % 500 AS doc_id, CASE WHEN o_custkey % 5 = 0 THEN '_:c' || o_custkey ELSE 'cust:' || o_custkey END AS s, 'placed' AS p, 'order:' || o_orderkey AS o FROM orders
  UNION ALL SELECT l_orderkey % 500, 'order:' || l_orderkey, 'supplied_by', CASE WHEN l_suppkey % 4 = 0 THEN '_:s' || l_suppkey ELSE 'supp:' || l_suppkey END FROM lineitem
  UNION ALL SELECT l_orderkey % 500, 'order:' || l_orderkey, CASE WHEN l_linenumber = 1 THEN '_:r1' ELSE 'has_part' END, 'part:' || l_partkey FROM lineitem
)"""
SYSTEM_SQL = f"""system1 AS (
  SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 = 0 THEN '{NEW}entities/' || (o_custkey + o_orderkey % 3) % 37 ELSE 'cust:' || o_custkey END AS s,
    CASE WHEN o_orderkey % 11 = 0 THEN 'ordered' ELSE 'placed' END AS p, 'order:' || o_orderkey AS o FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT l_orderkey, 'order:' || l_orderkey, 'supplied_by', CASE WHEN l_suppkey % 4 = 0 THEN '{NEW}entities/' || (100 + (l_suppkey + l_orderkey % 3) % 13) ELSE 'supp:' || l_suppkey END FROM lineitem WHERE l_orderkey % 7 <> 0
  UNION ALL SELECT l_orderkey, 'order:' || l_orderkey, CASE WHEN l_linenumber = 1 THEN '{NEW}relations/' || (l_orderkey % 2) ELSE 'has_part' END, 'part:' || l_partkey FROM lineitem WHERE l_orderkey % 7 <> 0
), system0 AS (
  SELECT k % 500 AS doc_id, s, p, o FROM system1 UNION ALL SELECT k % 500, s, p, o FROM system1 WHERE k % 13 = 0
)"""


def _split(name: str, source: str, prefix: str) -> str:
    cols = ", ".join(
        f"CASE WHEN starts_with({c}, '{prefix}') THEN substr({c}, {len(prefix) + 1}) ELSE {c} END AS {c}, starts_with({c}, '{prefix}') AS {c}b" for c in "spo"
    )
    return f"{name} AS MATERIALIZED (SELECT DISTINCT doc_id, {cols} FROM {source})"


BASE_SQL = f"{GOLD_SQL}, {SYSTEM_SQL}, {_split('g', 'gold0', GOLD_PREFIX)}, {_split('y', 'system0', NEW)}"


def pairs_sql(local: bool) -> str:
    d = "doc_id, " if local else ""
    return f"""pairs AS (
  SELECT {d}gold_blank, system_blank, count(*) AS n FROM (
    SELECT g.doc_id, g.s AS gold_blank, y.s AS system_blank FROM g JOIN y ON g.doc_id = y.doc_id AND g.p = y.p AND g.o = y.o WHERE g.sb AND y.sb AND NOT y.pb AND NOT y.ob
    UNION ALL SELECT g.doc_id, g.p, y.p FROM g JOIN y ON g.doc_id = y.doc_id AND g.s = y.s AND g.o = y.o WHERE g.pb AND y.pb AND NOT y.sb AND NOT y.ob
    UNION ALL SELECT g.doc_id, g.o, y.o FROM g JOIN y ON g.doc_id = y.doc_id AND g.s = y.s AND g.p = y.p WHERE g.ob AND y.ob AND NOT y.sb AND NOT y.pb
  ) GROUP BY {d}gold_blank, system_blank
)"""


def align_sql(local: bool) -> str:
    d = "doc_id, " if local else ""
    return f"""{pairs_sql(local)}, al AS (
  SELECT {d}system_blank, gold_blank FROM pairs QUALIFY row_number() OVER (PARTITION BY {d}system_blank ORDER BY n DESC, gold_blank) = 1
)"""


def counts_sql(local: bool) -> str:
    joins = " ".join(f"LEFT JOIN al m{c} ON y.{c}b AND y.{c} = m{c}.system_blank" + (f" AND y.doc_id = m{c}.doc_id" if local else "") for c in "spo")
    return f"""{align_sql(local)}, m AS MATERIALIZED (
  SELECT DISTINCT y.doc_id, {', '.join(f'coalesce(m{c}.gold_blank, y.{c}) AS {c}' for c in 'spo')} FROM y {joins}
), gs AS (SELECT DISTINCT doc_id, s, p, o FROM g), nodes AS (
  SELECT s AS x FROM g WHERE NOT sb UNION SELECT p FROM g WHERE NOT pb UNION SELECT o FROM g WHERE NOT ob
  UNION SELECT s FROM y WHERE NOT sb UNION SELECT p FROM y WHERE NOT pb UNION SELECT o FROM y WHERE NOT ob
), ge AS (SELECT doc_id, 'entity' AS kind, s AS x FROM gs UNION SELECT doc_id, 'entity', o FROM gs UNION SELECT doc_id, 'relation', p FROM gs),
me AS (SELECT doc_id, 'entity' AS kind, s AS x FROM m UNION SELECT doc_id, 'entity', o FROM m UNION SELECT doc_id, 'relation', p FROM m),
e AS (
  SELECT coalesce(ge.kind, me.kind) AS kind, coalesce(ge.x, me.x) AS x, ge.x IS NOT NULL AS ing, me.x IS NOT NULL AS iny
  FROM ge FULL OUTER JOIN me ON ge.doc_id = me.doc_id AND ge.kind = me.kind AND ge.x = me.x
), ek AS (SELECT e.*, CASE WHEN nodes.x IS NULL THEN 'nil_' ELSE 'kg_' END AS known FROM e LEFT JOIN nodes ON e.x = nodes.x),
t AS (SELECT gs.s IS NOT NULL AS ing, m.s IS NOT NULL AS iny FROM gs FULL OUTER JOIN m ON gs.doc_id = m.doc_id AND gs.s = m.s AND gs.p = m.p AND gs.o = m.o),
counts AS (
  SELECT 'triple' AS label, count(*) FILTER (ing AND iny) AS tp, count(*) FILTER (iny AND NOT ing) AS fp, count(*) FILTER (ing AND NOT iny) AS fn FROM t
  UNION ALL SELECT kind, count(*) FILTER (ing AND iny), count(*) FILTER (iny AND NOT ing), count(*) FILTER (ing AND NOT iny) FROM ek GROUP BY kind
  UNION ALL SELECT known || kind, count(*) FILTER (ing AND iny), count(*) FILTER (iny AND NOT ing), count(*) FILTER (ing AND NOT iny) FROM ek GROUP BY known, kind
)"""


PRF = """SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall FROM counts)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _aligned(spark: SparkSession, sf: str, local: bool):
    g, y = E.prepared(gold(spark, sf), system(spark, sf))
    return g, y, E.align(E.blank_pairs(g, y, local), local)


@query(f"WITH {BASE_SQL}, {pairs_sql(False)} SELECT gold_blank, system_blank, n FROM pairs")
def blank_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    g, y = E.prepared(gold(spark, sf), system(spark, sf))
    return E.blank_pairs(g, y, False)


@query(f"WITH {BASE_SQL}, {align_sql(True)} SELECT doc_id, system_blank, gold_blank FROM al")
def blank_align_local(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf, True)[2]


@query(f"WITH {BASE_SQL}, {align_sql(False)} SELECT system_blank, gold_blank FROM al")
def blank_align_global(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf, False)[2]


def _counts(spark: SparkSession, sf: str, which: str) -> DataFrame:
    g, y, al = _aligned(spark, sf, False)
    return E.counts(g, E.renamed(y, al, False), kinds=(which,))


@query(f"WITH {BASE_SQL}, {counts_sql(False)} SELECT * FROM counts WHERE label LIKE '%triple'")
def triple_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, "triple")


@query(f"WITH {BASE_SQL}, {counts_sql(False)} SELECT * FROM counts WHERE label LIKE '%entity'")
def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, "entity")


@query(f"WITH {BASE_SQL}, {counts_sql(False)} SELECT * FROM counts WHERE label LIKE '%relation'")
def relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, "relation")


@query(f"WITH {BASE_SQL}, {counts_sql(True)} {PRF}")
def prf_local(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.evaluate(gold(spark, sf), system(spark, sf), local=True))


@query(f"WITH {BASE_SQL}, {counts_sql(False)} {PRF}")
def prf_global(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.evaluate(gold(spark, sf), system(spark, sf), local=False))


@query(f"""WITH {GOLD_SQL}, {SYSTEM_SQL}, n AS (
  SELECT doc_id, sum(g) AS g, sum(y) AS y FROM (SELECT doc_id, 1 AS g, 0 AS y FROM gold0 UNION ALL SELECT doc_id, 0, 1 FROM system0) GROUP BY doc_id)
SELECT round(avg((y > g)::INT), 6) AS more_triples_created, round(avg((y < g)::INT), 6) AS fewer_triples_created, round(avg((y = g)::INT), 6) AS exact_triples_created FROM n""")
def length_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.length_ratio(gold(spark, sf), system(spark, sf)))


@query(f"""WITH {GOLD_SQL}, {SYSTEM_SQL}, a AS (SELECT DISTINCT doc_id, lower(s || ' | ' || p || ' | ' || o) AS t FROM gold0), b AS (SELECT DISTINCT doc_id, lower(s || ' | ' || p || ' | ' || o) AS t FROM system0),
c AS (SELECT coalesce(a.t, b.t) AS t, count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL) AS tp, count(*) FILTER (a.t IS NULL) AS fp, count(*) FILTER (b.t IS NULL) AS fn FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.t = b.t GROUP BY 1),
q AS (SELECT CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT count(*) AS classes, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM q""")
def macro_triple_prf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.macro_triple_prf(gold(spark, sf), system(spark, sf)))


EDGES_SQL = """edges AS (
  SELECT DISTINCT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'region:' || r_regionkey, 'world' FROM region
)"""


@query(f"""WITH RECURSIVE {EDGES_SQL}, a AS (SELECT 'supp:' || s_suppkey AS node FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT edges.dst FROM a JOIN edges ON a.node = edges.src),
b AS (SELECT 'supp:' || s_suppkey AS node FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT edges.dst FROM b JOIN edges ON b.node = edges.src)
SELECT count(*) AS reachable, count(b.node) AS shared, round(count(b.node)::DOUBLE / count(*), 6) AS overlap FROM a LEFT JOIN b ON a.node = b.node""")
def descendants_overlap(spark: SparkSession, sf: str) -> DataFrame:
    n, s, r = (table(spark, sf, x) for x in ("nation", "supplier", "region"))
    edges = (
        n.selectExpr("concat('nation:', n_nationkey) AS src", "concat('region:', n_regionkey) AS dst")
        .unionAll(s.selectExpr("concat('supp:', s_suppkey)", "concat('nation:', s_nationkey)"))
        .unionAll(r.selectExpr("concat('region:', r_regionkey)", "'world'"))
    )
    start = lambda k: s.where(f"s_suppkey % {k} = 0").selectExpr("concat('supp:', s_suppkey) AS node")
    return rounded(E.reachable_overlap(edges, start(2), start(3)))
