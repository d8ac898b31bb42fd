"""Queries over vectors and alignment graphs. Odd vectors are mentions (or the open store), even ones stand for the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.names import NEW_ENTITY
from kgspark.operators import linking as L
from kgspark.operators import vectors as V
from kgspark.operators.graphindex import GraphIndex
from kgspark.plans import pipeline as K
from kgspark.plans.graphs import rounded
from kgspark.plans.registry import query, table
from kgspark.session import cut, fresh_dir

ME, MM, PATH = 0.3, 0.3, 0.12


def store(spark: SparkSession, sf: str, odd: int | None) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e if odd is None else e.where(F.col("id") % 2 == odd)


SIM = "list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def top_sql(where: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT q.vec_id AS query_id, b.vec_id AS cand_id, {SIM} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, b.vec_id) AS rank
  FROM embeddings q, embeddings b WHERE {where} QUALIFY rank <= {k})"""


MM_SQL = top_sql("q.vec_id % 2 = 1 AND b.vec_id % 2 = 1 AND q.vec_id <> b.vec_id", 10, "mm")
ME_SQL = top_sql("q.vec_id % 2 = 1 AND b.vec_id % 2 = 0", 10, "me")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return rounded(e.select("vec_id", F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))).alias("norm"), V.l2_normalise(F.col("embedding"))[0].alias("first")))


@query(f"SELECT label, count(*) AS pairs, round(avg(sim), 6) AS mean, round(max(sim), 6) AS most FROM (SELECT q.label, {SIM} AS sim FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id % 2 = 1 AND b.vec_id % 2 = 0) GROUP BY label")
def dot_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q, b = (e.where(f"vec_id % 2 = {k}").select("label", "embedding") for k in (1, 0))
    return rounded(V.product_sums(q, b, "label"))


@query(f"WITH {top_sql('q.vec_id % 2 = 1 AND b.vec_id % 2 = 1', 5, 'a')}, {top_sql('q.vec_id % 2 = 1 AND b.vec_id % 2 = 0', 5, 'b')} SELECT query_id, 'open' AS kind, cand_id, round(score, 6) AS score, rank::INT AS rank FROM a UNION ALL SELECT query_id, 'kg', cand_id, round(score, 6), rank::INT FROM b")
def topk_two_store(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.top_k_two_stores(store(spark, sf, 1), store(spark, sf, 1), store(spark, sf, 0), 5))


@query(f"WITH {MM_SQL} SELECT query_id, cand_id, round(score, 6) AS score, rank::INT AS rank FROM mm")
def topk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    m = store(spark, sf, 1)
    return rounded(V.top_k(m, m, 10, self_score=-1.0))


@query(f"WITH {ME_SQL} SELECT query_id, cand_id, round(score, 6) AS score, rank::INT AS rank FROM me")
def topk_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Top-10 over blocks of 64 near vectors, of which bounds leave out pairs where they can."""
    return rounded(V.bounded_top_k(store(spark, sf, 1), store(spark, sf, 0), 10, V._product(10, False, None, False), block=64)[0])


@query(f"WITH {ME_SQL} SELECT query_id, cand_id, round(score, 6) AS score FROM me WHERE rank = 1 AND score > {ME}")
def argmax_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.argmax_above(V.top_k(store(spark, sf, 1), store(spark, sf, 0), 10), ["query_id"], ME, "cand_id").drop("rank"))


@query()
def ivf_topk_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the cell index against exact top-10: half of the cells are probed."""
    q, b = store(spark, sf, 1), store(spark, sf, 0)
    index = V.CellIndex(b, cells=16)
    return rounded(V.recall(index.search(q, 10, 8), V.top_k(q, b, 10)))


@query("SELECT count(*) AS indexed, 10 * (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 1) AS wanted, true AS found_enough, true AS fewer_pairs FROM embeddings WHERE vec_id % 2 = 0")
def layered_index(spark: SparkSession, sf: str) -> DataFrame:
    """Layered graphs in two cells, saved, loaded and all probed, with a beam that a sample of queries asks for: 95 % of the exact top-10 are found with fewer scored pairs than flat cells score."""
    q, b = store(spark, sf, 1), store(spark, sf, 0)
    path = fresh_dir(spark, "graphs")
    GraphIndex(b, cells=2).save(path)
    index = GraphIndex.load(spark, path)
    # some more than is asked of all queries, as a sample says it
    hits = cut(index.candidates(q, 10, 2, index.measured_beam(q, b, 10, 2, 0.96)))
    r = V.recall(V.ranked(hits.drop("scored"), ["query_id"], 10), V.top_k(q, b, 10))
    pairs = hits.agg(F.sum("scored").alias("pairs"))
    flat = index.assigned(q, 2).groupBy("cell").agg(F.count("*").alias("asked")).join(index.rows.groupBy("cell").agg(F.count("*").alias("held")), "cell").agg(F.sum(F.col("asked") * F.col("held")).alias("flat"))
    held = index.rows.agg(F.count("*").alias("indexed"))
    one = held.join(F.broadcast(r)).join(F.broadcast(pairs)).join(F.broadcast(flat))  # a row each
    return one.select("indexed", "wanted", (F.col("recall") >= 0.95).alias("found_enough"), (F.col("pairs") < F.col("flat")).alias("fewer_pairs"))


def scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m, e = store(spark, sf, 1), store(spark, sf, 0)
    me = V.top_k(m, e, 10).select(F.lpad(F.col("query_id").cast("string"), 8, "0").alias("mention"), F.lpad(F.col("cand_id").cast("string"), 8, "0").alias("entity"), F.round("score", 9).alias("score"))
    mm = V.top_k(m, m, 10, exclude_self=True).select(
        F.lpad(F.col("query_id").cast("string"), 8, "0").alias("m1"), F.lpad(F.col("cand_id").cast("string"), 8, "0").alias("m2"), F.round("score", 9).alias("score"),
        (F.col("query_id") * 10 + F.col("rank")).alias("ord"),
    )
    return me, mm


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    me, mm = scored(spark, sf)
    edges = cut(L.alignment_edges(me, mm, ME, MM))
    nodes = store(spark, sf, 1).select(F.concat(F.lit("m:"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("node")).unionAll(edges.where("b LIKE 'e:%'").select("b"))
    return edges, cut(nodes.distinct())


EDGE_SQL = f"""{ME_SQL}, {MM_SQL}, edges AS MATERIALIZED (
  SELECT 'm:' || lpad(query_id::VARCHAR, 8, '0') AS a, 'e:' || lpad(cand_id::VARCHAR, 8, '0') AS b, least(round(score, 9), 1.0) AS weight FROM me WHERE round(score, 9) > {ME}
  UNION ALL SELECT a, b, arg_max(w, ord) FROM (SELECT 'm:' || lpad(least(query_id, cand_id)::VARCHAR, 8, '0') AS a, 'm:' || lpad(greatest(query_id, cand_id)::VARCHAR, 8, '0') AS b,
    least(round(score, 9), 1.0) AS w, query_id * 10 + rank AS ord FROM mm WHERE round(score, 9) > {MM}) GROUP BY a, b
), both_ AS MATERIALIZED (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
nodes AS MATERIALIZED (SELECT 'm:' || lpad(vec_id::VARCHAR, 8, '0') AS node FROM embeddings WHERE vec_id % 2 = 1 UNION SELECT b FROM edges WHERE b LIKE 'e:%'),
reach AS (SELECT node, node AS seen FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN both_ e ON e.a = r.seen),
comps AS MATERIALIZED (SELECT node, min(seen) AS component FROM reach GROUP BY node),
state AS (SELECT component, count(*) FILTER (node LIKE 'm:%') AS mentions, count(*) FILTER (node LIKE 'e:%') AS entities FROM comps GROUP BY component)"""


@query(f"WITH RECURSIVE {EDGE_SQL} SELECT a, b, round(weight, 6) AS weight FROM edges")
def align_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph(spark, sf)[0])


@query(f"WITH RECURSIVE {EDGE_SQL} SELECT node, component FROM comps")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return L.components(*graph(spark, sf))


@query(f"WITH RECURSIVE {EDGE_SQL} SELECT component, mentions, entities, entities <= 1 AS valid FROM state")
def component_validity(spark: SparkSession, sf: str) -> DataFrame:
    return L.validity(L.components(*graph(spark, sf)))


PATH_SQL = f"""{EDGE_SQL}, paths AS (
  SELECT node, node AS source, 1.0::DOUBLE AS score FROM nodes WHERE node LIKE 'e:%'
  UNION SELECT e.b, p.source, round(p.score * e.weight, 12) FROM paths p JOIN both_ e ON e.a = p.node WHERE round(p.score * e.weight, 12) > {PATH} AND e.b LIKE 'm:%'
), best AS MATERIALIZED (SELECT node, source, score FROM paths QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, source) = 1)"""


@query(f"WITH RECURSIVE {PATH_SQL} SELECT node, source, round(score, 6) AS score FROM best")
def path_assign(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes = graph(spark, sf)
    return rounded(L.best_paths(edges, nodes.where("node LIKE 'e:%'"), PATH))


CLUSTER_SQL = f"""{PATH_SQL}, ent AS (SELECT component, min(node) AS entity FROM comps WHERE node LIKE 'e:%' GROUP BY component),
fine AS (SELECT node, coalesce(entity, component) AS cluster, entity FROM comps JOIN state USING (component) LEFT JOIN ent USING (component) WHERE entities <= 1 AND node LIKE 'm:%'),
broken AS MATERIALIZED (SELECT node FROM comps JOIN state USING (component) WHERE entities > 1),
assigned AS MATERIALIZED (SELECT node, source AS cluster, source AS entity FROM best WHERE node LIKE 'm:%' AND score > {PATH} AND node IN (SELECT node FROM broken)),
rest AS MATERIALIZED (SELECT node FROM broken WHERE node LIKE 'm:%' AND node NOT IN (SELECT node FROM assigned)),
inner_ AS MATERIALIZED (SELECT a, b FROM both_ WHERE a IN (SELECT node FROM rest) AND b IN (SELECT node FROM rest)),
loose AS (SELECT node, node AS seen FROM rest UNION SELECT l.node, e.b FROM loose l JOIN inner_ e ON e.a = l.seen),
clusters AS MATERIALIZED (SELECT * FROM fine UNION ALL SELECT * FROM assigned UNION ALL SELECT node, min(seen), NULL FROM loose GROUP BY node)"""


@query(f"WITH RECURSIVE {CLUSTER_SQL} SELECT node, cluster, entity FROM clusters")
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes = graph(spark, sf)
    return L.clusters(edges, nodes, PATH)


@query(f"""WITH RECURSIVE {CLUSTER_SQL}, heads AS (SELECT cluster, row_number() OVER (ORDER BY min(node)) - 1 AS number FROM clusters WHERE entity IS NULL GROUP BY cluster)
SELECT node, CASE WHEN entity IS NULL THEN '{NEW_ENTITY}' || number ELSE substr(entity, 3) END AS identifier FROM clusters LEFT JOIN heads ON clusters.cluster = heads.cluster AND entity IS NULL""")
def cluster_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes = graph(spark, sf)
    return L.identifiers(L.clusters(edges, nodes, PATH))


GRID_MM = (0.3, 0.35, 0.4)
GRID_ME = (0.3, 0.35, 0.4)


@query(f"WITH {ME_SQL}, {MM_SQL} SELECT me_threshold, mm_threshold, (SELECT count(*) FROM me WHERE round(score, 9) > me_threshold) AS me_edges, "
       "(SELECT count(DISTINCT least(query_id, cand_id) * 1000000 + greatest(query_id, cand_id)) FROM mm WHERE round(score, 9) > mm_threshold) AS mm_edges "
       "FROM (VALUES (0.3::DOUBLE), (0.35), (0.4)) x(me_threshold), (VALUES (0.3::DOUBLE), (0.35), (0.4)) y(mm_threshold)")
def grid_tune(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of every point of a threshold grid; scores are computed once for all points."""
    me, mm = (cut(x) for x in scored(spark, sf))
    grid = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    a = me.select("score", grid(GRID_ME, "me_threshold")).groupBy("me_threshold").agg(F.count_if(F.col("score") > F.col("me_threshold")).alias("me_edges"))
    pairs = mm.select(F.least("m1", "m2").alias("x"), F.greatest("m1", "m2").alias("y"), "score", grid(GRID_MM, "mm_threshold")).where("score > mm_threshold")
    b = pairs.groupBy("mm_threshold").agg(F.count_distinct("x", "y").alias("mm_edges"))
    points = spark.createDataFrame([(x, y) for x in GRID_ME for y in GRID_MM], "me_threshold double, mm_threshold double")
    return points.join(a, "me_threshold", "left").join(b, "mm_threshold", "left").fillna(0, ["me_edges", "mm_edges"])


GRID = [(a, b, c) for a in GRID_ME for b in GRID_MM for c in (0.1, 0.12, 0.15)]


def grid_input(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Odd vectors as mentions, ten numbers to a document, with scored neighbours; triples chain a document's mentions, and gold names a mention's nearest graph element, or its label as new where that is far."""
    m = store(spark, sf, 1).select("id", F.floor(F.col("id") / 10).alias("doc_id"), F.concat(F.lit("v"), F.col("id")).alias("entity"), (F.col("id") % 10).cast("long").alias("ent_pos"))
    me, mm = scored(spark, sf)
    wide = lambda c: F.lpad(c, 19, "0").alias(c)
    me, mm = cut(me.select(wide("mention"), "entity", "score")), cut(mm.select(wide("m1"), wide("m2"), "score", "ord"))
    triples = m.where("ent_pos < 9").select("doc_id", F.col("ent_pos").alias("pos"), F.col("entity").alias("subj"), F.lit("next").alias("rel"), F.concat(F.lit("v"), F.col("id") + 2).alias("obj"))
    known = spark.createDataFrame([("http://kg/next", "next", "stands before")], "uri string, label string, definition string")
    best = me.groupBy("mention").agg(F.max_by("entity", "score").alias("near"), F.max("score").alias("score"))
    named = m.join(best, F.lpad(F.col("id").cast("string"), 19, "0") == F.col("mention"), "left").select("doc_id", "entity", "near", (F.coalesce("score", F.lit(0.0)) < 0.35).alias("far"))
    side = lambda c: named.select("doc_id", F.col("entity").alias(c), F.when(F.col("far"), F.concat(F.lit("_:"), "near")).otherwise(F.col("near")).alias(f"{c}_id"), F.col("far").alias(f"{c}_far"))
    gold = triples.join(side("subj"), ["doc_id", "subj"]).join(side("obj"), ["doc_id", "obj"]).where("NOT (subj_far AND obj_far)")
    return cut(m), me, mm, triples, known, gold.select("doc_id", F.col("subj_id").alias("s"), F.lit("http://kg/next").alias("p"), F.col("obj_id").alias("o"))


@query()
def grid_f1(spark: SparkSession, sf: str) -> DataFrame:
    """F1 of triples and entities at 27 points of the three thresholds, clustered, linked and scored together."""
    return rounded(K.tuned(*grid_input(spark, sf), GRID))
