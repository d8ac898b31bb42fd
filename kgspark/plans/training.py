"""Queries over dataset builders, metrics, canonicalisation and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import models as M
from kgspark.functions import text as X
from kgspark.names import NEW_ENTITY, NEW_RELATION
from kgspark.operators import canonical as C
from kgspark.operators import linking as L
from kgspark.operators import metrics
from kgspark.operators import ordered as O
from kgspark.operators import sampling as S
from kgspark.operators import spans
from kgspark.operators import vectors as V
from kgspark.plans import graphs as G
from kgspark.plans import pipeline as K
from kgspark.plans.graphs import rounded
from kgspark.plans.registry import query, table
from kgspark.sources import readers as R


def draw_sql(*ids: str, seed: int = 0) -> str:
    value = str(seed + 1)
    for i in ids:
        value = f"((({value})::HUGEINT * 31 + {i} + 7) % {S.MODULUS} * {S.MULTIPLIER} % {S.MODULUS})"
    return value


@query(f"SELECT o_orderkey, CASE WHEN {draw_sql('o_orderkey')} % 1000 < 800 THEN 'train' ELSE 'dev' END AS split FROM orders")
def dev_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", shares={"train": 0.8, "dev": 0.2})


@query(f"SELECT o_orderkey, CASE WHEN d < 750 THEN 'train' WHEN d < 875 THEN 'test' ELSE 'valid' END AS split FROM (SELECT o_orderkey, {draw_sql('o_orderkey', seed=3)} % 1000 AS d FROM orders)")
def three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", shares={"train": 0.75, "test": 0.125, "valid": 0.125}, seed=3)


@query(f"""WITH pos AS (SELECT o_custkey AS query_id, o_orderkey AS positive_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
q AS (SELECT query_id, count(*) AS n FROM pos GROUP BY query_id), pool AS (SELECT o_orderkey AS cand_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),
d AS (SELECT query_id, n, k, {draw_sql('query_id', 'k')} % (SELECT count(*) FROM orders) AS p FROM q, LATERAL (SELECT unnest(range(0, 2 * n + 8)) AS k)),
g AS (SELECT query_id, n, cand_id, min(k) AS k FROM d JOIN pool USING (p) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) - 1 AS i FROM g WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.query_id = g.query_id AND pos.positive_id = g.cand_id))
SELECT r.query_id, pos.positive_id, r.cand_id FROM r JOIN pos ON r.query_id = pos.query_id AND r.i = pos.i WHERE r.i < n""")
def neg_sampling(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    w = Window.partitionBy("query_id").orderBy("positive_id")
    pos = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("positive_id")).withColumn("i", F.row_number().over(w) - 1)
    queries = pos.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    pool = L.dense_numbers(o.select(F.col("o_orderkey").alias("cand_id")), "cand_id", "pos")
    return S.negatives(queries, pool, pos)


@query("""SELECT o_orderkey AS query, text, label FROM (SELECT o_orderkey, o_orderstatus AS text, 1 AS label FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, 0 FROM orders UNION ALL SELECT o_orderkey, 'x', 0 FROM orders)""")
def pos_neg_long(spark: SparkSession, sf: str) -> DataFrame:
    return S.long_format(table(spark, sf, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderstatus").alias("positive"), F.array("o_orderpriority", F.lit("x")).alias("negatives")))


@query(f"""WITH r AS (SELECT o_orderkey AS mention_id, o_custkey AS gold, CASE WHEN o_orderkey % 3 = 0 THEN [o_custkey + 1, o_custkey + 2] ELSE [o_custkey + 1, o_custkey] END AS c FROM orders)
SELECT mention_id, gold, array_to_string(c, ',') AS candidates, CASE WHEN list_contains(c, gold) THEN gold END AS label FROM r
UNION ALL SELECT mention_id, gold, array_to_string(list_filter(c, lambda x: x <> gold), ','), NULL FROM r WHERE list_contains(c, gold) AND {draw_sql('mention_id')} % 1000 < 250""")
def none_case(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("mention_id"), g.alias("gold"), F.when(F.col("o_orderkey") % 3 == 0, F.array(g + 1, g + 2)).otherwise(F.array(g + 1, g)).alias("candidates")
    )
    return S.with_none_case(rows).select("mention_id", "gold", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"), "label")


@query("""WITH m AS (SELECT o_custkey AS qid, o_orderkey AS mention_id FROM orders), p AS (SELECT qid, mention_id AS query, lead(mention_id) OVER w AS other, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY qid ORDER BY mention_id)),
h AS (SELECT DISTINCT qid, (qid * 7 + 1) % 150 AS neg_qid, 1 AS rank FROM m WHERE (qid * 7 + 1) % 150 <> qid),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, neg_qid) AS i FROM h WHERE neg_qid IN (SELECT qid FROM m)),
few AS (SELECT qid AS neg_qid, mention_id AS other, row_number() OVER (PARTITION BY qid ORDER BY mention_id) AS i FROM m)
SELECT qid, query, other, 1 AS label FROM p WHERE other IS NOT NULL AND i <= 10
UNION ALL SELECT t.qid, f.query, few.other, 0 FROM t JOIN few ON t.neg_qid = few.neg_qid AND few.i <= 2 JOIN (SELECT qid, min(mention_id) AS query FROM m GROUP BY qid) f ON f.qid = t.qid WHERE t.i <= 10""")
def mention_pairs(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("mention_id"))
    hard = m.select("qid", ((F.col("qid") * 7 + 1) % 150).alias("neg_qid"), F.lit(1).alias("rank")).where("qid <> neg_qid").distinct()
    return S.mention_pairs(m, hard)


SCORED = "SELECT d.lang AS query, d.doc_id AS item, (d.doc_id * 37 % 101) / 101.0::DOUBLE AS score, l.quality AS relevant FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l JOIN documents d ON d.doc_id = l.doc_id"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("relevant"))
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("query")).join(lab, "doc_id").select("query", F.col("doc_id").alias("item"), ((F.col("doc_id") * 37 % 101) / 101.0).alias("score"), "relevant")


@query(f"""WITH s AS ({SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank, row_number() OVER (PARTITION BY query ORDER BY relevant DESC, item) AS ideal FROM s),
h AS (SELECT *, sum(relevant) OVER (PARTITION BY query ORDER BY rank) AS hits FROM r),
e AS (SELECT query, sum(relevant) AS n, sum(CASE WHEN relevant = 1 THEN hits::DOUBLE / rank ELSE 0 END) AS ap, min(CASE WHEN relevant = 1 AND rank <= 10 THEN rank END) AS first,
  sum(CASE WHEN relevant = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN relevant = 1 AND ideal <= 10 THEN 1 / log2(ideal + 1) ELSE 0 END) AS idcg FROM h GROUP BY query)
SELECT count(*) AS queries, round(avg(ap / n), 6) AS map, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(dcg / idcg), 6) AS ndcg FROM e WHERE n > 0""")
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.ranking(scored(spark, sf)))


@query(f"""WITH s AS ({SCORED}), f AS (SELECT *, relevant = 1 AND row_number() OVER (PARTITION BY query, relevant ORDER BY item) = 1 AS truth, score >= 0.5 AS said FROM s),
c AS (SELECT 'x' AS label, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn FROM f WHERE truth OR relevant = 0), counts AS (SELECT * FROM c)
SELECT tp, fp, fn, precision, recall, f1 FROM ({G.PRF})""")
def detection_prf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.detection(scored(spark, sf)))


@query(f"SELECT relevant, round(min(score), 6) AS least, round(avg(score), 6) AS mean, round(max(score), 6) AS most, count(*) AS items FROM ({SCORED}) GROUP BY relevant")
def score_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.score_ranges(scored(spark, sf)))


@query(f"SELECT round(avg(CASE WHEN score >= 0.4 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({SCORED})")
def retrieval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.pairwise_accuracy(scored(spark, sf).select(F.col("score").alias("positive_score"), F.lit(0.4).alias("negative_score"))))


@query(f"SELECT round(avg(lse - own), 6) AS loss FROM (SELECT query, max(score / 0.1) + ln(sum(exp(score / 0.1 - top))) AS lse, max(score / 0.1) FILTER (relevant = 1) AS own FROM (SELECT *, max(score / 0.1) OVER (PARTITION BY query) AS top FROM ({SCORED})) GROUP BY query)")
def contrastive_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.info_nce(scored(spark, sf).withColumnRenamed("relevant", "positive")))


@query("SELECT l_orderkey AS query, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS documents FROM (SELECT DISTINCT l_orderkey, pos FROM lineitem JOIN (SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY l_partkey) USING (l_partkey)) GROUP BY l_orderkey")
def relevant_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return metrics.relevant_documents(rows).select("query", F.array_join(F.col("documents").cast("array<string>"), ",").alias("documents"))


RELS = f"WITH {G.SYSTEM_SQL}, t AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, p, o) AS pos, s, p, o FROM (SELECT DISTINCT * FROM system0))"


def positioned(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("s", "p", "o")
    return G.system(spark, sf).distinct().withColumn("pos", F.row_number().over(w).cast("long")).select("doc_id", "pos", F.col("s").alias("subj"), F.col("p").alias("rel"), F.col("o").alias("obj"))


@query(f"""{RELS}, r AS (SELECT doc_id, pos, p AS rel, CASE p WHEN 'has_part' THEN '{NEW_RELATION}0' WHEN 'placed' THEN 'http://kg/placed' END AS uri FROM t)
SELECT doc_id, pos, rel, coalesce(uri, '{NEW_RELATION}' || (row_number() OVER (PARTITION BY uri IS NULL ORDER BY doc_id, pos))) AS uri FROM r""")
def relation_uri_map(spark: SparkSession, sf: str) -> DataFrame:
    opened = spark.createDataFrame([("has_part", 0)], "label string, ord long")
    known = spark.createDataFrame([("placed", "http://kg/placed")], "label string, uri string")
    return L.relation_uris(positioned(spark, sf), opened, known)


@query(f"""{RELS}, ids AS MATERIALIZED (SELECT DISTINCT doc_id, x AS entity, 'http://kg/' || x AS identifier FROM (SELECT doc_id, s AS x FROM t UNION SELECT doc_id, o FROM t) WHERE NOT contains(x, 'createdby')),
ta AS MATERIALIZED (SELECT t.doc_id, t.pos, t.p, t.o, a.identifier FROM t JOIN ids a ON a.doc_id = t.doc_id AND a.entity = t.s WHERE t.p IN ('placed', 'has_part'))
SELECT ta.doc_id, ta.pos, ta.identifier AS s, 'http://kg/rel/' || ta.p AS p, b.identifier AS o FROM ta JOIN ids b ON b.doc_id = ta.doc_id AND b.entity = ta.o""")
def linked_triples(spark: SparkSession, sf: str) -> DataFrame:
    t = positioned(spark, sf)
    ids = t.select("doc_id", F.explode(F.array("subj", "obj")).alias("entity")).distinct().where("NOT contains(entity, 'createdby')").withColumn("identifier", F.concat(F.lit("http://kg/"), "entity"))
    rels = spark.createDataFrame([(r, f"http://kg/rel/{r}") for r in ("placed", "has_part")], "rel string, uri string")
    return L.linked(t, ids, rels)


@query("""SELECT doc_id, 'src|' || CASE lang WHEN 'en' THEN 'en|de' WHEN 'de' THEN 'de|en' ELSE lang || '|en|de' END AS united, CASE lang WHEN 'en' THEN 'src|en|de' WHEN 'de' THEN 'src|en|de' ELSE 'src|' || lang || '|en|de' END AS fronted FROM documents""")
def hint_union(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    hints, found = F.array(F.lit("src"), "lang"), F.array(F.lit("en"), F.lit("de"))
    return d.select("doc_id", F.array_join(X.union_ordered(hints, found), "|").alias("united"), F.array_join(X.hints_in_front(hints, found), "|").alias("fronted"))


@query(f"""SELECT rel, subj, obj FROM (SELECT l_returnflag || l_linestatus AS rel, 'o' || l_orderkey AS subj, 'p' || l_partkey AS obj, row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY {draw_sql('l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber, 'p' || l_partkey) AS r FROM lineitem) WHERE r = 1""")
def relation_examples(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("rel"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("o"), "l_orderkey").alias("subj"), F.concat(F.lit("p"), "l_partkey").alias("obj"))
    docs = li.select("doc_id", F.lit("t").alias("text")).distinct()
    return C.relation_examples(li, docs).select("rel", "subj", "obj")


class Never:
    """A verifier that finds no match."""

    def complete(self, prompts: list[str], max_tokens: int = 5, n: int = 1) -> list[list[str]]:
        return [["?"] * n for _ in prompts]


@query(f"""{RELS}, f AS (SELECT p AS label, min(struct_pack(doc_id := doc_id, pos := pos)) AS f_at FROM t WHERE p NOT IN ('placed') GROUP BY p)
SELECT label, label || ' in ' || f_at.doc_id AS definition, row_number() OVER (ORDER BY f_at) - 1 AS ord FROM f""")
def enrich_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Schema enrichment where no candidate ever matches: relations enter in order of first occurrence."""
    t = positioned(spark, sf)
    docs = t.select("doc_id").distinct().withColumn("text", F.lit("text"))
    defs = t.select("doc_id", "rel").distinct().withColumn("definition", F.concat("rel", F.lit(" in "), F.col("doc_id").cast("string")))
    opened = spark.createDataFrame([], "label string, definition string, ord long")
    known = spark.createDataFrame([("http://kg/placed", "placed", "somebody placed an order")], "uri string, label string, definition string")
    return C.canonicalize(docs, t, defs, opened, known, M.HashEmbedder(16), Never())[1]


PART_OPEN = (("wire", "what a wire does"), ("ribbon", "goes around"), ("gate", "opens and closes"))
PART_KNOWN = (("border", "is next to"), ("bring", "takes to a place"), ("widen", "makes wide"), ("gain", "gets more"))


def part_relations(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Parts as documents of one triple, whose relation is the part's type and its definition the part's name; an open and a known schema of a few relations."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).cast("long").alias("pos"), F.lower("p_type").alias("rel"), F.col("p_name").alias("definition"))
    docs = p.select("doc_id", F.col("definition").alias("text"))
    triples = p.select("doc_id", "pos", F.lit("s").alias("subj"), "rel", F.lit("o").alias("obj"))
    opened = spark.createDataFrame([(n, d, i) for i, (n, d) in enumerate(PART_OPEN)], "label string, definition string, ord long")
    known = spark.createDataFrame([(f"http://kg/{n}", n, d) for n, d in PART_KNOWN], "uri string, label string, definition string")
    return docs, triples, p.select("doc_id", "rel", "definition"), opened, known


@query(f"""WITH labels AS (SELECT unnest({[n for n, _ in PART_OPEN + PART_KNOWN]}) AS label)
SELECT p_partkey AS doc_id, coalesce((SELECT min(label) FROM labels WHERE label[1] = split_part(p_name, ' ', -1)[1]), lower(p_type)) AS rel, lower(p_type) AS open_rel FROM part""")
def enrich_matched(spark: SparkSession, sf: str) -> DataFrame:
    """Canonicalisation with a verifier that often matches: seven relations are all candidates, and the one with the definition's initial is chosen."""
    return C.canonicalize(*part_relations(spark, sf), M.HashEmbedder(16), M.SameInitial())[0].select("doc_id", "rel", "open_rel")


@query()
def strict_verified_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The same in strict order with two candidates of each schema, so that each relation added can change what later parts are asked."""
    return C.canonicalize_strict(*part_relations(spark, sf), M.HashEmbedder(16), M.SameInitial(), k=2)[0].select("doc_id", "rel", "open_rel")


#: The fold step by step: the list of earlier mentions' entity numbers, -1 for those linked to the graph, goes from row to row.
NIL_SQL = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id // 10 AS doc_id, vec_id % 10 AS ent_pos, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 1),
kg AS MATERIALIZED (SELECT m.i, b.vec_id AS cand, list_dot_product(m.e, b.embedding::DOUBLE[]) AS score FROM m, embeddings b WHERE b.vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY m.i ORDER BY score DESC, b.vec_id) = 1),
sims AS MATERIALIZED (SELECT a.i, list(list_dot_product(a.e, b.e) ORDER BY b.i) AS s FROM m a JOIN m b ON b.doc_id < a.doc_id GROUP BY a.i),
r AS MATERIALIZED (SELECT m.i, m.doc_id, m.ent_pos, coalesce(s, []) AS s, CASE WHEN score > 0.35 THEN cand END AS kg, score FROM m JOIN kg ON kg.i = m.i LEFT JOIN sims ON sims.i = m.i),
fold AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS doc_id, 0::BIGINT AS ent_pos, []::BIGINT[] AS nums, 0::BIGINT AS n, '' AS identifier
  UNION ALL SELECT i, doc_id, ent_pos, list_append(nums, num), n + (num = n)::INT, CASE WHEN num < 0 THEN kg::VARCHAR ELSE '{NEW_ENTITY}' || num END FROM (
    SELECT *, CASE WHEN kg IS NOT NULL AND score >= coalesce(own, -2) THEN -1 WHEN own IS NOT NULL THEN nums[list_position(held, own)] ELSE n END AS num FROM (
      SELECT *, CASE WHEN list_max(held) > 0.3 THEN list_max(held) END AS own FROM (
        SELECT r.*, f.nums, f.n, list_transform(range(1, len(r.s) + 1), lambda j: CASE WHEN f.nums[j] >= 0 THEN r.s[j] ELSE -9 END) AS held FROM fold f JOIN r ON r.i = f.i + 1))))
SELECT doc_id, ent_pos::INT AS ent_pos, identifier FROM fold WHERE i > 0"""


@query(NIL_SQL)
def nil_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential linking of odd vectors, five to a document, against even ones and new entities."""
    e = table(spark, sf, "embeddings")
    odd, even = (e.where(f"vec_id % 2 = {k}").select(F.col("vec_id").alias("id"), "embedding") for k in (1, 0))
    place = lambda c: (F.floor(F.col(c) / 10).alias("doc_id"), (F.col(c) % 10).cast("int").alias("ent_pos"))
    near = V.top_k(odd, even, 10).select(*place("query_id"), "cand_id", "score")
    return O.nil_fold(odd.select(*place("id"), "embedding"), 0.3, near, 0.35)


STRICT_SQL = """WITH RECURSIVE o AS MATERIALIZED (SELECT 'open' || vec_id AS label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id // 10 AS doc_id, vec_id % 10 AS pos, 'r' || label || '_' || vec_id % 50 AS rel, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 <> 0),
far AS MATERIALIZED (SELECT i, list(list_dot_product(m.e, o.e) ORDER BY o.label) AS s, list(o.label ORDER BY o.label) AS names FROM m, o GROUP BY i),
sims AS MATERIALIZED (SELECT a.i, list(list_dot_product(a.e, b.e) ORDER BY b.i) AS s FROM m a JOIN m b ON b.i < a.i GROUP BY a.i),
r AS MATERIALIZED (SELECT m.i, m.doc_id, m.pos, m.rel, far.s AS o, far.names, coalesce(sims.s, []) AS s FROM m JOIN far ON far.i = m.i LEFT JOIN sims ON sims.i = m.i),
fold AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS doc_id, 0::BIGINT AS pos, '' AS rel, ''::VARCHAR AS canonical, []::VARCHAR[] AS added
  UNION ALL SELECT i, doc_id, pos, rel, coalesce(chosen, rel), list_append(added, CASE WHEN chosen IS NULL THEN rel END) FROM (
    SELECT *, CASE WHEN list_contains(added, rel) THEN rel WHEN list_max(held) > 0.3 THEN list_concat(names, added)[list_position(held, list_max(held))] END AS chosen FROM (
      SELECT r.*, f.added, list_concat(r.o, list_transform(range(1, len(r.s) + 1), lambda j: CASE WHEN f.added[j] IS NOT NULL THEN r.s[j] ELSE -9 END)) AS held FROM fold f JOIN r ON r.i = f.i + 1)))
SELECT doc_id, pos, rel, canonical FROM fold WHERE i > 0"""


@query(STRICT_SQL)
def strict_canonical_fold(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors but the open relations' own, ten to a document."""
    e = table(spark, sf, "embeddings")
    rows = e.where("vec_id % 100 <> 0").select(F.floor(F.col("vec_id") / 10).alias("doc_id"), (F.col("vec_id") % 10).alias("pos"), F.concat(F.lit("r"), F.col("label").cast("string"), F.lit("_"), (F.col("vec_id") % 50).cast("string")).alias("rel"), "embedding")
    opened = e.where("vec_id % 100 = 0").select(F.concat(F.lit("open"), "vec_id").alias("label"), "embedding")
    return O.canonicalize_ordered(rows, opened, 0.3)


@query("SELECT ord, rels FROM (SELECT ord, rels, row_number() OVER (PARTITION BY rels ORDER BY ord) AS r, min(ord) OVER (PARTITION BY rels) AS first FROM (SELECT l_orderkey AS ord, min(l_returnflag) AS rels FROM lineitem GROUP BY l_orderkey)) WHERE r = 1 ORDER BY first LIMIT 5")
def relation_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sentences, each with its smallest return flag as relation; five relations at most are crawled."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.min("l_returnflag").alias("rel"))
    return C.crawl(rows.select("ord", F.array("rel").alias("rels"), F.lit(True).alias("well_formed"))).select("ord", F.array_join("rels", "|").alias("rels"))


def input_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as inputs of the model stages: whole texts of one table."""
    return table(spark, sf, "documents").select("doc_id", "text")


def small_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("http://kg/p1", "and", "joins two things"), ("http://kg/p2", "the", "points at a thing")], "uri string, label string, definition string")


@query()
def refine_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction, definition, canonicalisation and one refinement, with stand-in models, over all documents."""
    return K.extract_kg(input_docs(spark, sf), small_schema(spark), K.Config(initial_refine=True), iterations=1)[0]


HINTED = ("ander", "of", "re", "the", "un")

#: Words of a text's first line in threes, and one triple of hints a round; relations are kept if known and else take the first label with their initial.
HINTED_SQL = f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(split_part(text, chr(10), 1), '\\p{{L}}+'), lambda x: length(x) > 1)[1:9] AS w, {list(HINTED)} AS known FROM documents
), b AS (SELECT doc_id, known, list_transform(range(0, len(w) // 3), lambda i: {{'s': w[3 * i + 1], 'p': w[3 * i + 2], 'o': w[3 * i + 3]}}) AS t, list_filter(w, lambda x, i: i % 2 = 1) AS e FROM w
), r0 AS (SELECT *, CASE WHEN len(e) > 0 THEN list_append(t, {{'s': list_min(e), 'p': list_min(known), 'o': list_max(e)}}) ELSE t END AS raw FROM b
), c0 AS (SELECT doc_id, known, t, e, list_transform(raw, lambda x: {{'s': x.s, 'o': x.o, 'p': CASE WHEN list_contains(known, x.p) THEN x.p ELSE coalesce(list_min(list_filter(known, lambda k: k[1] = x.p[1])), x.p) END}}) AS c FROM r0
), h AS (SELECT doc_id, known, t, list_concat(e, list_transform(c, lambda x: x.s), list_transform(c, lambda x: x.o)) AS e, list_concat(known, list_transform(c, lambda x: x.p)) AS rels FROM c0
), r1 AS (SELECT *, CASE WHEN len(e) > 0 THEN list_append(t, {{'s': list_min(e), 'p': list_min(rels), 'o': list_max(e)}}) ELSE t END AS raw FROM h
), c1 AS (SELECT doc_id, list_transform(raw, lambda x: {{'s': x.s, 'o': x.o, 'p': CASE WHEN list_contains(known, x.p) THEN x.p ELSE coalesce(list_min(list_filter(rels, lambda k: k[1] = x.p[1])), x.p) END}}) AS c FROM r1
) SELECT doc_id, pos, c[pos + 1].s AS subj, c[pos + 1].p AS rel, c[pos + 1].o AS obj FROM (SELECT doc_id, c, unnest(range(0, len(c))) AS pos FROM c1)"""


@query(HINTED_SQL)
def refine_hinted(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of extraction over all documents, each with hints: entities extracted and merged, what the last round said, and relations retrieved; a verifier that sometimes matches, no enrichment."""
    known = spark.createDataFrame([(f"http://kg/{n}", n, f"stands for {n}") for n in HINTED], "uri string, label string, definition string")
    config = K.Config(completer=M.EchoCompleter(), verifier=M.SameInitial(), initial_refine=True, enrich=False)
    return K.extract_kg(input_docs(spark, sf), known, config, iterations=1)[0]


@query()
def extract_and_link(spark: SparkSession, sf: str) -> DataFrame:
    docs, known = input_docs(spark, sf), small_schema(spark)
    config = K.Config.documented()
    triples, opened = K.extract_kg(docs, known, config)
    p = table(spark, sf, "part")
    elements = p.select(F.concat(F.lit("http://kg/part/"), "p_partkey").alias("identifier"), F.col("p_name").alias("label"), F.col("p_type").alias("definition"), F.array("p_brand").alias("types"))
    return K.link_entities(docs, triples, opened, known, elements, config)


@query()
def semeval_align(spark: SparkSession, sf: str) -> DataFrame:
    """Span scores of all orders: gold and system triples of an order's lines, the system's in reverse order and with other words."""
    li = table(spark, sf, "lineitem")
    e = li.groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("ls"))
    t = lambda s, p, x: F.array(F.concat(F.lit("line "), s.cast("string")), F.lit(p), F.concat(F.lit("part number "), x.cast("string")))
    gold = F.transform("ls", lambda x: t(x.l_linenumber, "has part", x.l_partkey))
    said = F.transform(F.reverse("ls"), lambda x: t(x.l_linenumber, "part is", F.when(x.l_suppkey % 3 == 0, x.l_suppkey).otherwise(x.l_partkey)))
    return rounded(spans.system_scores_of(e.select(gold.alias("gold"), said.alias("said"))))


#: One triple an entry, one word an attribute: a word matches in its own place, or crosswise between subject and object where neither has its own.
WORDS_SQL = """WITH e AS (
  SELECT 'k' || l_suppkey % 3 AS gs, l_returnflag || '1' AS gp, 'k' || l_partkey % 4 AS go, 'k' || l_partkey % 3 AS ss, CASE WHEN l_quantity > 25 THEN l_returnflag || '1' ELSE l_linestatus || '2' END AS sp, 'k' || l_suppkey % 4 AS so FROM lineitem
), c AS (SELECT row_number() OVER () AS id, *, gs <> ss AND go <> so AND (gs = so OR go = ss) AS crossed FROM e
), a AS (
  SELECT id, 'SUB' AS gold_tag, CASE WHEN crossed THEN 'OBJ' ELSE 'SUB' END AS said_tag, gs = CASE WHEN crossed THEN so ELSE ss END AS hit FROM c
  UNION ALL SELECT id, 'PRED', 'PRED', gp = sp FROM c
  UNION ALL SELECT id, 'OBJ', CASE WHEN crossed THEN 'SUB' ELSE 'OBJ' END, go = CASE WHEN crossed THEN ss ELSE so END FROM c
), k AS (SELECT unnest(['ent_type', 'partial', 'strict', 'exact']) AS scheme
), n AS (
  SELECT id, scheme, gold_tag AS tag, CASE WHEN NOT hit THEN 'missed' WHEN gold_tag = said_tag OR scheme IN ('partial', 'exact') THEN 'correct' ELSE 'incorrect' END AS what FROM a, k
  UNION ALL SELECT id, scheme, said_tag, 'spurious' FROM a, k WHERE NOT hit
), both_ AS (SELECT * FROM n UNION ALL SELECT id, scheme, 'all', what FROM n),
per AS (
  SELECT c.id, k.scheme, t.tag, count(*) FILTER (what = 'correct') AS cor, count(*) FILTER (what = 'incorrect') AS inc, count(*) FILTER (what = 'missed') AS mis, count(*) FILTER (what = 'spurious') AS spu
  FROM c CROSS JOIN k CROSS JOIN (SELECT unnest(['all', 'SUB', 'PRED', 'OBJ']) AS tag) t LEFT JOIN both_ b ON b.id = c.id AND b.scheme = k.scheme AND b.tag = t.tag GROUP BY ALL
), r AS (SELECT *, CASE WHEN cor + inc + spu > 0 THEN cor / (cor + inc + spu) ELSE 0 END AS p, CASE WHEN cor + inc + mis > 0 THEN cor / (cor + inc + mis) ELSE 0 END AS q FROM per)
SELECT scheme, tag, sum(cor)::BIGINT AS correct, sum(inc)::BIGINT AS incorrect, 0::BIGINT AS partial, sum(mis)::BIGINT AS missed, sum(spu)::BIGINT AS spurious, sum(cor + inc + mis)::BIGINT AS possible,
  sum(cor + inc + spu)::BIGINT AS actual, round(avg(p), 6) AS precision, round(avg(q), 6) AS recall, round(avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END), 6) AS f1 FROM r GROUP BY scheme, tag"""


@query(WORDS_SQL)
def semeval_words(spark: SparkSession, sf: str) -> DataFrame:
    """Span scores of all lines, one triple of words each, whose subjects and objects are often the other way round."""
    word = lambda c, n: F.concat(F.lit("k"), (F.col(c) % n).cast("string"))
    own = F.concat("l_returnflag", F.lit("1"))
    gold = F.array(F.array(word("l_suppkey", 3), own, word("l_partkey", 4)))
    said = F.array(F.array(word("l_partkey", 3), F.when(F.col("l_quantity") > 25, own).otherwise(F.concat("l_linestatus", F.lit("2"))), word("l_suppkey", 4)))
    return rounded(spans.system_scores_of(table(spark, sf, "lineitem").select(gold.alias("gold"), said.alias("said"))))


@query("SELECT doc_id, doc_id % 4 AS chunk FROM documents")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunks_of(table(spark, sf, "documents").select("doc_id"), "doc_id", 4)


@query("""SELECT a.l_orderkey AS batch_id, a.l_linenumber AS row, b.l_linenumber AS other, a.l_linenumber <> b.l_linenumber AND (b.l_suppkey = a.l_suppkey OR b.l_suppkey = a.l_suppkey + 1) AS masked FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey""")
def false_negative_mask(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("row"), F.col("l_suppkey").alias("label"), F.array(F.col("l_suppkey"), F.col("l_suppkey") + 1).alias("positives"))
    return S.false_negative_mask(li)


@query("SELECT p_type AS label, p_type || ': ' || p_brand AS retriever_text, p_brand AS canonical_text FROM part")
def retrieval_texts(spark: SparkSession, sf: str) -> DataFrame:
    return R.retrieval_texts(table(spark, sf, "part").select(F.col("p_type").alias("label"), F.col("p_brand").alias("definition")))
