"""Queries over sources and sinks: what a sink writes below the shared folder is what the reader of that form gives back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import models as M
from kgspark.functions import parsers as P
from kgspark.functions import text as X
from kgspark.operators import container as C
from kgspark.operators import sampling as S
from kgspark.operators import vectors as V
from kgspark.plans.registry import query, table
from kgspark.plans.texts import CONTAINER_SQL, container_of
from kgspark.session import fresh_dir
from kgspark.sources import readers as R
from kgspark.sources import sinks as K

#: What ends a line of a text file.
EVEN = r"regexp_replace(coalesce(text, ''), '\r\n|\n|\r', ' ', 'g')"


@query(f"SELECT row_number() OVER (ORDER BY doc_id, text) - 1 AS doc_id, md5({EVEN}) AS text FROM documents")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All texts as lines of files, read back with dense numbers in order of files and lines."""
    path = fresh_dir(spark, "lines")
    K.texts(table(spark, sf, "documents").select("doc_id", "text"), path)
    return R.text_lines(spark, path).select("doc_id", F.md5("text").alias("text"))


#: Orders as documents of a dataset: one or two triples each.
DATASET_SQL = """d AS (SELECT o_orderkey AS k, 'order ' || o_orderkey AS text, 'cust ' || o_custkey AS c, 'prio "' || o_orderpriority || '"' AS p FROM orders)"""


def order_docs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("order "), k)
    triples = F.array(F.array(text, F.lit("by"), F.concat(F.lit("cust "), "o_custkey")), F.array(text, F.lit("has"), F.concat(F.lit('prio "'), "o_orderpriority", F.lit('"'))))
    return table(spark, sf, "orders").select(k.alias("index"), text.alias("input_text"), F.slice(triples, F.lit(1), 1 + (k % 2).cast("int")).alias("linked_triplets"))


DATASET_ROWS = f"""WITH {DATASET_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS doc_id FROM d)
SELECT doc_id, text, 0 AS pos, text AS s, 'by' AS p, c AS o FROM n UNION ALL SELECT doc_id, text, 1, text, 'has', p FROM n WHERE k % 2 = 1"""


def _dataset_rows(found: DataFrame) -> DataFrame:
    return R.exploded(found).join(found.select("doc_id", "text"), "doc_id").select("doc_id", "text", "pos", "s", "p", "o")


@query(DATASET_ROWS)
def dataset_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Linked documents written as JSON lines and read as a dataset."""
    path = fresh_dir(spark, "linked") + ".jsonl"
    K.linked_json(order_docs(spark, sf).orderBy("index"), path, slim=True)
    return _dataset_rows(R.dataset(spark, path))


@query(DATASET_ROWS)
def dataset_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """The same as gzipped JSON arrays, a thousand documents to a file."""
    path = fresh_dir(spark, "arrays") + ".json.gz"
    docs = order_docs(spark, sf)
    chunk = F.lpad(F.floor(F.col("index") / 4000).cast("string"), 12, "0").alias("chunk")
    rows = docs.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct("index", F.col("input_text").alias("text"), F.col("linked_triplets").alias("triplets")))).alias("rows"))
    rows.select("chunk", F.to_json("rows").alias("value")).write.partitionBy("chunk").option("compression", "gzip").text(path)
    return _dataset_rows(R.dataset(spark, path))


@query("SELECT md5(text) AS text, '[''a'', ''b \"' || doc_id || '\"'']' AS triplets, lang AS relations, 'x, ' || doc_id || chr(10) || 'y' AS definitions FROM documents")
def definitions_file(spark: SparkSession, sf: str) -> DataFrame:
    """All texts, with their quotes and line ends, through a CSV file with header."""
    path = fresh_dir(spark, "definitions")
    d = table(spark, sf, "documents")
    rows = d.select("text", F.concat(F.lit("['a', 'b \""), "doc_id", F.lit("\"']")).alias("triplets"), F.col("lang").alias("relations"), F.concat(F.lit("x, "), "doc_id", F.lit("\ny")).alias("definitions"))
    K.definitions_csv(rows, path)
    return R.definitions_csv(spark, path).withColumn("text", F.md5("text"))


@query(f"""WITH {DATASET_SQL} SELECT k AS "index", text AS input_text, 2 AS iteration, true AS refused, text || '|by|' || c || CASE WHEN k % 2 = 1 THEN ';' || text || '|has|' || p ELSE '' END AS triples,
'by,has' AS labels FROM d""")
def latest_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Stage results and schemas of three iterations; a second writing of one is refused, and the last is read back."""
    path = fresh_dir(spark, "run")
    schema = spark.createDataFrame([(1, "has", "has a priority"), (0, "by", "is ordered by")], "ord long, label string, definition string")
    refused = False
    stages = order_docs(spark, sf).withColumnRenamed("linked_triplets", "schema_canonicalizaiton")
    for i in range(3):
        K.stage_results(stages if i == 2 else stages.limit(i), path, i)  # earlier iterations are other rows
        K.schema_json(schema, path, i)
    try:
        K.stage_results(stages, path, 2)
    except AnalysisException:
        refused = True
    found, names, n = R.latest_stage(spark, path)
    labels = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x.label), ",").alias("labels"))  # a schema of two
    flat = F.array_join(F.transform("schema_canonicalizaiton", lambda t: F.array_join(t, "|")), ";")
    return found.select("index", "input_text", F.lit(n).alias("iteration"), F.lit(refused).alias("refused"), flat.alias("triples")).join(F.broadcast(labels))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 'dev' ELSE 'train' END AS split FROM orders")
def split_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Dataset splits as folders."""
    path = fresh_dir(spark, "splits")
    K.splits(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "dev").otherwise("train").alias("split")), path)
    return R.splits(spark, path)


TEMPLATE = "Example 1:\nText: one\nTriplets: [['a', 'b', 'c']]"


@query("SELECT doc_id, md5('Find.\nExample 1:\nText: one\nTriplets: [[''a'', ''b'', ''c'']]\n\nText: ' || coalesce(text, 'None')) AS prompt FROM documents")
def prompt_file(spark: SparkSession, sf: str) -> DataFrame:
    """A few-shot file read as a whole and filled into every document's prompt."""
    path = fresh_dir(spark, "prompt")
    spark.createDataFrame([(TEMPLATE,)], "value string").coalesce(1).write.text(path)
    shots = R.whole_text(spark, path)
    prompt = X.fill("Find.\n{few_shot_examples}\nText: {input_text}", few_shot_examples=F.lit(shots), input_text=F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(prompt).alias("prompt"))


@query("SELECT 'Id' || l_orderkey AS entry_id, count(*) AS n, min('order ' || l_orderkey || ' | part & <' || l_linenumber || '> | ' || l_partkey) AS first FROM lineitem GROUP BY l_orderkey")
def entries_file(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark entries as XML and back; markup inside a triple survives."""
    path = fresh_dir(spark, "entries")
    line = F.concat(F.lit("order "), "l_orderkey", F.lit(" | part & <"), "l_linenumber", F.lit("> | "), "l_partkey")
    rows = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("Id"), "l_orderkey").alias("entry_id")).agg(F.collect_list(line).alias("triples"))
    K.entries_xml(rows, path)
    return R.entries_xml(spark, path).select("entry_id", F.size("triples").cast("long").alias("n"), F.array_min("triples").alias("first"))


@query("""SELECT o_orderkey, 1 + o_orderkey % 3 AS predicted, o_custkey % 4 AS gold FROM orders WHERE o_orderkey % 5 <> 0 AND abs(1 + o_orderkey % 3 - o_custkey % 4) <= 1""")
def graded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted and gold triples as literals: lines that don't parse or differ in length by more than one are not graded."""
    one, k = "['a', 'r', 'b']", F.col("o_orderkey")
    many = lambda n: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit(one), n.cast("int")), ", "), F.lit("]"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k % 5 != 0, many(1 + k % 3)).otherwise("[['a',").alias("said"), many(F.col("o_custkey") % 4).alias("truth"))
    parsed = rows.select("o_orderkey", P.strict_triples(F.col("said")).alias("predicted"), P.strict_triples(F.col("truth")).alias("gold"))
    return K.graded_lines(parsed, 1).select("o_orderkey", F.size("predicted").cast("long").alias("predicted"), F.size("gold").cast("long").alias("gold"))


@query("SELECT p_type AS rel, 'about ' || p_partkey AS text, p_name || '|' || p_type || '|' || p_brand AS triple FROM part")
def example_file(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON object from relations to examples, one object a file."""
    path = fresh_dir(spark, "examples")
    p = table(spark, sf, "part")
    one = F.struct(F.concat(F.lit("about "), "p_partkey").alias("text"), F.array("p_name", "p_type", "p_brand").alias("triplet"))
    by_rel = p.groupBy("p_type").agg(F.collect_list(one).alias("xs"))
    by_rel.select(F.to_json(F.create_map("p_type", "xs")).alias("value"), F.col("p_type").alias("file")).write.partitionBy("file").text(path)
    return R.relation_examples(spark, path).select("rel", "text", F.array_join("triple", "|").alias("triple"))


@query(f"""WITH {DATASET_SQL} SELECT row_number() OVER (ORDER BY k) - 1 AS doc_id, '[[''' || text || ''', ''by'', ''' || c || ''']' || CASE WHEN k % 2 = 1 THEN ', [''' || text || ''', ''has'', ''' || p || ''']' ELSE '' END || ']' AS text FROM d""")
def canonical_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical triples as one literal a line."""
    path = fresh_dir(spark, "canonical")
    as_struct = F.transform("linked_triplets", lambda t: F.struct(t[0].alias("subj"), t[1].alias("rel"), t[2].alias("obj")))
    K.canonical_text(order_docs(spark, sf).select(F.col("index").alias("doc_id"), as_struct.alias("triples")), path)
    return R.text_lines(spark, path)


@query(f"""WITH {DATASET_SQL} SELECT k AS "index", text AS input_text, 1 + k % 2 AS n, 'raw ' || k AS oie, false AS slim FROM d UNION ALL SELECT k, text, 1 + k % 2, NULL, true FROM d""")
def linked_files(spark: SparkSession, sf: str) -> DataFrame:
    """Linked results in full and slim."""
    docs = order_docs(spark, sf).withColumn("oie", F.concat(F.lit("raw "), "index"))
    out = []
    for slim in (False, True):
        path = fresh_dir(spark, "linked")
        K.linked_json(docs, path, slim)
        rows = spark.read.schema(f"index long, input_text string, oie string, linked_triplets {R.TRIPLES}").json(path)
        out.append(rows.select("index", "input_text", F.size("linked_triplets").cast("long").alias("n"), "oie", F.lit(slim).alias("slim")))
    return out[0].unionAll(out[1])


@query("SELECT 'http://kg/part/' || p_partkey AS uri, p_name || ', \"' || p_brand || '\"' AS label, p_type AS definition, row_number() OVER (ORDER BY p_partkey) - 1 AS ord FROM part")
def relation_file(spark: SparkSession, sf: str) -> DataFrame:
    """A relation schema as CSV without header, labels with commas and quotes, read in file order."""
    path = fresh_dir(spark, "schema")
    p = table(spark, sf, "part").orderBy("p_partkey")
    K.relation_csv(p.select(F.concat(F.lit("http://kg/part/"), "p_partkey").alias("uri"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label"), F.col("p_type").alias("definition")), path)
    return R.relation_schema(spark, path).select("uri", "label", "definition", "ord")


@query("""SELECT 'mention' AS kind, conv_id, turn, md5(text) AS text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT 'sft', conv_id, turn, role FROM conversations WHERE text IS NOT NULL
UNION ALL SELECT 'redefined', conv_id, turn, 'd' || turn FROM conversations WHERE text IS NOT NULL UNION ALL SELECT 'grid', conv_id, turn, (turn / 10.0::DOUBLE)::VARCHAR FROM conversations WHERE text IS NOT NULL""")
def json_files(spark: SparkSession, sf: str) -> DataFrame:
    """Mention definitions, fine-tuning rows, redefinitions and grid results as JSON, one file a task."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    forms = {
        "mention": (c.select("conv_id", "turn", F.array(F.struct(F.lit("e").alias("entity"), F.col("text").alias("definition"))).alias("found")), "found array<struct<entity:string,definition:string>>", F.md5(F.col("found")[0].definition)),
        "sft": (c.select("conv_id", "turn", F.array(F.struct("role", F.col("text").alias("content"))).alias("conversations")), "conversations array<struct<role:string,content:string>>", F.col("conversations")[0].role),
        "redefined": (c.select("conv_id", "turn", F.create_map(F.lit("rel"), F.concat(F.lit("d"), "turn")).alias("definitions")), "definitions map<string,string>", F.col("definitions")["rel"]),
        "grid": (c.select("conv_id", "turn", (F.col("turn") / F.lit(10.0)).alias("score")), "score double", F.col("score").cast("string")),
    }
    out = None
    for kind, (rows, ddl, value) in forms.items():
        path = fresh_dir(spark, kind)
        K.json_rows(rows, path)
        back = spark.read.schema(f"conv_id long, turn long, {ddl}").json(path).select(F.lit(kind).alias("kind"), "conv_id", "turn", value.alias("text"))
        out = back if out is None else out.unionAll(back)
    return out


INDEX_SQL = """SELECT q.vec_id AS query_id, b.vec_id AS cand_id, round(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id)::INT AS rank FROM embeddings q, embeddings b WHERE q.vec_id % 2 = 1 AND b.vec_id % 2 = 0 QUALIFY rank <= 10"""


@query(INDEX_SQL)
def index_files(spark: SparkSession, sf: str) -> DataFrame:
    """A cell index that was written and read again; with every cell probed its answers are exact."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = fresh_dir(spark, "index")
    V.CellIndex(e.where("id % 2 = 0"), cells=16).save(path)
    index = V.CellIndex.load(spark, path)
    hits = index.search(e.where("id % 2 = 1"), 10, index.cells)
    return hits.select("query_id", "cand_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT round AS epoch, count(*) AS n, sum(quality) AS good FROM labels, (SELECT unnest([1, 2]) AS round) GROUP BY round")
def metrics_file(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluator rows appended to one CSV table, an epoch at a time."""
    path = fresh_dir(spark, "metrics")
    rows = table(spark, sf, "labels")
    for epoch in (1, 2):
        K.metrics_csv(rows.agg(F.lit(epoch).alias("epoch"), F.count("*").alias("n"), F.sum("quality").alias("good")), path)
    return spark.read.schema("epoch int, n long, good long").csv(path, header=True)


@query("""SELECT o_orderkey, 'Relations: {''by'', ''has''} Triples: [[''o' || o_orderkey || ''', ''by'', ''c' || o_custkey || '''], [''o' || o_orderkey || ''', ''has'', "it''s"], [''x'', ''by'', ''y'']]' AS prompt FROM orders""")
def prompt_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Relations as a set literal without repeats, triples as a list of lists."""
    s = F.concat(F.lit("o"), "o_orderkey")
    t = F.array(*[F.struct(F.col(f"{i}s").alias("subj"), F.lit(r).alias("rel"), F.col(f"{i}o").alias("obj")) for i, r in enumerate(("by", "has", "by"))])
    rows = table(spark, sf, "orders").select("o_orderkey", s.alias("0s"), F.concat(F.lit("c"), "o_custkey").alias("0o"), s.alias("1s"), F.lit("it's").alias("1o"), F.lit("x").alias("2s"), F.lit("y").alias("2o"))
    rows = rows.select("o_orderkey", t.alias("t"))
    return rows.select("o_orderkey", X.fill("Relations: {relations} Triples: {triples}", relations=X.set_text(F.transform("t", lambda x: x.rel)), triples=X.triples_text(F.col("t"))).alias("prompt"))


@query("""SELECT doc_id, md5('Text: ' || coalesce(text, 'None') || chr(10) || 'Entities:') AS extract, md5('Text: ' || coalesce(text, 'None') || ' 1: [''' || lang || ''', ''d' || doc_id || '''] 2: []') AS merge FROM documents WHERE lang IS NOT NULL""")
def prompt_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The prompts that list and merge entities."""
    d = table(spark, sf, "documents").where("lang IS NOT NULL")
    first, second = X.list_text(F.array("lang", F.concat(F.lit("d"), "doc_id"))), X.list_text(F.array().cast("array<string>"))
    text = F.col("text")
    return d.select(
        "doc_id", F.md5(X.fill("Text: {input_text}\nEntities:", input_text=text)).alias("extract"), F.md5(X.fill("Text: {input_text} 1: {first} 2: {second}", input_text=text, first=first, second=second)).alias("merge")
    )


@query(f"SELECT p_partkey, '{X.STS_PREFIX}' || p_name AS query, p_name AS document, p_type AS retrieval FROM part")
def query_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Prefixes stand before queries, not documents; retrieval has none."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.as_query(F.col("p_name")).alias("query"), F.col("p_name").alias("document"), X.as_query(F.col("p_type"), X.RETRIEVAL_PREFIX).alias("retrieval"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <= 2 THEN 'c' || (o_orderkey % 5) END AS chosen FROM orders")
def parse_id(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with a 0-based id: in range, out of range, and no JSON at all."""
    k = F.col("o_orderkey") % 5
    answer = F.when(k == 4, F.lit("no answer")).otherwise(F.concat(F.lit('{"ID": '), k, F.lit("}")))
    cands = F.array(*[F.lit(f"c{i}") for i in range(3)])
    return table(spark, sf, "orders").select("o_orderkey", P.answered_id(answer, cands).alias("chosen"))


@query(f"WITH {CONTAINER_SQL} SELECT kind, count(*) AS n FROM el WHERE kind <> 'relation' GROUP BY kind")
def index_elements(spark: SparkSession, sf: str) -> DataFrame:
    """What the entity index holds, by kind: relations are left out."""
    return C.index_candidates(container_of(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey AS gold, array_to_string(c[1:3], ',') AS candidates FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN [-1, o_custkey, -2] WHEN 1 THEN [-1, -2, o_custkey] ELSE [-1, -2, -3, o_custkey] END AS c FROM orders) WHERE list_contains(c[1:3], o_custkey)""")
def gold_in_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The gold candidate is appended before the cut to three, so some examples lose it and go."""
    g, k = F.col("o_custkey"), F.col("o_orderkey") % 3
    low = [F.lit(-i).cast(table(spark, sf, "orders").schema["o_custkey"].dataType) for i in (1, 2, 3)]
    cands = F.when(k == 0, F.array(low[0], g, low[1])).when(k == 1, F.array(low[0], low[1])).otherwise(F.array(*low))
    out = S.gold_in_candidates(table(spark, sf, "orders").select("o_orderkey", g.alias("gold"), cands.alias("candidates")), 3)
    return out.select("o_orderkey", "gold", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


class Flaky:
    """A remote end that fails on every batch's first call."""

    def __init__(self) -> None:
        self.failed = False

    def __call__(self, prompts: list[str], max_tokens: int, n: int) -> list[list[str]]:
        self.failed = not self.failed
        if self.failed:
            raise ConnectionError("busy")
        return [[p.upper()] * n for p in prompts]


@query("SELECT p_partkey, upper(p_name) AS answer, false AS local_is_remote, true AS named_is_remote FROM part")
def remote_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completions of a remote model whose every first call fails; routing is by name."""
    model = M.Retrying(Flaky(), attempts=3, wait=0.0)
    return table(spark, sf, "part").select("p_partkey", M.complete(model, F.col("p_name")).alias("answer"), F.lit(M.is_remote("mistral")).alias("local_is_remote"), F.lit(M.is_remote("gpt-x")).alias("named_is_remote"))


@query("""WITH s AS (SELECT vec_id, embedding[8 * (vec_id % 8) + 1 : 8 * (vec_id % 8) + 8]::DOUBLE[] AS x FROM embeddings)
SELECT vec_id, round(x[1] / sqrt(list_dot_product(x, x)), 5) AS first, round(x[8] / sqrt(list_dot_product(x, x)), 5) AS last FROM s""")
def last_token_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as eight tokens of eight numbers each; the state of the last token that counts, at length 1."""
    e = table(spark, sf, "embeddings")
    out = e.select("vec_id", M.pooled(F.col("embedding"), (F.col("vec_id") % 8 + 1).cast("int"), 8).alias("x"))
    return out.select("vec_id", F.round(F.col("x")[0].cast("double"), 5).alias("first"), F.round(F.col("x")[7].cast("double"), 5).alias("last"))


@query("SELECT 'http://kg/part/' || p_partkey AS identifier, p_name AS label FROM part UNION ALL SELECT 'http://www.w3.org/2002/07/owl#Class', 'concept'")
def cached_container(spark: SparkSession, sf: str) -> DataFrame:
    """A container with the class of classes, written at the first call and read at the second."""
    path = fresh_dir(spark, "container")
    parts = container_of(spark, sf).where("identifier LIKE 'http://kg/part/%'")
    C.stored(lambda: C.with_class_of_classes(parts), spark, path)
    return C.stored(lambda: parts.limit(0), spark, path).select("identifier", "label")
