"""Queries over terms, descriptions, prompts and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import parsers as P
from kgspark.functions import text as X
from kgspark.operators import container as C
from kgspark.operators import linking as L
from kgspark.plans.registry import query, table
from kgspark.session import spread
from kgspark.sources import readers as R



def part_lines(spark: SparkSession, sf: str) -> DataFrame:
    """N-Triples of parts: two labels, a comment, aliases and a type."""
    p = spread(table(spark, sf, "part"))
    subject = "concat('<http://kg/part/', p_partkey, '> ')"
    return p.select(
        F.explode(F.array(*[
            F.expr(f"concat({subject}, {rest})")
            for rest in (
                f"'<{C.LABEL}> \"', p_name, '\"@en .'",
                f"'<{C.LABEL}> \"aa ', p_name, '\"@de .'",
                f"'<{C.COMMENT}> \"', p_type, ' of ', p_brand, '\" .'",
                f"'<{C.ALIAS}> \"', p_brand, '\" .'",
                f"'<{C.ALIAS}> \"', p_type, '\"@en-gb .'",
                f"'<{C.TYPE}> <http://kg/brand/', replace(p_brand, '#', ''), '> .'",
            )
        ])).alias("value")
    )


PART_SQL = f"""lines AS (
  SELECT '<http://kg/part/' || p_partkey || '> ' || r AS value FROM part, LATERAL (SELECT unnest([
    '<{C.LABEL}> "' || p_name || '"@en .', '<{C.LABEL}> "aa ' || p_name || '"@de .', '<{C.COMMENT}> "' || p_type || ' of ' || p_brand || '" .',
    '<{C.ALIAS}> "' || p_brand || '" .', '<{C.ALIAS}> "' || p_type || '"@en-gb .', '<{C.TYPE}> <http://kg/brand/' || replace(p_brand, '#', '') || '> .']) AS r)
), nt AS (SELECT regexp_extract(value, '{R.NT}', 1) AS s, regexp_extract(value, '{R.NT}', 2) AS p, regexp_extract(value, '{R.NT}', 3) AS o FROM lines)"""


@query(f"WITH {PART_SQL} SELECT s, p, o FROM nt")
def nt_parse(spark: SparkSession, sf: str) -> DataFrame:
    return R.parse_nt(part_lines(spark, sf))


@query(f"WITH {PART_SQL} SELECT o, CASE WHEN starts_with(o, '<') THEN substr(o, 2, length(o) - 2) ELSE replace(regexp_replace(o, '\"@en$', '\"'), '\"', '') END AS term, "
       "CASE WHEN starts_with(o, '<') THEN substr(o, 2, length(o) - 2) ELSE replace(replace(o, '@en', ''), '\"', '') END AS compat_term FROM nt")
def term_normalise(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o")
    return R.parse_nt(part_lines(spark, sf)).select("o", X.normalise_term(o).alias("term"), X.normalise_term(o, compat=True).alias("compat_term"))


@query("""SELECT c_custkey, CASE WHEN position('@' IN v) > 0 THEN left(v, length(v) - length(split_part(v, '@', -1)) - 1) ELSE v END AS text, CASE WHEN position('@' IN v) > 0 THEN split_part(v, '@', -1) ELSE '' END AS tag
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || '@en' ELSE c_name || '@' || c_mktsegment || '@de' END AS v FROM customer)""")
def lang_tag_split(spark: SparkSession, sf: str) -> DataFrame:
    v = F.expr("CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat(c_name, '@en') ELSE concat(c_name, '@', c_mktsegment, '@de') END")
    return table(spark, sf, "customer").select("c_custkey", X.split_tag(v).alias("x")).select("c_custkey", "x.text", "x.tag")


def container_of(spark: SparkSession, sf: str) -> DataFrame:
    line = lambda df, expr: df.select(F.expr(expr).alias("value"))
    n, p = table(spark, sf, "nation"), table(spark, sf, "part")
    brands = p.select("p_brand").distinct()
    classes = line(brands, f"concat('<http://kg/brand/', replace(p_brand, '#', ''), '> <{C.LABEL}> \"', p_brand, '\"@en .')")
    relations = line(n, f"concat('<http://kg/nation/', n_nationkey, '> <{C.LABEL}> \"', n_name, '\" .')")
    return C.container(
        C.elements(R.parse_nt(part_lines(spark, sf)), "entity"), C.elements(R.parse_nt(relations), "relation"), C.elements(R.parse_nt(classes), "class")
    )


CONTAINER_SQL = """el AS (
  SELECT 'http://kg/part/' || p_partkey AS identifier, 'entity' AS kind, p_name AS label, p_type || ' of ' || p_brand AS definition,
    least(p_brand, p_type) || '|' || greatest(p_brand, p_type) AS aliases, 'http://kg/brand/' || replace(p_brand, '#', '') AS types FROM part
  UNION ALL SELECT 'http://kg/nation/' || n_nationkey, 'relation', n_name, '', '', '' FROM nation
  UNION ALL SELECT DISTINCT 'http://kg/brand/' || replace(p_brand, '#', ''), 'class', p_brand, '', '', '' FROM part
)"""


@query(f"WITH {CONTAINER_SQL} SELECT * FROM el")
def kg_container(spark: SparkSession, sf: str) -> DataFrame:
    return container_of(spark, sf).select("identifier", "kind", "label", "definition", F.array_join("aliases", "|").alias("aliases"), F.array_join("types", "|").alias("types"))


@query(f"WITH {CONTAINER_SQL} SELECT identifier, label FROM el WHERE kind <> 'relation'")
def label_select(spark: SparkSession, sf: str) -> DataFrame:
    return C.index_candidates(container_of(spark, sf)).select("identifier", "label")


@query(f"WITH {CONTAINER_SQL} SELECT e.identifier, coalesce(t.label, '') AS type_labels FROM el e LEFT JOIN el t ON e.types = t.identifier")
def type_labels(spark: SparkSession, sf: str) -> DataFrame:
    return C.type_labels(container_of(spark, sf)).select("identifier", F.array_join("type_labels", "|").alias("type_labels"))


@query("""SELECT label, arg_max(uri, ord) AS uri, arg_max(definition, ord) AS definition, max(ord) AS ord FROM (
  SELECT p_type AS label, 'http://kg/rel/' || p_partkey AS uri, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_brand END AS definition, p_partkey::BIGINT AS ord FROM part) GROUP BY label""")
def relation_schema_dedup(spark: SparkSession, sf: str) -> DataFrame:
    alt = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise("")  # an empty alternative doesn't count
    rows = table(spark, sf, "part").select(
        F.col("p_type").alias("label"), F.concat(F.lit("http://kg/rel/"), "p_partkey").alias("uri"),
        F.coalesce(F.nullif(alt, F.lit("")), "p_brand").alias("definition"), F.col("p_partkey").cast("long").alias("ord"),
    )
    return R.last_by_label(rows).select("label", "uri", "definition", "ord")




@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || ': ' || p_brand ELSE p_name || ' (' || array_to_string(list_filter([p_type, '', p_brand, p_name, p_type], lambda x: x <> '')[1:3], ', ') || '): ' || p_brand END AS description FROM part""")
def full_description(spark: SparkSession, sf: str) -> DataFrame:
    types = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(F.array("p_type", F.lit(""), "p_brand", "p_name", "p_type"))
    return table(spark, sf, "part").select("p_partkey", X.full_description(F.col("p_name"), F.col("p_brand"), types).alias("description"))


@query("SELECT p_partkey, p_name || ' (' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type || ', ' || p_brand END || '): ' || p_brand AS description FROM part")
def ce_description(spark: SparkSession, sf: str) -> DataFrame:
    types = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand"))
    return table(spark, sf, "part").select("p_partkey", X.pair_text(F.col("p_name"), F.col("p_brand"), types).alias("description"))


OIE = "Find triples.\n{few_shot_examples}\nText: {input_text}\nEntities: {entities_hint}\nRelations: {relations_hint}\nTriples:"


@query("""SELECT doc_id, md5('Find triples.
none
Text: ' || text || '
Entities: ' || CASE WHEN doc_id % 2 = 0 THEN 'None' ELSE lang END || '
Relations: None
Triples:') AS prompt FROM documents""")
def prompt_oie(spark: SparkSession, sf: str) -> DataFrame:
    hint = F.when(F.col("doc_id") % 2 == 1, F.col("lang"))
    prompt = X.fill(OIE, few_shot_examples=F.lit("none"), input_text=F.col("text"), entities_hint=hint, relations_hint=F.lit(None))
    return table(spark, sf, "documents").select("doc_id", F.md5(prompt).alias("prompt"))


@query("""SELECT p_partkey, 'A. ' || p_name || chr(10) || 'B. ' || p_type || chr(10) || 'C. None of the above.' AS letters, '1. ' || p_name || chr(10) || '2. ' || p_type || chr(10) || '3. None' AS numbers FROM part""")
def prompt_choices(spark: SparkSession, sf: str) -> DataFrame:
    options = F.array("p_name", "p_type")
    return table(spark, sf, "part").select("p_partkey", X.lettered_choices(options).alias("letters"), X.numbered_candidates(options).alias("numbers"))


@query("""SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn, role, text) || '<|assistant|>' || chr(10) || 'Triplets: ') AS prompt, count(*) AS turns FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id""")
def chat_template(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("text IS NOT NULL AND role IS NOT NULL")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(F.md5(X.chat(turns, "Triplets: ")).alias("prompt"), F.count("*").alias("turns"))


def completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completions that a model might give about orders."""
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.expr("""concat('Triples: [[''order ', o_orderkey, ''', ''placed by'', ''cust ', o_custkey, '''], [''order ', o_orderkey, ''', ''has status'', ''', CASE WHEN o_orderkey % 3 = 0 THEN '_' ELSE o_orderstatus END, ''']]')""").alias("triples"),
        F.expr("""concat('The entities are [''order ', o_orderkey, ''', ''cust ', o_custkey, '''] and [''more'']')""").alias("entities"),
        F.expr("""concat('- placed by: who: ', o_custkey, '\\nhas status : ', o_orderstatus, '\\nno colon\\nAnswer: x\\nhas status: ', o_orderpriority)""").alias("definitions"),
        F.expr("""concat('Sure: [{"entity":"a', o_orderkey % 7, '","definition":"d', o_custkey, '","type":"t"}, 3, {"entity":"a', o_orderkey % 7, '","definition":"later"}] end')""").alias("mentions"),
        F.expr("concat(char(65 + o_orderkey % 30), '. yes')").alias("letter"),
        F.expr("concat('I choose ', o_orderkey % 14, '.')").alias("number"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS n, 'order ' || o_orderkey || '|placed by|cust ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ';order ' || o_orderkey || '|has status|' || o_orderstatus END AS triples FROM orders""")
def parse_triples_flat(spark: SparkSession, sf: str) -> DataFrame:
    t = completions(spark, sf).select("o_orderkey", P.parse_triples_flat(F.col("triples")).alias("t"))
    return t.select("o_orderkey", F.size("t").alias("n"), F.array_join(F.transform("t", lambda x: F.concat_ws("|", x.subj, x.rel, x.obj)), ";").alias("triples"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS n, 'order ' || o_orderkey || '|placed by|cust ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ';order ' || o_orderkey || '|has status|' || o_orderstatus END AS triples FROM orders""")
def parse_triples_literal(spark: SparkSession, sf: str) -> DataFrame:
    t = completions(spark, sf).select("o_orderkey", P.parse_triples("triples").alias("t"))
    return t.select("o_orderkey", F.size("t").alias("n"), F.array_join(F.transform("t", lambda x: F.array_join(x, "|")), ";").alias("triples"))


@query("SELECT o_orderkey, 'order ' || o_orderkey || '|cust ' || o_custkey AS entities FROM orders")
def parse_entities(spark: SparkSession, sf: str) -> DataFrame:
    return completions(spark, sf).select("o_orderkey", F.array_join(P.parse_entities_flat(F.col("entities")), "|").alias("entities"))


@query("SELECT o_orderkey, 'who: ' || o_custkey AS placed_by, o_orderpriority AS has_status, 2 AS n FROM orders")
def parse_rel_defs(spark: SparkSession, sf: str) -> DataFrame:
    m = completions(spark, sf).select("o_orderkey", P.parse_definitions(F.col("definitions")).alias("m"))
    return m.select("o_orderkey", F.col("m")["placed by"].alias("placed_by"), F.col("m")["has status"].alias("has_status"), F.size("m").alias("n"))


@query("""SELECT o_orderkey, 'a0' AS entity, CASE WHEN o_orderkey % 7 = 0 THEN 'later' ELSE '' END AS definition, '' AS type, o_orderkey % 7 <> 0 AS stub FROM orders
UNION ALL SELECT o_orderkey, 'a1', CASE WHEN o_orderkey % 7 = 1 THEN 'later' ELSE '' END, '', o_orderkey % 7 <> 1 FROM orders""")
def parse_json_mentions(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(F.lit("a0"), F.lit("a1"))
    return completions(spark, sf).select("o_orderkey", F.inline(P.parse_mentions(F.col("mentions"), wanted)))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 30 < 10 THEN (o_orderkey % 30)::INT END AS choice FROM orders")
def parse_letter(spark: SparkSession, sf: str) -> DataFrame:
    return completions(spark, sf).select("o_orderkey", X.chosen_letter(F.col("letter"), F.lit(10)).alias("choice"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 14 BETWEEN 1 AND 10 THEN (o_orderkey % 14 - 1)::INT END AS choice,
CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 14 <= 10 THEN (o_orderkey % 14 - 1)::INT ELSE greatest(o_orderkey % 14 - 10, 1)::INT - 1 END AS compat_choice FROM orders""")
def parse_number(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("number")
    return completions(spark, sf).select("o_orderkey", X.chosen_number(n, F.lit(10)).alias("choice"), X.chosen_number(n, F.lit(10), compat=True).alias("compat_choice"))


@query("SELECT event_id, json_extract_string(props, '$.' || (SELECT min(k) FROM (SELECT unnest(json_keys(props)) AS k))) AS first_value, len(json_keys(props))::INT AS n FROM events WHERE json_valid(props)")
def parse_json_props(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$', 'map<string,string>')").alias("m")).where("m IS NOT NULL")
    return m.select("event_id", F.col("m")[F.array_min(F.map_keys("m"))].alias("first_value"), F.size("m").alias("n"))


@query("SELECT doc_id, md5(array_to_string(string_split(text, ' ')[1:20], ' ')) AS short FROM documents WHERE text IS NOT NULL")
def truncate_desc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(X.truncated(F.col("text"), 20)).alias("short"))


@query("""SELECT doc_id, max(n)::INT AS words FROM (SELECT doc_id, n FROM documents, (SELECT unnest(range(0, 257, 32)) AS n) WHERE text IS NOT NULL AND least(n, len(string_split(text, ' '))) + doc_id % 200 <= 300) GROUP BY doc_id""")
def shrink_to_fit(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", X.shrunk(F.col("text"), F.col("doc_id") % 200, 300).alias("words"))


@query("""SELECT p_partkey, trim(lower(regexp_replace(replace(regexp_replace(p_brand || p_type || '_' || p_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '\\s+', ' ', 'g'))) AS term FROM part""")
def webnlg_normalise(spark: SparkSession, sf: str) -> DataFrame:
    x = F.concat(F.col("p_brand"), F.col("p_type"), F.lit("_"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.webnlg(x).alias("term"))


@query("""WITH b AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark)
SELECT d.doc_id, b.item_id FROM documents d JOIN b ON d.doc_id % b.n = b.k
WHERE contains(lower(d.text), lower(split_part(b.text, ' ', 1))) AND contains(lower(d.text), lower(split_part(b.text, ' ', 3)))""")
def tekgen_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against passages, dealt out by the number of passages, so that every passage meets its share."""
    word = lambda i: F.split_part("b", F.lit(" "), F.lit(i))
    d, b = table(spark, sf, "documents"), L.dense_numbers(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("b")), "item_id", "k")
    rows = d.join(b, F.pmod("doc_id", F.lit(max(1, b.count()))) == F.col("k")).withColumn("triples", F.array(F.array(word(1), word(2), word(3))))
    return rows.where(R.in_sentence(F.col("text"), F.col("triples"))).select("doc_id", "item_id")
