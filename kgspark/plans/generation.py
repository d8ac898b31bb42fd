"""Generated descriptions, model disambiguation, and the builders around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions import models as M
from kgspark.functions import parsers as P
from kgspark.functions import text as X
from kgspark.operators import sampling as S
from kgspark.plans.registry import query, table
from kgspark.plans.training import draw_sql
from kgspark.session import spread
from kgspark.sources import readers as R

DISAMBIGUATE = "Which candidate is meant?\nMention: {mention}\nCandidates:\n{candidates}\nAnswer with a number:"
MENTIONS = "Describe how the entities are mentioned, as JSON.\nText: {text}\nEntities to describe: {entities}\nAnswer:"
REDEFINE = "Define the relation as JSON.\nRelation: {label}\nCurrent definition: {definition}\nAnswer:"


def shuffled(options: Column, *ids: Column, seed: int = 0) -> Column:
    """Options in a pseudo-random order that depends on the row's ids and each option's place."""
    keyed = F.transform(options, lambda o, i: F.struct(S.draw(*ids, i, seed=seed).alias("d"), i.alias("i"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x.o)


def disambiguate(rows: DataFrame, model: M.Completer, compat: bool = False) -> DataFrame:
    """``rows`` (mention, candidates as texts, ids) with ``chosen``: the id at the model's number, null for none and for no candidates."""
    prompt = X.fill(DISAMBIGUATE, mention=F.col("mention"), candidates=X.numbered_candidates(F.col("candidates")))
    said = rows.withColumn("said", M.complete(model, F.when(F.size("candidates") > 0, prompt), 8))
    return said.withColumn("chosen", F.try_element_at("ids", X.chosen_number(F.col("said"), F.size("candidates"), compat) + 1)).drop("said")


def mention_definitions(examples: DataFrame, model: M.Completer, samples: int = 1, required: tuple[str, ...] = ("entity", "surface_form", "definition", "type")) -> DataFrame:
    """``(doc_id, sample, <required>)``: generated objects with all required keys, the first of equal entities in a sample.

    ``examples`` is (doc_id, text, entities array<string>).
    """
    prompt = X.fill(MENTIONS, text=F.col("text"), entities=X.list_text(F.col("entities")))
    said = spread(examples).select("doc_id", M.complete_samples(model, prompt, samples).alias("texts"))
    each = said.select("doc_id", F.posexplode("texts").alias("sample", "t"))
    return each.select("doc_id", "sample", F.inline(P.parse_generated(F.col("t"), list(required))))


def redefined(schema: DataFrame, model: M.Completer, samples: int = 3) -> DataFrame:
    """The schema with the first usable of ``samples`` new definitions; relations without one keep theirs, marked by ``missing``."""
    prompt = X.fill(REDEFINE, label=F.col("label"), definition=F.col("definition"))
    said = schema.withColumn("texts", M.complete_samples(model, prompt, samples))
    new = said.withColumn("new", P.first_definition(F.col("texts")))
    return new.select(*[c for c in schema.columns if c != "definition"], F.coalesce("new", "definition").alias("definition"), F.col("new").isNull().alias("missing"))


def definitions_by_relation(rows: DataFrame) -> DataFrame:
    """``(rel, definitions)``: distinct definitions of each relation, sorted."""
    return rows.groupBy("rel").agg(F.sort_array(F.collect_set("definition")).alias("definitions"))


def samples(rows: DataFrame, most: int, per_sentence: int = 2) -> DataFrame:
    """The first ``most`` samples in order with at most ``per_sentence`` of a sentence; ``rows`` is (ord, pos, ...), ties go by the other columns."""
    rest = [c for c in rows.columns if c not in ("ord", "pos")]
    w = Window.partitionBy("ord").orderBy("pos", *rest)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_sentence).drop("__r").orderBy("ord", "pos", *rest).limit(most)


class Rules:
    """Objects by rule: a definition for every entity or relation of a prompt, none for every third relation."""

    def complete(self, prompts: list[str], max_tokens: int = 64, n: int = 1) -> list[list[str]]:
        out = []
        for p in prompts:
            if "Relation: " in p:
                label = p.split("Relation: ")[1].split("\n")[0]
                out.append(["nothing", '{"definition": 1}', '{"definition": "%s redefined"}' % label][:n] if len(label) % 3 else ["nothing"] * n)
            elif "Candidates:" in p:
                out.append([str(len(p.split("Mention: ")[1].split("\n")[0]) % 4)] * n)
            else:
                names = p.split("Entities to describe: [")[1].split("]")[0].replace("'", "").split(", ")
                out.append(["[" + ", ".join('{"entity":"%s","surface_form":"%s","definition":"d","type":"t"}' % (x, x) for x in names) + ', {"entity":"x"}]'] * n)
        return out


@query(f"""SELECT o_orderkey, string_agg(c, '|' ORDER BY d, i) AS options FROM (SELECT o_orderkey, unnest(['a', 'b', 'c', 'd']) AS c, unnest([0, 1, 2, 3]) AS i FROM orders) x,
LATERAL (SELECT {draw_sql('o_orderkey', 'i')} AS d) GROUP BY o_orderkey""")
def shuffled_candidates(spark: SparkSession, sf: str) -> DataFrame:
    options = F.array(*map(F.lit, "abcd"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(shuffled(options, F.col("o_orderkey")), "|").alias("options"))


@query("SELECT c_custkey, CASE length(c_name || c_mktsegment) % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS chosen FROM customer")
def llm_disambiguate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", "c_mktsegment").alias("mention"), F.array(F.lit("x"), F.lit("y")).alias("candidates"), F.array(F.lit("a"), F.lit("b")).alias("ids"))
    return disambiguate(rows, Rules()).select("c_custkey", "chosen")


@query("SELECT c_custkey AS doc_id, s::INT AS sample, e AS entity, e AS surface_form, 'd' AS definition, 't' AS type FROM (SELECT c_custkey, unnest([c_name, c_mktsegment]) AS e FROM customer), (SELECT unnest([0, 1]) AS s)")
def generated_definitions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("t").alias("text"), F.array("c_name", "c_mktsegment").alias("entities"))
    return mention_definitions(rows, Rules(), 2)


@query("SELECT p_partkey, p_name AS label, CASE WHEN length(p_name) % 3 <> 0 THEN p_name || ' redefined' ELSE p_brand END AS definition, length(p_name) % 3 = 0 AS missing FROM part")
def regenerated_definitions(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("label"), F.col("p_brand").alias("definition"))
    return redefined(schema, Rules())


@query("SELECT p_type AS rel, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS definitions FROM part GROUP BY p_type")
def relation_definition_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_type").alias("rel"), F.col("p_brand").alias("definition"))
    return definitions_by_relation(rows).select("rel", F.array_join("definitions", "|").alias("definitions"))


@query("SELECT ord, pos, l_partkey FROM (SELECT l_orderkey AS ord, l_linenumber AS pos, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 2 ORDER BY ord, pos, l_partkey LIMIT 5000")
def limited_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first samples of a dataset, two a sentence; the limit is the builder's own."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("pos"), "l_partkey")
    return samples(rows, 5000)


@query("SELECT avg(CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing FROM part")
def missing_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return R.missing_share(table(spark, sf, "part").select(F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("mention")))
