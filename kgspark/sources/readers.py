"""Sources: texts, JSON, N-Triples, schemas, stage results, training data. All schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import relation_text

TRIPLES = "array<array<string>>"
DATASET = f"text string, input_text string, triplets {TRIPLES}, linked_triplets {TRIPLES}, index long"
STAGES = (
    "index long, input_text string, entity_hint string, relation_hint string, oie array<array<string>>, schema_definition map<string,string>, "
    f"canonicalization_candidates string, schema_canonicalizaiton {TRIPLES}"
)
GENERATED = (
    "text string, entities array<struct<qid:string,candidate_mention:string,candidate_definition:string,candidate_types:array<string>>>, "
    "triples array<array<string>>, generated_text array<string>, generated_entities array<struct<entity:string,surface_form:variant,definition:variant,types:variant,type:variant>>"
)
TEKGEN = f"sentence string, triples {TRIPLES}"
DEFINITIONS = "text string, triplets string, relations string, definitions string"
#: Fixed value: subject, predicate, and the rest up to the final full stop.
NT = r"^\s*(\S+)\s+(\S+)\s+(.*?)\s*\.\s*$"


def numbered(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """A dense number for each row of a scan, in order of file names and places in them, however the splits are dealt to tasks.

    Splits are counted first, so nothing comes together in one task; the driver holds one row a split.
    """
    spark = df.sparkSession
    tagged = df.withColumn("__file", F.input_file_name()).withColumn("__at", F.input_file_block_start()).withColumn("__row", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("__row", 33)
    splits = tagged.groupBy("__file", "__at", part.alias("part")).agg(F.count("*").alias("n"), F.min("__row").alias("first")).collect()
    base, rows = 0, []
    for r in sorted(splits, key=lambda r: (r["__file"], r["__at"], r.part)):
        rows.append((r.part, r["__file"], r["__at"], base - r["first"]))
        base += r.n
    starts = F.broadcast(spark.createDataFrame(rows, "__p long, __f string, __a long, __base long"))  # one row a split
    same = (part == F.col("__p")) & (F.col("__file") == F.col("__f")) & (F.col("__at") == F.col("__a"))
    return tagged.join(starts, same).withColumn(name, F.col("__base") + F.col("__row")).drop("__row", "__file", "__at", "__p", "__f", "__a", "__base")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)``, one row a line; plain or gzip by suffix."""
    return numbered(spark.read.text(path).select(F.col("value").alias("text"))).select("doc_id", "text")


def whole_text(spark: SparkSession, path: str) -> str:
    """A small file, such as a prompt, as one string."""
    return spark.read.text(path, wholetext=True).first().value


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text, triples)`` of a JSON array or JSON lines file, plain or gzip; ``triplets`` counts before ``linked_triplets``.

    Other suffixes raise.
    """
    bare = path.removesuffix(".gz")
    if bare.endswith(".json"):
        rows = spark.read.schema(DATASET).json(path, multiLine=True)
    elif bare.endswith(".jsonl"):
        rows = spark.read.schema(DATASET).json(path)
    else:
        raise ValueError(f"unknown file type: {path}")
    return numbered(rows).select("doc_id", F.coalesce("text", "input_text").alias("text"), F.coalesce("triplets", "linked_triplets").alias("triples"))


def exploded(docs: DataFrame, column: str = "triples") -> DataFrame:
    """``(doc_id, pos, s, p, o)``."""
    return docs.select("doc_id", F.posexplode(column).alias("pos", "t")).select("doc_id", "pos", F.col("t")[0].alias("s"), F.col("t")[1].alias("p"), F.col("t")[2].alias("o"))


def parse_nt(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(s, p, o)`` of N-Triples lines as written; comments, blank lines and broken lines are dropped.

    A line is matched and cut up once. The explode keeps conditions on terms behind the parsing: pushed before it, they would repeat it for each mention of a term, and for all rows of what lines are made of.
    """
    line = F.col(value)
    parts = F.split(F.regexp_replace(line, NT + r"[\s\S]*", "$1\n$2\n$3"), "\n")  # no part holds a line end
    found = lines.select(F.explode(F.array(F.when(line.rlike(NT) & ~line.rlike(r"^\s*#"), parts))).alias("t")).where("t IS NOT NULL")
    return found.select(*[F.col("t")[i].alias(c) for i, c in enumerate("spo")])


def nt(spark: SparkSession, path: str) -> DataFrame:
    return parse_nt(spark.read.text(path))


def relation_schema(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """``(uri, label, definition, ord)`` of a schema file with two or three columns; other widths raise when read."""
    if columns not in (2, 3):
        raise ValueError("a schema has two or three columns")
    names = ["uri", "label", "definition"][3 - columns :]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, mode="FAILFAST", quote='"', escape='"')
    return numbered(rows, "ord").select(F.col("uri") if columns == 3 else F.lit(None).cast("string").alias("uri"), "label", "definition", "ord")


def last_by_label(schema: DataFrame) -> DataFrame:
    """One row a label: the last one wins."""
    return schema.groupBy("label").agg(F.max_by("uri", "ord").alias("uri"), F.max_by("definition", "ord").alias("definition"), F.max("ord").alias("ord"))


def definitions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file with header; quoted fields keep their line ends and white space, empty ones are empty texts."""
    return spark.read.schema(DEFINITIONS).csv(
        path, header=True, multiLine=True, quote='"', escape='"', lineSep="\n", nullValue="\0", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All splits of a stored dataset with their names, or one of them."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def in_sentence(sentence: Column, triples: Column) -> Column:
    """Every triple has three parts, and its subject and object stand in the sentence in either case."""
    low = F.lower(sentence)
    return F.forall(triples, lambda t: (F.size(t) == 3) & F.contains(low, F.lower(t[0])) & F.contains(low, F.lower(t[2])))


def tekgen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEKGEN).json(path).where(in_sentence(F.col("sentence"), F.col("triples")))


def latest_stage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Stage results and enriched schema of the highest ``iter=N`` folder, and N."""
    stages = spark.read.schema(f"{STAGES}, iter int").json(f"{path}/stages")
    n = stages.agg(F.max("iter")).first()[0]
    schema = spark.read.schema("ord long, label string, definition string, iter int").json(f"{path}/schema").where(F.col("iter") == n).drop("iter")
    return stages.where(F.col("iter") == n).drop("iter"), schema, n


def relation_examples(spark: SparkSession, path: str) -> DataFrame:
    """``(rel, text, triple)`` of a JSON object from relations to lists of examples."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rels = v.select(F.expr("variant_get(v, '$', 'map<string,array<struct<text:string,triplet:array<string>>>>')").alias("m"))
    return rels.select(F.explode("m").alias("rel", "xs")).select("rel", F.explode("xs").alias("x")).select("rel", "x.text", F.col("x.triplet").alias("triple"))


def generated_mentions(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.schema(GENERATED).json(path))


def _first(v: Column) -> Column:
    """A variant that is a string or a list of strings as its (first) string."""
    return F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$", "string"))


def training_examples(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """``(doc_id, qid, mention, definition, types)``: entities of an example with what was generated for their label.

    Unknown qids are dropped, entities without generated fields stay bare, the last of equal labels wins.
    """
    ents = rows.select("doc_id", F.posexplode("entities").alias("pos", "e")).select("doc_id", "pos", "e.qid")
    said = rows.select("doc_id", F.posexplode("generated_entities").alias("k", "g")).groupBy("doc_id", F.col("g.entity").alias("label")).agg(F.max_by("g", "k").alias("g"))
    known = ents.join(elements.select(F.col("identifier").alias("qid"), "label"), "qid")
    types = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.filter(F.array(F.try_variant_get(v, "$", "string")), lambda x: x.isNotNull()))
    return known.join(said, ["doc_id", "label"], "left").select(
        "doc_id", "pos", "qid", _first(F.col("g.surface_form")).alias("mention"), _first(F.col("g.definition")).alias("definition"), types(F.coalesce("g.types", "g.type")).alias("types")
    )


def missing_share(examples: DataFrame) -> DataFrame:
    return examples.agg(F.coalesce(F.avg(F.col("mention").isNull().cast("double")), F.lit(0.0)).alias("missing"))


def entries_xml(spark: SparkSession, path: str) -> DataFrame:
    """``(entry_id, triples)`` of benchmark XML, one row an ``entry``; triples are its ``mtriple`` texts."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("_eid string, modifiedtripleset struct<mtriple:array<string>>, generatedtripleset struct<gtriple:array<string>>").load(path)
    return rows.select(F.col("_eid").alias("entry_id"), F.coalesce("modifiedtripleset.mtriple", "generatedtripleset.gtriple").alias("triples"))


def retrieval_texts(schema: DataFrame) -> DataFrame:
    """Texts that stand for a relation: with its name for the retriever, the definition alone for the canonicaliser."""
    return schema.select("label", relation_text(F.col("label"), F.col("definition")).alias("retriever_text"), F.col("definition").alias("canonical_text"))
