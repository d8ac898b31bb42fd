"""The knowledge-graph container: statements of a graph folded into one row per element."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import normalise_term, split_tag

#: The predicates that a container reads.
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
COMMENT = "http://www.w3.org/2000/01/rdf-schema#comment"
ALIAS = "http://www.w3.org/2004/02/skos/core#altLabel"
#: The element that stands for the class of classes.
CLASS_OF_CLASSES = (
    "http://www.w3.org/2002/07/owl#Class",
    "concept",
    "semantic unit understood in different ways, e.g. as mental representation, ability or abstract object (philosophy)",
)
#: Later kinds win where an identifier occurs in several.
KINDS = ("entity", "relation", "class")


def statements(raw: DataFrame) -> DataFrame:
    """``(s, p, text, tag)`` of raw N-Triples terms: brackets and quotes gone, language tags apart."""
    literal = F.col("o").startswith('"')
    # a tag stands behind the closing quote
    tag = F.when(literal, F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1)).otherwise(F.lit(""))
    text = F.when(literal, F.regexp_extract("o", r'^"(.*)"[^"]*$', 1)).otherwise(normalise_term(F.col("o")))
    return raw.select(normalise_term(F.col("s")).alias("s"), normalise_term(F.col("p")).alias("p"), text.alias("text"), tag.alias("tag"))


def _preferred(predicate: str) -> Column:
    """The smallest text, English or untagged ones before others."""
    own = F.col("p") == predicate
    rank = F.when(F.col("tag").isin("", "en"), 0).otherwise(1)
    return F.min(F.when(own, F.struct(rank.alias("r"), F.col("text").alias("x"))))


def elements(raw: DataFrame, kind: str) -> DataFrame:
    """``(identifier, kind, label, definition, aliases, types)`` of every subject with a label.

    One partial aggregate by subject. Aliases and types are sorted; repeats stay.
    """
    several = lambda p: F.sort_array(F.collect_list(F.when(F.col("p") == p, F.col("text"))))
    rows = statements(raw).groupBy(F.col("s").alias("identifier")).agg(
        _preferred(LABEL).alias("l"), _preferred(COMMENT).alias("d"), several(ALIAS).alias("aliases"), several(TYPE).alias("types")
    )
    return rows.where(F.length("l.x") > 0).select(
        "identifier", F.lit(kind).alias("kind"), F.col("l.x").alias("label"), F.coalesce("d.x", F.lit("")).alias("definition"), "aliases", "types"
    )


def container(entities: DataFrame, relations: DataFrame, classes: DataFrame) -> DataFrame:
    """All elements, one for each identifier: classes win over relations, those over entities."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = reduce(DataFrame.unionAll, [entities, relations, classes])
    best = rows.groupBy("identifier").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "identifier"]), rank).alias("e"))
    return best.select("identifier", "e.*")


def with_class_of_classes(elements_: DataFrame) -> DataFrame:
    """``elements_`` and the class of classes, which replaces an element of its identifier."""
    identifier, label, definition = CLASS_OF_CLASSES
    none = F.array().cast("array<string>")
    one = elements_.sparkSession.range(1).select(
        F.lit(identifier).alias("identifier"), F.lit("class").alias("kind"), F.lit(label).alias("label"), F.lit(definition).alias("definition"), none.alias("aliases"), none.alias("types")
    )
    return elements_.where(F.col("identifier") != identifier).unionByName(one)


def stored(build: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """The container at ``path``; where there is none yet it is built and written first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def type_labels(elements_: DataFrame) -> DataFrame:
    """``(identifier, type_labels)``: labels of an element's types in its order; unknown types and empty labels are dropped."""
    each = elements_.select("identifier", F.posexplode_outer("types").alias("pos", "type"))
    named = each.join(elements_.select(F.col("identifier").alias("type"), F.col("label").alias("name")), "type", "left")
    kept = F.when(F.length("name") > 0, F.struct("pos", "name"))
    return named.groupBy("identifier").agg(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["name"]).alias("type_labels"))


def index_candidates(elements_: DataFrame) -> DataFrame:
    """Elements that the entity index holds: those that aren't relations. A container has each identifier once, so it is read once."""
    return elements_.where("kind <> 'relation'")


def tagged(x: Column) -> Column:
    return split_tag(x)
