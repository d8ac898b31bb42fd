"""Sinks: stage results, schemas, linked graphs, datasets. Nothing overwrites an existing output unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import triples_text


def stage_results(stages: DataFrame, path: str, iteration: int) -> None:
    """JSON below ``stages/iter=N``; an existing iteration raises."""
    stages.write.mode("errorifexists").json(f"{path}/stages/iter={iteration}")


def schema_json(schema: DataFrame, path: str, iteration: int) -> None:
    schema.orderBy("ord").write.mode("errorifexists").json(f"{path}/schema/iter={iteration}")


def canonical_text(docs: DataFrame, path: str) -> None:
    """One Python list of triples a line, in order of documents; ``docs`` is (doc_id, triples of structs)."""
    docs.orderBy("doc_id").select(triples_text(F.col("triples")).alias("value")).write.mode("errorifexists").text(path)


def linked_json(docs: DataFrame, path: str, slim: bool = False) -> None:
    cols = ["index", "input_text", "linked_triplets"] if slim else docs.columns
    docs.select(*cols).write.mode("errorifexists").json(path)


def relation_csv(schema: DataFrame, path: str) -> None:
    schema.select("uri", "label", "definition").write.mode("errorifexists").csv(path, quote='"', escape='"')


def definitions_csv(rows: DataFrame, path: str) -> None:
    """All fields quoted, so that texts come back as they are: with line ends of any kind, white space at their ends, or empty. A null is a NUL character alone."""
    rows.select("text", "triplets", "relations", "definitions").write.mode("errorifexists").csv(
        path, header=True, quote='"', escape='"', quoteAll=True, nullValue="\0", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def entries_xml(rows: DataFrame, path: str) -> None:
    """Benchmark XML, one ``entry`` for each row ``(entry_id, triples)``."""
    entry = rows.select(F.col("entry_id").alias("_eid"), F.struct(F.col("triples").alias("mtriple")).alias("modifiedtripleset"))
    entry.write.mode("errorifexists").format("xml").option("rootTag", "entries").option("rowTag", "entry").save(path)


def texts(docs: DataFrame, path: str) -> None:
    """One text a line in order of documents: line ends become spaces, null is an empty line."""
    value = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|\n|\r", " ")
    docs.orderBy("doc_id", "text").select(value.alias("value")).write.mode("errorifexists").text(path)


def json_rows(rows: DataFrame, path: str) -> None:
    """Mention definitions, fine-tuning rows, tuning grids, redefinitions: one file a task."""
    rows.write.mode("errorifexists").json(path)


def vectors(index: DataFrame, path: str) -> None:
    """Index artefacts, one folder a cell, so that a probe reads its cells only."""
    index.write.mode("errorifexists").partitionBy("cell").parquet(path)


def splits(rows: DataFrame, path: str) -> None:
    """Dataset splits as ``split=`` partitions."""
    rows.write.mode("errorifexists").partitionBy("split").parquet(path)


def metrics_csv(rows: DataFrame, path: str) -> None:
    """Appends evaluator rows."""
    rows.write.mode("append").csv(path, header=True)


def graded_lines(rows: DataFrame, max_length_diff: int | None = None) -> DataFrame:
    """Pairs of predicted and gold triple arrays that both parsed, and whose sizes differ by ``max_length_diff`` at most."""
    out = rows.where(F.col("predicted").isNotNull() & F.col("gold").isNotNull())
    return out if max_length_diff is None else out.where(F.abs(F.size("predicted") - F.size("gold")) <= max_length_diff)
