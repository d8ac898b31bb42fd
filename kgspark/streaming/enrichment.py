"""Schema enrichment over a stream of triples.

Each micro-batch is canonicalised against the schema that earlier batches left; the enriched schema and the canonical triples of batch N
are written below ``batch=N``. A batch that is run again after a failure starts from the same schema and overwrites its own folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.functions import models as M
from kgspark.operators.canonical import canonicalize

SCHEMA = "label string, definition string, ord long"


def enrich_stream(triples: DataFrame, known: DataFrame, path: str, embedder: M.Embedder, verifier: M.Completer, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream; ``triples`` is a streaming (doc_id, text, pos, subj, rel, obj, definition)."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        opened = spark.createDataFrame([], SCHEMA)
        if number > 0:
            opened = spark.read.schema(SCHEMA).parquet(f"{path}/schema/batch={number - 1}")
        docs = rows.groupBy("doc_id").agg(F.any_value("text").alias("text"))
        definitions = rows.where("definition IS NOT NULL").groupBy("doc_id", "rel").agg(F.max("definition").alias("definition"))
        out, new = canonicalize(docs, rows.select("doc_id", "pos", "subj", "rel", "obj"), definitions, opened, known, embedder, verifier)
        out.write.mode("overwrite").parquet(f"{path}/triples/batch={number}")
        new.select("label", "definition", "ord").write.mode("overwrite").parquet(f"{path}/schema/batch={number}")

    return triples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
