import json
import os

from kgspark.functions import models as M
from kgspark.plans.training import Never
from kgspark.streaming.enrichment import enrich_stream


def test_schema_grows_from_batch_to_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, rels in enumerate((["a", "b"], ["b", "c"], ["c"])):
        rows = [{"doc_id": i, "text": "t", "pos": k, "subj": "s", "rel": r, "obj": "o", "definition": f"{r} of {i}"} for k, r in enumerate(rels)]
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # a stream takes files by their time
    stream = spark.readStream.schema("doc_id long, text string, pos long, subj string, rel string, obj string, definition string").option("maxFilesPerTrigger", 1).json(str(src))
    known = spark.createDataFrame([("u", "k", "known")], "uri string, label string, definition string")
    query = enrich_stream(stream, known, str(tmp_path / "out"), M.HashEmbedder(16), Never(), str(tmp_path / "cp"))
    query.awaitTermination(180)
    last = spark.read.parquet(str(tmp_path / "out/schema/batch=2"))
    assert sorted((r.label, r.ord) for r in last.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert spark.read.parquet(str(tmp_path / "out/triples")).count() == 5
