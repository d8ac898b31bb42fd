"""Folds over streams against the same folds over all rows, with batches run again and streams started again."""

import json
import os

import numpy as np
import pytest

from kgspark.operators import ordered as O
from kgspark.streaming import folds as S


def vectors(seed, n, centres=8, size=6):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(centres, size))[draw.integers(0, centres, n)] + 0.25 * draw.normal(size=(n, size))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


def add_file(folder, i, rows):
    (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
    os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # a stream takes files by their time


REL = "doc_id long, pos long, rel string, embedding array<double>"
ENT = "doc_id long, ent_pos long, embedding array<double>"


def source(spark, folder, ddl):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(folder))


def relations(seed):
    return [{"doc_id": i // 4, "pos": i % 4, "rel": f"r{i * 7 % 37}", "embedding": None if i % 29 == 5 else x} for i, x in enumerate(vectors(seed, 90))]


def test_relations_like_all_rows_at_once(spark, tmp_path):
    folder, rows = tmp_path / "in", relations(4)
    folder.mkdir()
    opened = spark.createDataFrame([(f"o{i}", x) for i, x in enumerate(vectors(9, 3))], "label string, embedding array<double>")
    want = sorted((r.doc_id, r.pos, r.rel, r.canonical) for r in O.canonicalize_ordered(spark.createDataFrame(rows, REL), opened, 0.8).collect())
    path, checkpoint = str(tmp_path / "to"), str(tmp_path / "cp")
    for i in range(2):
        add_file(folder, i, rows[32 * i : 32 * i + 32])
    S.canonicalize_stream(source(spark, folder, REL), opened, path, 0.8, checkpoint).awaitTermination(180)
    add_file(folder, 2, rows[64:])
    S.canonicalize_stream(source(spark, folder, REL), opened, path, 0.8, checkpoint).awaitTermination(180)  # goes on behind the first two
    read = lambda what: spark.read.parquet(f"{path}/{what}")
    got = lambda: sorted((r.doc_id, r.pos, r.rel, r.canonical) for r in read("out").collect())
    added = lambda: sorted((r.batch, r.ord, r.label) for r in read("store").collect())
    assert got() == want and any(rel != name for *_, rel, name in want)
    before = added()
    assert {b for b, *_ in before} == {0, 1, 2} and len({n for *_, n in before}) == len(before)
    S.fold_relations(spark.createDataFrame(rows[32:64], REL), opened, 1, path, 0.8)  # the second batch again: later additions are none of its business
    assert got() == want and added() == before


@pytest.mark.parametrize("linked", [False, True])
def test_entities_like_all_rows_at_once(spark, tmp_path, linked):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"doc_id": i // 4, "ent_pos": i % 4, "embedding": x} for i, x in enumerate(vectors(6, 90))]
    kg = spark.createDataFrame([(r["doc_id"], r["ent_pos"], 900 + i, (i * 37 % 45) / 100 + 0.55) for i, r in enumerate(rows) if i % 3], "doc_id long, ent_pos long, cand_id long, score double")
    find = (lambda df: df.select("doc_id", "ent_pos").join(kg, ["doc_id", "ent_pos"])) if linked else None
    want = {(r.doc_id, r.ent_pos): r.identifier for r in O.nil_fold(spark.createDataFrame(rows, ENT), 0.7, kg if linked else None).collect()}
    path, checkpoint = str(tmp_path / "to"), str(tmp_path / "cp")
    add_file(folder, 0, rows[:32])
    S.link_stream(source(spark, folder, ENT), path, 0.7, checkpoint, find).awaitTermination(180)
    for i in (1, 2):
        add_file(folder, i, rows[64:] if i == 2 else rows[32:64])
    S.link_stream(source(spark, folder, ENT), path, 0.7, checkpoint, find).awaitTermination(180)
    got = lambda: {(r.doc_id, r.ent_pos): r.identifier for r in spark.read.parquet(f"{path}/out").collect()}
    assert got() == want and len(want) == 90 > len(set(want.values()))
    S.fold_entities(spark.createDataFrame(rows[32:64], ENT), find, 1, path, 0.7, 0.5)
    assert got() == want


def test_no_rows_and_no_store(spark, tmp_path):
    opened = spark.createDataFrame([], "label string, embedding array<double>")
    S.fold_relations(spark.createDataFrame([], REL), opened, 0, str(tmp_path / "a"), 0.8)
    S.fold_entities(spark.createDataFrame([], ENT), None, 0, str(tmp_path / "b"), 0.7, 0.5)
    S.fold_relations(spark.createDataFrame([(1, 0, "new", None)], REL), opened, 1, str(tmp_path / "a"), 0.8)
    assert [r.canonical for r in spark.read.parquet(str(tmp_path / "a/out")).collect()] == ["new"]
    assert spark.read.parquet(str(tmp_path / "b/out")).count() == 0
