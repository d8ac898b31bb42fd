"""Folds in rounds against the same folds row by row."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from kgspark.functions import models as M
from kgspark.names import NEW_ENTITY
from kgspark.operators import canonical as C
from kgspark.operators import ordered as O


def vectors(seed, n, size=6, spread=0.25, centres=8):
    draw = np.random.default_rng(seed)
    heads = draw.normal(size=(centres, size))
    x = heads[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nil_by_hand(rows, threshold):
    """(doc, pos, vector, kg, kg score) in order; the store grows document by document."""
    store, waiting, last, count, out = [], [], None, 0, {}
    for doc, pos, x, kg, kg_score in sorted(rows, key=lambda r: r[:2]):
        if doc != last:
            store, waiting, last = store + waiting, [], doc
        score, owner = max(((float(x @ y), -i) for i, (y, _) in enumerate(store)), default=(-9.0, 0))
        own = score if score > threshold else None
        if kg is not None and (own is None or kg_score >= own):
            out[doc, pos] = kg
            continue
        number = count if own is None else store[-owner][1]
        count += own is None
        waiting.append((x, number))
        out[doc, pos] = f"{NEW_ENTITY}{number}"
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nil_fold_like_one_by_one(spark, seed):
    draw = random.Random(seed)
    x = vectors(seed, 150)
    rows = [(i // 4, i % 4, x[i], *((str(900 + i), round(draw.uniform(0.55, 1.0), 6)) if draw.random() < 0.6 else (None, None))) for i in range(150)]
    mentions = spark.createDataFrame([(d, p, v.tolist()) for d, p, v, *_ in rows], "doc_id long, ent_pos long, embedding array<double>")
    kg = spark.createDataFrame([(d, p, int(c), s) for d, p, _, c, s in rows if c], "doc_id long, ent_pos long, cand_id long, score double")
    got = {(r.doc_id, r.ent_pos): r.identifier for r in O.nil_fold(mentions.repartition(3), 0.7, kg, 0.5).collect()}
    want = nil_by_hand(rows, 0.7)
    assert got == want
    assert 3 < len({v for v in want.values() if v.startswith(NEW_ENTITY)}) < 150 and any(not v.startswith(NEW_ENTITY) for v in want.values())


def test_a_long_chain_of_copies_is_one_entity(spark):
    rows = spark.createDataFrame([(i, 0, [1.0, 0.0]) for i in range(300)], "doc_id long, ent_pos long, embedding array<double>")
    assert {r.identifier for r in O.nil_fold(rows, 0.5).collect()} == {f"{NEW_ENTITY}0"}


def strict_by_hand(rows, opened, threshold):
    names, store, out = [n for n, _ in sorted(opened)], [v for _, v in sorted(opened)], {}
    for doc, pos, rel, x in sorted(rows, key=lambda r: r[:2]):
        if rel in names:
            out[doc, pos] = rel
            continue
        score, at = max(((float(x @ y), -i) for i, y in enumerate(store)), default=(-9.0, 0))
        if score > threshold:
            out[doc, pos] = names[-at]
        else:
            names.append(rel)
            store.append(x)
            out[doc, pos] = rel
    return out


@pytest.mark.parametrize("seed, labels, open_", [(1, 200, 5), (2, 12, 0), (3, 60, 3)])
def test_threshold_fold_like_one_by_one(spark, seed, labels, open_):
    draw = random.Random(seed)
    x = vectors(seed, 160)
    rows = [(i // 5, i % 5, f"r{draw.randrange(labels)}", x[i]) for i in range(150)]
    opened = [(f"o{i}", x[150 + i]) for i in range(open_)] + ([("r1", x[159])] if open_ else [])
    df = spark.createDataFrame([(d, p, r, v.tolist()) for d, p, r, v in rows], "doc_id long, pos long, rel string, embedding array<double>")
    got = {(r.doc_id, r.pos): r.canonical for r in O.canonicalize_ordered(df, spark.createDataFrame([(n, v.tolist()) for n, v in opened], "label string, embedding array<double>"), 0.8).collect()}
    want = strict_by_hand(rows, opened, 0.8)
    assert got == want and any(c != r for (_, _, r, _), c in zip(rows, want.values()))


def strict_verified_by_hand(rows, opened, known, embedder, k):
    emb = lambda t: (lambda v: v / (np.linalg.norm(v) or 1))(np.asarray(embedder.embed([t])[0], dtype=float))
    store = [(n, emb(d)) for n, d in sorted(opened)]
    fixed_store = [(n, emb(d)) for n, d in sorted(known)]
    out, added = {}, []
    for doc, pos, rel, definition in sorted(rows):
        if rel in [n for n, _ in store] or rel in [n for n, _ in known]:
            out[doc, pos] = rel
            continue
        q = emb(C.X.STS_PREFIX + definition)
        best = lambda s: [s[i][0] for i in sorted(range(len(s)), key=lambda i: (-float(q @ s[i][1]), i))[:k]]
        options = list(dict.fromkeys(best(store) + best(fixed_store)))
        fitting = [o for o in options if o[0] == definition.split()[-1][0]]
        if fitting:
            out[doc, pos] = min(fitting)
        else:
            out[doc, pos] = rel
            store.append((rel, emb(definition)))
            added.append(rel)
    return out, added


@pytest.mark.parametrize("seed", [1])
def test_strict_canonicalisation_like_one_by_one(spark, seed):
    draw = random.Random(seed)
    names = [f"{a}{b}" for a in "abcd" for b in ("lpha", "eta", "rho")]
    rows = []
    for i in range(30):
        rel = draw.choice(names)
        rows.append((i // 3, i % 3, rel, f"{draw.choice(['links', 'names'])} {draw.choice(names)} to {draw.choice('abbccddx')}{draw.randrange(30)}"))
    opened, known = [("alpha", "links apples to pears")], [("gone", "was there before"), ("beta", "second letter")]
    triples = spark.createDataFrame([(d, p, "s", r, "o") for d, p, r, _ in rows], "doc_id long, pos long, subj string, rel string, obj string")
    first = {}
    for d, p, r, t in rows:
        first.setdefault((d, r), t)
    rows = [(d, p, r, first[d, r]) for d, p, r, _ in rows]
    definitions = spark.createDataFrame([(d, r, t) for (d, r), t in first.items()], "doc_id long, rel string, definition string")
    docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    embedder, verifier = M.HashEmbedder(32), M.SameInitial()
    open_df = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(opened)], "label string, definition string, ord long")
    known_df = spark.createDataFrame([(f"u{n}", n, t) for n, t in known], "uri string, label string, definition string")
    out, schema, rounds = C.canonicalize_strict(docs, triples, definitions, open_df, known_df, embedder, verifier, k=2)
    want, added = strict_verified_by_hand(rows, opened, known, embedder, 2)
    assert {(r.doc_id, r.pos): r.rel for r in out.collect()} == want
    assert [r.label for r in schema.orderBy("ord").collect()] == [n for n, _ in opened] + added
    assert added and 1 < rounds < len(rows) and any(v not in (r, *added) for (_, _, r, _), v in zip(rows, want.values()))


def test_query_like_one_by_one(spark):
    from kgspark.plans import training as T

    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    rows = [(p.p_partkey, 0, p.p_type.lower(), p.p_name) for p in parts]
    want, added = strict_verified_by_hand(rows, list(T.PART_OPEN), list(T.PART_KNOWN), M.HashEmbedder(16), 2)
    got = {(r.doc_id, 0): r.rel for r in T.strict_verified_fold(spark, sf).collect()}
    assert got == want and added and len(set(want.values())) > len(added) + 1


def test_more_candidates_than_letters(spark):
    """All of thirty hints are offered, also those behind Z."""
    hints = [f"{chr(97 + i % 26)}{i}" for i in range(30)] + ["zebra"]
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    triples = spark.createDataFrame([(1, 0, "s", "new", "o")], "doc_id long, pos long, subj string, rel string, obj string")
    definitions = spark.createDataFrame([(1, "new", "means zoo")], "doc_id long, rel string, definition string")
    known = spark.createDataFrame([("u", "other", "is other")], "uri string, label string, definition string")
    opened = spark.createDataFrame([], "label string, definition string, ord long")
    given = spark.createDataFrame([(1, hints)], "doc_id long, hints array<string>")
    want = min(h for h in hints if h[0] == "z")
    assert [r.rel for r in C.canonicalize(docs, triples, definitions, opened, known, M.HashEmbedder(8), M.SameInitial(), given)[0].collect()] == [want]
    assert [r.rel for r in C.canonicalize_strict(docs, triples, definitions, opened, known, M.HashEmbedder(8), M.SameInitial(), given)[0].collect()] == [want]


def test_equal_definitions_are_embedded_once(spark, tmp_path):
    log = str(tmp_path / "log")

    class Logged(M.HashEmbedder):
        def embed(self, texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return super().embed(texts)

    rows = [(i, 0, "s", "known" if i % 2 else "rel", "o", f"text {i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, subj string, rel string, obj string, definition string")
    known = spark.createDataFrame([("http://kg/a", "a", "one")], "uri string, label string, definition string")
    opened = spark.createDataFrame([("known", "two", 0)], "label string, definition string, ord long")
    docs = df.select("doc_id", F.lit("t").alias("text"))
    out, _, _ = C.canonicalize_strict(docs, df.drop("definition"), df.select("doc_id", "rel", "definition"), opened, known, Logged(8), M.SameInitial())
    assert out.count() == 300
    assert sum(map(int, open(log).read().split())) < 40
