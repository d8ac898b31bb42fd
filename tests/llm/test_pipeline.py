import inspect

import corpus_pipeline as C
from kgspark.llm import bpe, mixing, quality, secrets, simhash
from kgspark.llm.queries import oracle_sql, queries, vocabulary


def test_stages():
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "simhash_dedup", "secret_scans", "mixing_sources", "bpe_encoding"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in C.STAGES)
    assert len(queries()) == 13 and set(oracle_sql()) <= set(queries())


def test_like_the_stages_by_hand(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.classify(docs, labels).collect() if r.kept}
    rows = {r.doc_id: r.asDict() for r in docs.collect() if r.doc_id in kept}
    prints = {i: simhash.fingerprint(r["text"], 5) for i, r in rows.items()}
    shingles = {i: set(simhash.shingles(r["text"], 5).tolist()) for i, r in rows.items()}
    similar = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * max(1, len(shingles[a] | shingles[b]))
    names = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if ((prints[a] ^ prints[b]).bit_count() <= 2 or similar(a, b)) and names[b] < names[a]:
                    names[a], changed = names[b], True
    rows = {i: r for i, r in rows.items() if names[i] == i}
    for r in rows.values():
        if found := secrets.spans(r["text"]):
            r["text"] = secrets.redacted(r["text"], found)
            r["n_chars"] = len(r["text"])
    mixed = mixing.mix(spark.createDataFrame([tuple(r.values()) for r in rows.values()], docs.schema), labels).collect()
    copies = {m.doc_id: m.taken // m["size"] if m["size"] else 0 for m in mixed}
    own = bpe.Bpe(vocabulary())
    want = sorted((i, rows[i]["lang"], rows[i]["n_chars"], tuple(own.encode(rows[i]["text"]))) for i, n in copies.items() for _ in range(n))
    got = sorted((r.doc_id, r.lang, r.n_chars, tuple(r.ids)) for r in C.run(spark, sf).collect())
    assert got == want


def test_stages_take_odd_and_empty_tables(spark, odd, empty, sf):
    for docs in (odd, empty):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= 3 * docs.count()
        assert C.STAGES[-1][1](spark, docs, sf).count() == docs.count()
