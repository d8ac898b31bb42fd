"""Counts of graphs against plain sets, and what scoring keeps."""

from kgspark.operators import evaluation as E


def test_scoring_keeps_no_triples(spark, monkeypatch):
    """Only alignments and sums are written; whole triples are read from their sources."""
    kept = []

    def cut(df, rows=None):
        df = df.localCheckpoint()
        kept.append(df.count())
        return df

    monkeypatch.setattr(E, "cut", cut)
    gold = [(d, f"_:b{d}" if i % 4 == 0 else f"e{i}", "p", f"o{i}") for d in range(3) for i in range(60)]
    said = [(d, "http://createdbyedc.org/n" if i % 4 == 0 else f"e{i}", "p", f"o{i + (i % 7 == 0)}") for d in range(3) for i in range(60)]
    rows = lambda x: spark.createDataFrame(x, "doc_id long, s string, p string, o string")
    got = {r.label: (r.tp, r.fp, r.fn) for r in E.evaluate(rows(gold), rows(said * 2), local=True).collect()}
    renamed = {(d, f"b{d}" if s.startswith("http") else s, p, o) for d, s, p, o in said}
    plain = {(d, s.removeprefix("_:"), p, o) for d, s, p, o in gold}
    assert got["triple"] == (len(plain & renamed), len(renamed - plain), len(plain - renamed))
    ends = lambda x: {(d, e) for d, s, _, o in x for e in (s, o)}
    assert got["entity"] == (len(ends(plain) & ends(renamed)), len(ends(renamed) - ends(plain)), len(ends(plain) - ends(renamed)))
    assert got["nil_entity"] == (3, 0, 0) and got["relation"] == got["kg_relation"] == (3, 0, 0) and "nil_relation" not in got
    assert max(kept) <= 4


def test_a_term_known_elsewhere_is_known(spark):
    """A blank's id that another document or place has as a plain term counts as known, for entities and relations."""
    gold = spark.createDataFrame([(1, "_:x", "p", "o"), (2, "s", "x", "o"), (3, "s", "_:y", "o")], "doc_id long, s string, p string, o string")
    got = {r.label: (r.tp, r.fp, r.fn) for r in E.evaluate(gold, gold.limit(0), local=False).collect()}
    assert got == {"triple": (0, 0, 3), "entity": (0, 0, 6), "kg_entity": (0, 0, 6), "relation": (0, 0, 3), "kg_relation": (0, 0, 2), "nil_relation": (0, 0, 1)}
