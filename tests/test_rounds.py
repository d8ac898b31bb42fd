"""Rounds of extraction: what models are asked, and what is written."""

from kgspark.functions import models as M
from kgspark.functions import parsers as P
from kgspark.operators import canonical as C
from kgspark.operators import vectors as V
from kgspark.plans import pipeline as K


def test_models_are_asked_once_and_whole_texts_are_not_written(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    class Counting(M.EchoCompleter):
        def complete(self, prompts, max_tokens=1024, n=1):
            asked.add(len(prompts))
            return super().complete(prompts, max_tokens, n)

    frames, cut = [], K.cut

    def kept(df, *args):
        frames.append(cut(df, *args))
        return frames[-1]

    for where in (K, C, V):
        monkeypatch.setattr(where, "cut", kept)
    docs = spark.createDataFrame([(i, f"Alpha meets beta{i} near gamma today again\nbehind the first line") for i in range(4)] + [(4, "x\nbehind the first line"), (5, None)], "doc_id long, text string")
    known = spark.createDataFrame([("u", "near", "stands near")], "uri string, label string, definition string")
    config = K.Config(completer=Counting(), verifier=M.SameInitial(), initial_refine=True, enrich=False)
    found, _ = K.extract_kg(docs, known, config, iterations=1)
    assert {r.doc_id for r in found.collect()} >= {0, 1, 2, 3}
    # two rounds of entities, their merging and triples for each text, and definitions where there are triples
    assert 2 * (3 * 6 + 4) <= asked.value <= 2 * 4 * 6
    assert frames and not any("behind the first line" in row for df in frames for row in df.toJSON().collect())


def test_plain_lists_are_read_as_literals_are():
    for text in ("['a', 'b c']", "['']", "[]", "['it\\'s']", "['a' 'b']", "['a', \"b\"]", "['a', 1]", "['a'", "['a\\nb']", "['[x]', 'y']"):
        try:
            want = P.ast.literal_eval(text)
        except (ValueError, SyntaxError):
            want = None
        assert P.plain_list(text) in (None, want)
    assert P.plain_list("['a', 'b c']") == ["a", "b c"]
    assert P.triples_of("[['a', 'r', 'b'], ['c', '_', 'd'], ['e', 'f']]") == [["a", "r", "b"]]


def test_a_small_base_is_asked_in_place(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 4)
    q = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(7)] + [(9, None)], "id long, embedding array<double>")
    b = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0]), (7, [0.0, 1.0])], "id long, embedding array<double>")
    got = sorted(tuple(r) for r in V.top_k(q, b, 2).collect())
    want = []
    for i in range(7):
        s = sorted([(-float(i % 3), 5), (-1.0, 6), (-1.0, 7)])[:2]
        want += [(i, c, -v, r) for r, (v, c) in enumerate(s, 1)]
    assert got == want and V.top_k(q, b.limit(0), 2).isEmpty()
