"""Scored neighbours of mentions whose names and descriptions repeat, against plain products."""

import numpy as np

from kgspark.functions import models as M
from kgspark.functions import text as X
from kgspark.operators import vectors as V
from kgspark.plans import pipeline as K


def test_equal_texts_are_scored_once_and_mentions_get_what_plain_products_give(spark):
    class Counting:
        """A scorer that counts the pairs which it is asked for."""

        def __init__(self, seen):
            self.seen = seen

        def score(self, pairs):
            self.seen.add(len(pairs))
            return M.JaccardScorer().score(pairs)

    names = ["alpha beam", "Alpha beam", "beta beam", "gamma ray", None]
    rows = [(d, p, names[(d + p * p) % 5], "a thing" if d % 3 else "a beam", "kind") for d in range(20) for p in range(3)]
    found = spark.createDataFrame(rows, "doc_id long, ent_pos int, entity string, definition string, type string")
    parts = [("e/%02d" % i, ["alpha", "ray"][i % 2], "a thing", ["kind"]) for i in range(12)]
    elements = spark.createDataFrame(parts, "identifier string, label string, definition string, types array<string>")
    seen = spark.sparkContext.accumulator(0)
    m, me, mm = K.scored_neighbours(found, elements, K.Config(scorer=Counting(seen), top_k=4))
    got_me, got_mm = ({tuple(r) for r in x.collect()} for x in (me, mm))
    texts = {r[2:] for r in rows}
    assert seen.value <= len(texts) ** 2 + len(texts) * 2  # with a row a mention it is 60 * 4 * 2

    unit = lambda x: x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    embed = lambda texts: unit(M.HashEmbedder().embed(texts).astype(np.float64))
    v = embed([X.STS_PREFIX + ": ".join(t for t in r[2:4] if t) for r in rows])
    e = embed([f"{r[1]} ({r[3][0]}): {r[2]}" for r in parts])
    mention = [f"{r[2]} ({r[4]}): {r[3]}" if r[2] else "" for r in rows]
    score = lambda a, b: M.JaccardScorer().score([(a, b)])[0]
    pad = lambda i: str(i).rjust(19, "0")
    want_me, want_mm = set(), set()
    for i in range(len(rows)):
        near = np.round(v @ v[i], 12)
        near[i] = -1
        for rank, j in enumerate(np.lexsort((np.arange(len(rows)), -near))[:4], 1):
            want_mm.add((pad(i), pad(j), score(mention[i], mention[j]), i * 4 + rank))
        for j in np.lexsort((np.arange(len(parts)), -np.round(e @ v[i], 12)))[:4]:
            want_me.add((pad(i), parts[j][0], score(mention[i], f"{parts[j][1]} (kind): {parts[j][2]}")))
    assert got_mm == want_mm and got_me == want_me
    _, me, mm = K.scored_neighbours(found, elements, K.Config(top_k=4), 0.3, 0.5)
    assert {tuple(r) for r in mm.collect()} == {r for r in want_mm if r[2] > 0.5} and {tuple(r) for r in me.collect()} == {r for r in want_me if r[2] > 0.3}


def test_few_mentions_are_filled_up_in_order(spark):
    """With fewer others than asked for, ranks leave out the mention itself wherever it stands."""
    found = spark.createDataFrame([(d, 0, "one", "x", "t") for d in range(3)], "doc_id long, ent_pos int, entity string, definition string, type string")
    _, me, mm = K.scored_neighbours(found, None, K.Config(top_k=5))
    assert sorted((int(r.m1), int(r.m2), r.ord - 5 * int(r.m1)) for r in mm.collect()) == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2)] and me.isEmpty()


def test_coarse_products_lose_nothing():
    """Products that single precision can't tell apart are ranked by double precision."""
    import pyarrow as pa

    draw = np.random.default_rng(5)
    x = draw.normal(size=(1, 16)) + 1e-7 * draw.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = lambda of, name: pa.table({of: np.arange(3000), name: pa.array(list(x), pa.list_(pa.float64()))})
    out = V._product(3, False, None, False)(side("query_id", "q"), side("cand_id", "b"))
    best = np.sort(np.einsum("ik,jk->ij", x, x), axis=1)[:, ::-1][:, :3]
    got = np.sort(out["score"].to_numpy().reshape(3000, 3), axis=1)[:, ::-1]
    assert np.abs(got - best).max() < 1e-14
