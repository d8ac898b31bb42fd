"""Threshold grids, closures and paths."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.names import NEW_ENTITY
from kgspark.operators import evaluation as E
from kgspark.operators import linking as L
from kgspark.plans import links as K
from kgspark.plans import pipeline as P

SF = "/root/testdata/sf0.001"


def test_all_points_like_point_by_point(spark):
    m, me, mm, triples, known, gold = K.grid_input(spark, SF)
    grid = [(0.3, 0.4, 0.12), (0.4, 0.3, 0.1)]
    got = {(r.me, r.mm, r.path): (round(r.triple_f1, 9), round(r.entity_f1, 9)) for r in P.tuned(m, me, mm, triples, known, gold, grid).collect()}
    rels = known.select(F.col("label").alias("rel"), "uri")
    for point in grid:
        ids = P.identified(m, me, mm, *point)
        scores = {r.label: r.f1 for r in E.evaluate(gold, L.linked(triples, ids, rels), local=False).collect()}
        assert got[point] == (round(scores["triple"], 9), round(scores["entity"], 9)) and scores["entity"] > 0
    assert len(got) == 2 and len(set(got.values())) == 2


@pytest.mark.parametrize("extra", [[], [(f"n{4999}", "n0")]])
def test_closure_of_a_long_chain_takes_few_rounds(spark, extra):
    edges = spark.range(4999).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst").unionAll(spark.createDataFrame(extra or [("z", None)], "src string, dst string"))
    seen, rounds = E.closure(edges, spark.createDataFrame([("n0",)], "node string"))
    assert seen.count() == 5000 and rounds <= 16


def test_closure_where_ways_part(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("x", "a"), ("c", "c"), ("a", "b")], "src string, dst string")
    seen, _ = E.closure(edges, spark.createDataFrame([("a",), ("q",)], "node string"))
    assert sorted(r.node for r in seen.collect()) == ["a", "b", "c", "d", "e", "f", "g", "q"]


def test_paths_longer_than_the_rounds_kept(spark):
    n = 24
    edges = spark.createDataFrame([(f"m:{i:03}", f"m:{i + 1:03}", 0.99) for i in range(n)] + [("m:000", "e:a", 1.0), (f"m:{n:03}", "e:b", 0.9)], "a string, b string, weight double")
    sources = spark.createDataFrame([("e:a",), ("e:b",)], "node string")
    got = {r.node: (r.source, r.score) for r in L.best_paths(edges, sources).collect()}
    for i in range(n + 1):
        a, b = 0.99**i, 0.9 * 0.99 ** (n - i)
        source, score = got[f"m:{i:03}"]
        assert source == ("e:a" if a >= b else "e:b") and abs(score - max(a, b)) < 1e-9


def grid_tables(spark, n=60, entities=12, seed=3):
    """Mentions (the last three without edges) with scores of two decimals that differ by direction."""
    rng = random.Random(seed)
    score = lambda: round(rng.uniform(0.05, 1.1), 2)
    name = lambda i: f"{i:019}"
    me = [(name(i), f"q{e:02}", score()) for i in range(n - 3) for e in rng.sample(range(entities), rng.randrange(3))]
    mm = [(name(i), name((i + d) % (n - 3)), score(), 10 * i + d) for i in range(n - 3) for d in rng.sample((-2, -1, 0, 1, 2, 7), 3)]
    return [name(i) for i in range(n)], me, mm, spark.createDataFrame(me, "mention string, entity string, score double"), spark.createDataFrame(mm, "m1 string, m2 string, score double, ord long")


def plain_clusters(mentions, me, mm, a, b, floor):
    """``clusters`` at a point, node by node: a mention's entity, or the smallest mention of its cluster."""
    weight = {(x, "e" + y): min(s, 1.0) for x, y, s in me if s > a}
    for x, y, s, _ in sorted(mm, key=lambda r: r[3]):
        if s > b and x != y:
            weight[min(x, y), max(x, y)] = min(s, 1.0)
    ways = {}
    for (x, y), w in weight.items():
        ways.setdefault(x, []).append((y, w))
        ways.setdefault(y, []).append((x, w))

    def reach(start, allowed):
        seen, todo = {start}, [start]
        while todo:
            for y, _ in ways.get(todo.pop(), []):
                if y not in seen and allowed(y):
                    seen.add(y)
                    todo.append(y)
        return seen

    best = {"e" + y: ("e" + y, 1.0) for _, y, _ in me}
    todo = sorted(best)
    while todo:
        x = todo.pop(0)
        for y, w in ways.get(x, []):
            new = best[x][0], round(best[x][1] * w, 12)
            if y[0] != "e" and new[1] > floor and (y not in best or (-new[1], new[0]) < (-best[y][1], best[y][0])):
                best[y] = new
                todo.append(y)
    out, rest = {}, set()
    for x in mentions:
        comp = reach(x, lambda _: True)
        held = [y for y in comp if y[0] == "e"]
        out[x] = held[0][1:] if len(held) == 1 else min(comp) if not held else best[x][0][1:] if x in best else None
        if out[x] is None:
            rest.add(x)
    return out | {x: min(reach(x, rest.__contains__)) for x in rest}


def test_grid_identifiers_like_plain_clusters(spark):
    mentions, me, mm, me_rows, mm_rows = grid_tables(spark)
    grid = [(a, b, c) for a in (0.3, 0.8) for b in (0.4, 0.75) for c in (0.1, 0.6)]
    got = {}
    for r in L.grid_identifiers(spark.createDataFrame([(x,) for x in mentions], "mention string"), me_rows, mm_rows, grid).collect():
        assert got.setdefault((r.point, r.mention), r.identifier) == r.identifier
    # new identifiers are named by their cluster's smallest mention, in order
    assert len(got) == len(grid) * len(mentions)
    for i, point in enumerate(grid):
        want = plain_clusters(mentions, me, mm, *point)
        numbers = {}
        for x in mentions:
            if want[x][0] == "q":
                assert got[i, x] == want[x]
            else:
                assert got[i, x].startswith(NEW_ENTITY) and numbers.setdefault(want[x], got[i, x]) == got[i, x]
        assert len(set(numbers.values())) == len(numbers)
    assert len({tuple(got[i, x] for x in mentions) for i in range(len(grid))}) > 4


def test_points_of_a_grid_share_their_edges(spark, monkeypatch):
    mentions, me, mm, me_rows, mm_rows = grid_tables(spark, 20)
    m = spark.createDataFrame([(int(x), 0, f"v{int(x)}", int(x)) for x in mentions], "id long, doc_id long, entity string, ent_pos long")
    triples = spark.createDataFrame([(0, 0, "v0", "next", "v1")], "doc_id long, pos long, subj string, rel string, obj string")
    known = spark.createDataFrame([("http://kg/next", "next", "")], "uri string, label string, definition string")
    gold = spark.createDataFrame([(0, "q01", "http://kg/next", "q02")], "doc_id long, s string, p string, o string")
    given, plain = [], L.connected_components
    monkeypatch.setattr(L, "connected_components", lambda edges, *a, **b: (given.append(edges.count()), plain(edges, *a, **b))[1])
    # path thresholds that leave no mention of a component of several entities without one
    assert P.tuned(m, me_rows, mm_rows, triples, known, gold, [(0.0, 0.0, i / 1e6) for i in range(6)]).count() == 6
    assert sum(given) <= 2 * (len(me) + len(mm))
