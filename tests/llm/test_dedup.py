import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark.llm import common as K
from kgspark.llm import embeddings as E
from kgspark.llm import simhash as S


def slow_print(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB É\t\n\x1c\xa0", max_size=60) | st.none())
def test_fingerprint_like_brute_force(text):
    assert S.fingerprint(text) == slow_print(text)


def components(n, linked):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def test_links_like_brute_force(spark):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(60):  # dense groups of near prints
            x = int(b)
            for bit in draw.integers(0, 64, draw.integers(0, 4)):
                x ^= 1 << int(bit)
            prints.add(x)
    values = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    u = np.array(values, np.int64).view(np.uint64)
    true = [(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if int(u[i] ^ u[j]).bit_count() <= 2]
    at = {v: i for i, v in enumerate(values)}
    got = [(at[r.src], at[r.dst]) for r in S.links(df).collect()]
    assert all(int(u[a] ^ u[b]).bit_count() <= 2 for a, b in got)
    assert components(len(u), got) == components(len(u), true)


def test_whole_table_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = S.near_duplicates(docs).toPandas().sort_values("doc_id")
    texts = docs.toPandas().sort_values("doc_id")
    prints = [slow_print(t) for t in texts.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    linked = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2]
    ids = texts.doc_id.tolist()
    assert got.component_id.tolist() == [ids[c] for c in components(len(ids), linked)]


def test_simhash_rows(odd, empty):
    got = S.near_duplicates(odd).collect()
    assert len(got) == odd.count() and S.near_duplicates(empty).count() == 0
    blank = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in blank} == {1}
    assert {r.component_id for r in got if r.doc_id in (0, 5)} == {0}


def test_links_in_many_cells_and_blocks(spark, monkeypatch):
    """A large group of near prints in one place, whose cells need blocks, among evenly spread ones."""
    monkeypatch.setattr(S, "CELL", 32)
    draw = np.random.default_rng(9)
    prints = set(draw.integers(0, 1 << 63, 1500, dtype=np.uint64).tolist())
    for _ in range(700):
        x = 12345678901234567
        for bit in draw.integers(0, 14, 3):
            x ^= 1 << int(bit)
        prints.add(x)
    u = np.array(sorted(prints), np.uint64)
    near = np.bitwise_count(u[:, None] ^ u) <= 2
    true = list(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
    at = {v: i for i, v in enumerate(u.view(np.int64).tolist())}
    assert S.splits(len(u), 2) > 3
    got = [(at[r.src], at[r.dst]) for r in S.links(spark.createDataFrame([(v,) for v in at], "fp long")).collect()]
    assert all(near[a, b] for a, b in got) and len(true) > 2 * len(u)
    assert components(len(u), got) == components(len(u), true)


def replaced(draw, words, share):
    """A copy with every word replaced at a chance of ``share``."""
    return [f"w{draw.integers(1 << 40)}" if x < share else w for w, x in zip(words, draw.random(len(words)).tolist())]


def jaccard(a, b, n=5):
    x, y = ({tuple(t[i : i + n]) for i in range(max(1, len(t) - n + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("cell", [2048, 8])
def test_similar_like_brute_force(spark, monkeypatch, cell):
    """Near copies of texts that all hold a common passage: all far above the bound are linked, none far below."""
    monkeypatch.setattr(S, "CELL", cell)
    draw = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = [f"w{draw.integers(1 << 40)}" for _ in range(int(draw.integers(150, 600)))] + passage
        texts += [base, *(replaced(draw, base, share) for share in (0.004, 0.01, 0.03, 0.1))]
    hot = [f"h{draw.integers(1 << 40)}" for _ in range(400)]
    texts += [replaced(draw, hot, 0.005) for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = S.sketches(df, "doc_id", "text", 5)
    of = {}
    for r in rows.collect():
        of.setdefault(r.fp, []).append(r.doc_id)
    got = [(a, b) for r in S.similar(rows).collect() for a in of[r.src] for b in of[r.dst]]
    assert all(jaccard(texts[a], texts[b]) > 0.65 for a, b in got)
    names = components(len(texts), got + [(v[0], x) for v in of.values() for x in v])
    for family in [range(5 * k, 5 * k + 5) for k in range(60)] + [range(300, 360)]:
        for a in family:
            for b in family:
                if jaccard(texts[a], texts[b]) >= 0.9:
                    assert names[a] == names[b]


def test_keep_one_of_near_copies(spark):
    draw = np.random.default_rng(5)
    texts = [[f"w{draw.integers(1 << 40)}" for _ in range(300)] for _ in range(20)]
    copies = [t[:k] + ["other"] + t[k + 1 :] for k, t in enumerate(texts, 100)]  # a similarity of 0.97
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *copies])]
    got = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == list(range(20))


def test_keep_one(odd, empty):
    out = S.keep_one(odd)
    assert out.schema.simpleString() == odd.schema.simpleString() and S.keep_one(empty).count() == 0
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert ids == [0, 1, 4, 6, 7, 8]
    assert out.where("doc_id IS NULL").count() == odd.where("doc_id IS NULL").count()


def test_keep_one_of_repeated_ids(spark):
    """Other texts under one id are other documents; rows that differ elsewhere only are copies, and reruns agree."""
    rows = [(1, "one text about things that are here", "a"), (1, "some other text, of which nothing is the same", "b"), (1, "one text about things that are here", "c"), (2, "one text about things that are here", "d")]
    once = [sorted(tuple(r) for r in S.keep_one(spark.createDataFrame(rows[::k], "doc_id long, text string, lang string").repartition(3)).collect()) for k in (1, -1)]
    assert once[0] == once[1] and [(i, t) for i, t, _ in once[0]] == sorted({rows[0][:2], rows[1][:2]})


def test_members_and_others(spark, monkeypatch):
    monkeypatch.setattr(K, "FILTER_BITS", 1 << 15)  # many pass the filter wrongly
    monkeypatch.setattr(K, "PIECE_BITS", 1 << 15)
    rows = spark.createDataFrame([(i if i < 60_000 else None, i % 7) for i in range(60_010)], "of long, bit int")
    ids = spark.range(0, 60_000, 11).select(F.col("id").alias("x"))
    inside, outside = K.members(rows, "of", ids), K.others(rows, "of", ids)
    assert inside.columns == outside.columns == ["of", "bit"]
    assert sorted(r.of for r in inside.collect()) == list(range(0, 60_000, 11))
    assert outside.count() == 60_010 - len(range(0, 60_000, 11)) and outside.where("of % 11 = 0").count() == 0


def brute_vectors(rows, threshold=0.95):
    good, ids = [], []
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good.append(x / np.sqrt((x * x).sum()))
            ids.append(i)
    near = np.array(good) @ np.array(good).T >= threshold
    np.fill_diagonal(near, False)
    links = {i: 0 for i in range(len(rows))}
    for k, i in enumerate(ids):
        links[i] = int(near[k].sum())
    return links, components(len(rows), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])


def test_embeddings_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)  # several blocks for the large groups
    draw = np.random.default_rng(5)
    rows = []
    for size in (60, 30, 5, 2, 1, 1, 1):
        centre = draw.standard_normal(8)
        rows += [centre + draw.standard_normal(8) * 0.12 for _ in range(size)]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows += [rows[0]] * 4 + [[0.0] * 8, None, [float("nan")] * 8, [1.0] * 7 + [None], [1.0] * 3, [float("inf")] * 8]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    links, comps = brute_vectors(rows)
    assert [got[i].n_links for i in range(len(rows))] == [links[i] for i in range(len(rows))]
    assert [got[i].component_id for i in range(len(rows))] == comps
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, node int")
    assert E.near_duplicates(empty).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None), (3, [1e-30, 1e-30]), (4, [3e38, 3e38])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False), (3, 1, 3, True), (4, 1, 3, False)], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_on_isolated_pairs(spark, seed):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    twin = base[:120] + draw.standard_normal((120, 64)) * 0.02
    x = np.concatenate([base, twin])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}
    assert all(got[i] <= near[i].sum() for i in got)
    assert sum(got.values()) >= 0.9 * near.sum()


def tight_groups():
    """Two groups of 20 different vectors, every cosine between the groups from 0.96 up: lists of eight never leave a group."""
    draw = np.random.default_rng(8)
    a, b = np.zeros(64), np.zeros(64)
    a[0] = 1
    b[:2] = np.cos(0.24), np.sin(0.24)
    x = np.concatenate([c + draw.standard_normal((20, 64)) * 0.001 for c in (a, b)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame_of(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_tight_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 8)
    monkeypatch.setattr(E, "TILE", 2, raising=False)
    x = tight_groups()
    assert (x @ x.T).min() > 0.96
    monkeypatch.setattr(E, "audit", lambda *a: (0, 0))  # as if it had met none of them
    got = E.near_duplicates(frame_of(spark, x)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(39, 0)}


@pytest.mark.parametrize("size", [150, 600])
def test_planted_groups_with_certain_blocks(spark, monkeypatch, size):
    """A very tight group and a loose one in several blocks, and single vectors; the audit sees links and finds all."""
    monkeypatch.setattr(E, "BLOCK", 64)
    draw = np.random.default_rng(size)
    centres = draw.standard_normal((3, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.concatenate([centres[0] + draw.standard_normal((size, 64)) * 0.002, centres[1] + draw.standard_normal((size, 64)) * 0.028, draw.standard_normal((size, 64))])
    x = x[draw.permutation(len(x))]
    found, report = E.search(frame_of(spark, x))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in found.collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == components(len(x), list(zip(*(c.tolist() for c in np.nonzero(near)))))
    assert report.true >= min(E.LINKS_SEEN, near.sum()) and report.recall == 1.0


def test_certain_pairs_of_neighbourhoods():
    draw = np.random.default_rng(2)
    for spread in (0.001, 0.02, 0.05, 0.3):
        for apart in (0.0, 0.2, 0.5, 2.0):
            x, y = (c + draw.standard_normal((9, 16)) * spread for c in (np.eye(16)[0], np.eye(16)[0] + apart * np.eye(16)[1]))
            x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
            near = x @ y.T >= 0.95
            sure = E._certain(x, y, 0.95)
            assert sure is None or (near.all() if sure else not near.any())


def test_failed_audits_end_in_an_exact_comparison(spark, monkeypatch):
    draw = np.random.default_rng(9)
    x = np.repeat(draw.standard_normal((30, 64)), 2, axis=0) + draw.standard_normal((60, 64)) * 0.02
    monkeypatch.setattr(E, "projected", lambda nodes, seed: spark.createDataFrame([], "u long, v long, sim double"))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(frame_of(spark, x)).collect())
    assert got == [(i, 1, i // 2 * 2) for i in range(60)]
