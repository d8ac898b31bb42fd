"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from sorted random projections and is refined by joins of neighbours' neighbours until few lists change. Links
at the threshold give components. A list whose every entry passes the threshold is saturated and may hide more links: saturated vectors' lists are enlarged to
all vectors, exactly, which joins components that short lists leave apart; within a component all lists are enlarged to the whole component, as
block products of which only counts are kept, so that they never become pairs. Blocks are neighbourhoods: two of them whose centres and radii
leave no doubt aren't multiplied. Recall is audited against brute force until enough true links were seen, half of it among the vectors that came closest to a link;
refinement goes on with new projections where it falls short, and at last all vectors are compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import by_key, extended, small_batches
from kgspark.operators.graph import connected_components
from kgspark.session import cut, written

NEIGHBOURS = 8
ROUNDS = 4
TABLES = 12
BITS = 12
#: Rows compared on either side in a sorted projection.
REACH = 4
#: Neighbours further below the threshold than this lead nowhere and aren't kept.
SLACK = 0.35
#: Vectors of a block of a component.
BLOCK = 2048
#: Blocks whose centres are compared with as many others in one task.
TILE = 1024
#: Vectors of the steps of the audit, and links that it wants to see before it ends.
AUDITED = (512, 1024, 2048)
LINKS_SEEN = 200
RECALL = 0.98
ATTEMPTS = 3


def encode(vectors: DataFrame) -> DataFrame:
    """``(vec_id, node, raw)``: node is a hash of the vector, raw its doubles; both null for vectors that can't link.

    Those are null, zero, with null or non-finite components, or of another length than most.
    """
    small_batches(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    lengths = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths.n if lengths else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, raws = [], []
            for v in b.column(1):
                x = None if not v.is_valid or v.values.null_count or len(v.values) != dim else v.values.to_numpy().astype("<f8") + 0.0
                if x is None or not dim or not np.isfinite(x).all() or not x.any():
                    nodes.append(None)
                    raws.append(None)
                    continue
                x = x / np.abs(x).max()  # squares of huge or tiny components stay finite
                raw = (x / np.sqrt((x * x).sum())).tobytes()
                nodes.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(raws, pa.binary())], ["vec_id", "node", "raw"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, node long, raw binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    if not len(data):
        return np.zeros((0, 1))
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<f8").reshape(len(data), -1)


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], ["u", "v", "sim"])


def projected(nodes: DataFrame, seed: int, tables: int = TABLES, reach: int = REACH) -> DataFrame:
    """First neighbours ``(u, v, sim)``: rows next to each other in sorted random projections.

    Sorting is by range, so that many vectors of one signature spread over tasks.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables, BITS + 1))
            for t in range(tables):
                p = x @ planes[:, t]
                sign = (p[:, :BITS] > 0) @ (1 << np.arange(BITS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t), pa.int32()), pa.array(sign.astype(np.int32)), pa.array(p[:, BITS]), b.column(0), b.column(1)],
                    ["t", "sign", "place", "node", "raw"],
                )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            if last is not None:
                rows = pa.concat_tables([last, rows]).combine_chunks()
            ids, x, t = rows.column("node").to_numpy(), _matrix(rows.column("raw")), rows.column("t").to_numpy()
            old = 0 if last is None else last.num_rows
            for step in range(1, reach + 1):
                i = np.arange(max(0, old - step), len(ids) - step)
                i = i[(t[i] == t[i + step]) & (ids[i] != ids[i + step])]
                if len(i):
                    sim = np.einsum("ij,ij->i", x[i], x[i + step])
                    yield _edges(np.r_[ids[i], ids[i + step]], np.r_[ids[i + step], ids[i]], np.r_[sim, sim])
            last = rows.slice(max(0, rows.num_rows - reach))

    dealt = nodes.select("node", "raw").mapInArrow(keys, "t int, sign int, place double, node long, raw binary")
    return dealt.repartitionByRange("t", "sign", "place").sortWithinPartitions("t", "sign", "place").mapInArrow(near, "u long, v long, sim double")


def best(edges: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """The ``k`` nearest of every node, of similarity ``least`` or more; ties by id."""
    ranked = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.where(F.col("sim") >= least).dropDuplicates(["u", "v"]).withColumn("rank", ranked).where(F.col("rank") <= k).drop("rank")


def refine(graph: DataFrame, nodes: DataFrame, k: int, reverse: int | None = None, least: float = -2.0) -> DataFrame:
    """One round: every node introduces its neighbours, and some that have it as neighbour, to each other."""
    reverse = reverse or k
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
    ranked = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    back = back.withColumn("rank", ranked).where(F.col("rank") <= reverse).drop("rank")
    circle = graph.unionAll(back).select("u", "v").distinct()
    seated = circle.join(nodes.select(F.col("node").alias("v"), "raw"), "v").select("u", "v", "raw")

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, x = rows.column("v").to_numpy(), _matrix(rows.column("raw"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            n = b - a
            if n < 2:
                continue
            sim = x[a:b] @ x[a:b].T
            np.fill_diagonal(sim, -2.0)
            keep = min(n - 1, 4)
            w = np.argpartition(-sim, keep - 1, axis=1)[:, :keep] if keep < n - 1 else np.argsort(-sim, axis=1)[:, :keep]
            rows_ = np.repeat(np.arange(n), keep)
            w = w.ravel()
            near = sim[rows_, w] >= least
            rows_, w = rows_[near], w[near]
            out.append((ids[a + rows_], ids[a + w], sim[rows_, w]))
        if out:
            yield _edges(*(np.concatenate(c) for c in zip(*out)))

    return best(graph.unionAll(by_key(seated, ["u"], work, "u long, v long, sim double")), k, least)


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """``(node, links)``: for every node, the vectors of its component at ``threshold``, whatever the length of its list.

    ``members`` is (node, raw, n, component). A component is dealt into blocks of about 2,048 by one projection, so that blocks are neighbourhoods; every pair of blocks is one
    product, of which only counts remain, unless centres and radii show that all or none of its pairs are links.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    small = members.join(sizes, "component")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = None
        for b in batches:
            x = _matrix(b.column(b.schema.get_field_index("raw")))
            if len(x):
                plane = np.random.default_rng(17).standard_normal(x.shape[1]) if plane is None else plane
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x @ plane)], [*b.schema.names, "place"])

    ranked = small.mapInArrow(placed, extended(small.schema, "place double"))
    # quantiles of a component's places by its own extent: equal steps, so no component is sorted in one task
    extent = ranked.where("blocks > 1").groupBy("component").agg(F.percentile_approx("place", [i / 64 for i in range(1, 64)], 1000).alias("marks"))
    dealt = ranked.join(extent, "component", "left")
    rank = F.coalesce(F.size(F.filter("marks", lambda m: m < F.col("place"))), F.lit(0))
    part = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("blocks") / 64))).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("blocks") == 1, 0).when(F.col("blocks") < 64, F.floor(rank * F.col("blocks") / 64).cast("int")).otherwise(rank * F.greatest(F.lit(1), F.ceil(F.col("blocks") / 64)).cast("int") + part))
    count = F.when(F.col("blocks") < 64, F.col("blocks")).otherwise(64 * F.ceil(F.col("blocks") / 64).cast("int"))
    each = dealt.select("component", "node", "raw", "n", "own", F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    each = each.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, x, n, own = rows.column("node").to_numpy(), _matrix(rows.column("raw")), rows.column("n").to_numpy(), rows.column("own").to_numpy()
        low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
        nodes, links = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            mine = own[a:b] == low[a]
            p = a + np.flatnonzero(mine)
            q = p if low[a] == high[a] else a + np.flatnonzero(~mine)
            if not len(p) or not len(q):
                continue
            sure = _certain(x[p], x[q], threshold)
            if sure is not None:
                to_p, to_q = (np.full(len(p), n[q].sum()), np.full(len(q), n[p].sum())) if sure else (np.zeros(len(p), np.int64), np.zeros(len(q), np.int64))
                if p is q and sure:
                    to_p = to_p - n[p]
            else:
                near = x[p] @ x[q].T >= threshold
                if p is q:
                    np.fill_diagonal(near, False)
                to_p, to_q = near @ n[q], n[p] @ near
            nodes.append(ids[p])
            links.append(to_p)
            if p is not q:
                nodes.append(ids[q])
                links.append(to_q)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(links), pa.int64())], ["node", "links"])

    parts = by_key(each, ["component", "low", "high"], work, "node long, links long")
    return parts.groupBy("node").agg(F.sum("links").alias("links"))


def _certain(x: np.ndarray, y: np.ndarray, threshold: float) -> bool | None:
    """True if all pairs of two neighbourhoods are links for certain, False if none is, None if that must be looked at."""
    angles = []
    for rows in (x, y):
        c = rows.sum(axis=0)
        size = np.sqrt((c * c).sum())
        c = c / size if size > 1e-9 else rows[0]
        angles.append((c, float(np.arccos(np.clip(rows @ c, -1.0, 1.0)).max())))
    (c, r), (d, s) = angles
    between = float(np.arccos(np.clip(c @ d, -1.0, 1.0)))
    limit = float(np.arccos(np.clip(threshold, -1.0, 1.0)))
    if between + r + s < limit - 1e-6:
        return True
    if between - r - s > limit + 1e-6:
        return False
    return None


def bridges(members: DataFrame, threshold: float) -> DataFrame:
    """``(u, v)``: for every two components with a link at ``threshold`` between their ``members``, some such links; exact.

    ``members`` is (node, raw, component). A component is dealt into blocks of about 512. By the triangle inequality of angles, blocks whose
    centres are further apart than both radii and the threshold's angle have no link; the other pairs of blocks are multiplied.
    """
    limit = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = written(dealt.select("node", "raw", "component", F.xxhash64("component", "own").alias("block")), "bridged")

    def centred(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, component, block = _matrix(rows.column("raw")), rows.column("component").to_numpy(), rows.column("block").to_numpy()
        centres, radii = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            c = x[a:b].sum(axis=0)
            c = c / n if (n := np.sqrt((c * c).sum())) > 1e-9 else x[a]
            centres.append(c.tobytes())
            radii.append(float(np.arccos(np.clip(x[a:b] @ c, -1.0, 1.0)).max()))
        at = bounds[:-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(component[at]), pa.array(block[at]), pa.array(centres, pa.binary()), pa.array(radii, pa.float64())], ["component", "block", "raw", "radius"]
        )

    blocks = written(by_key(dealt, ["component", "block"], centred, "component long, block long, raw binary, radius double"), "blocks")
    tiles = max(1, -(-blocks.count() // TILE))
    each = blocks.withColumn("tile", F.pmod(F.xxhash64(F.lit(9), "block"), F.lit(tiles)).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    each = each.select("component", "block", "raw", "radius", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    def close(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, radius, tile = _matrix(rows.column("raw")), rows.column("radius").to_numpy(), rows.column("tile").to_numpy()
        component, block, low, high = (rows.column(k).to_numpy() for k in ("component", "block", "low", "high"))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            mine = tile[a:b] == low[a]
            p = a + np.flatnonzero(mine)
            q = p if low[a] == high[a] else a + np.flatnonzero(~mine)
            near = np.arccos(np.clip(x[p] @ x[q].T, -1.0, 1.0)) <= radius[p][:, None] + radius[q] + limit
            near &= component[p][:, None] != component[q]
            if p is q:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array(block[p[i]]), pa.array(block[q[j]])], ["first", "second"])

    pairs = written(by_key(each, ["low", "high"], close, "first long, second long"), "close")
    sides = pairs.select("first", "second", F.explode(F.array("first", "second")).alias("block"))
    met = sides.join(dealt, "block").select("first", "second", "block", "node", "raw")

    def linked(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, x, first, block = rows.column("node").to_numpy(), _matrix(rows.column("raw")), rows.column("first").to_numpy(), rows.column("block").to_numpy()
        us, vs = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            mine = block[a:b] == first[a]
            p, q = a + np.flatnonzero(mine), a + np.flatnonzero(~mine)
            # a block is of one component, so one link joins both; all that it joins is counted afterwards
            near = x[p] @ x[q].T >= threshold
            if near.any():
                i, j = np.unravel_index(int(near.argmax()), near.shape)
                us.append(ids[p[i]])
                vs.append(ids[q[j]])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return written(by_key(met, ["first", "second"], linked, "u long, v long"), "bridges")


@dataclass
class Audit:
    """Vectors compared with all others, the links that they have, and how many of these the result joins."""

    vectors: int = 0
    true: int = 0
    found: int = 0

    @property
    def recall(self) -> float:
        return self.found / self.true if self.true else 1.0


def audit(named: DataFrame, asked: pa.Table, threshold: float) -> tuple[int, int]:
    """Links of the vectors ``asked``, a bounded table, against all by brute force: how many there are, and how many join one component.

    Both are (node, raw, component).
    """
    if not asked.num_rows:
        return 0, 0
    ids, x, own = asked.column("node").to_numpy(), _matrix(asked.column("raw")).copy(), asked.column("component").to_numpy()
    sent = named.sparkSession.sparkContext.broadcast((ids, x, own))  # a fixed number of vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, own = sent.value
        true = found = 0
        for b in batches:
            if not b.num_rows:
                continue
            near = (_matrix(b.column(1)) @ x.T >= threshold) & (b.column(0).to_numpy()[:, None] != ids)
            true += int(near.sum())
            found += int((near & (b.column(2).to_numpy()[:, None] == own)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([true], pa.int64()), pa.array([found], pa.int64())], ["true", "found"])

    total = named.select("node", "raw", "component").mapInArrow(run, "true long, found long").agg(F.sum("true").alias("t"), F.sum("found").alias("f")).first()
    return int(total.t or 0), int(total.f or 0)


def audited(named: DataFrame, graph: DataFrame, threshold: float) -> Audit:
    """Audit in steps until ``LINKS_SEEN`` true links were seen: half of a step's vectors by hash, half those closest below a link.

    Where hardly a vector comes near a link the audit ends with its last step.
    """
    out = Audit()
    closest = graph.where(F.col("sim") < threshold).groupBy("u").agg(F.max("sim").alias("sim")).orderBy(F.desc("sim"), "u").limit(sum(AUDITED) // 2)
    close = named.join(F.broadcast(closest), F.col("node") == F.col("u")).orderBy(F.desc("sim"), "node").select("node", "raw", "component").toArrow()
    drawn = named.orderBy(F.xxhash64(F.lit(5), "node")).select("node", "raw", "component").limit(sum(AUDITED)).toArrow()
    for many in AUDITED:
        mine, close = close.slice(0, many // 2), close.slice(many // 2)
        size = many - mine.num_rows
        asked = pa.concat_tables([mine, drawn.slice(0, size)])
        drawn = drawn.slice(size)
        true, found = audit(named, asked, threshold)
        out = Audit(out.vectors + asked.num_rows, out.true + true, out.found + found)
        if out.true >= LINKS_SEEN or not drawn.num_rows:
            break
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, target: float = RECALL) -> DataFrame:
    """``search`` without its audit."""
    return search(vectors, threshold, neighbours, rounds, target)[0]


def search(vectors: DataFrame, threshold: float = 0.95, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, target: float = RECALL) -> tuple[DataFrame, Audit]:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``, and the audit of its links.

    ``n_links`` counts other rows at cosine ``threshold`` or more, in double precision, all of them within the row's component; equal vectors are one
    node of the graph and link with each other. Vectors that are null, zero, of another length than most, or hold null or non-finite
    components link with nothing. A null id is never a component's name unless the component has no other. An empty table gives no rows.
    """

    def named_by(links: DataFrame) -> DataFrame:
        out = nodes.join(links, F.col("node") == F.col("id"), "left")
        return written(out.select("node", "raw", "least", "n", F.coalesce("component", "node").alias("component")), "named")

    def with_bridges(links: DataFrame, named: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = bridges(members.select("node", "raw", "component"), threshold)
        if more.isEmpty():
            return links, named
        links = connected_components(links.select(F.col("id").alias("u"), F.col("component").alias("v")).unionAll(more), "u", "v")
        return links, named_by(links)

    rows = written(encode(vectors), "vectors")
    nodes = written(rows.where("node IS NOT NULL").groupBy("node").agg(F.any_value("raw").alias("raw"), F.min("vec_id").alias("least"), F.count("*").alias("n")), "nodes")
    graph, links, report = None, None, Audit()
    for attempt in range(ATTEMPTS):
        start = projected(nodes, 100 + attempt)
        graph = cut(best(start if graph is None else graph.unionAll(start), neighbours, threshold - SLACK))
        total = graph.count()
        for _ in range(rounds):
            if not total:
                break
            new = cut(refine(graph, nodes, neighbours, least=threshold - SLACK))
            changed = new.join(graph, ["u", "v"], "left_anti").count()
            graph = new
            if changed <= 0.02 * total:
                break
        links = connected_components(graph.where(F.col("sim") >= threshold), "u", "v")
        named = named_by(links)
        # a link that neither list has room for is one between two saturated vectors
        full = graph.where(F.col("sim") >= threshold).groupBy("u").count().where(F.col("count") >= neighbours).select(F.col("u").alias("node"))
        links, named = with_bridges(links, named, named.join(full, "node", "left_semi"))
        report = audited(named, graph, threshold)
        if report.found >= target * report.true:
            break
    else:
        links, named = with_bridges(links, named, named)
        report = Audit(report.vectors, report.true, report.true)
    joined = F.col("component").isNotNull()
    several = named.join(links.select(F.col("id").alias("node")), "node", "left_semi")
    counted = _counted(several, threshold)
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    by_node = (
        named.where(joined).select("node", "n", "component").join(counted, "node", "left").join(names, "component")
        .select(F.col("node").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "name")
    )
    out = rows.join(by_node, F.col("node") == F.col("key"), "left")
    component = F.coalesce("name", "vec_id")
    rows_out = out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
    return rows_out, report
