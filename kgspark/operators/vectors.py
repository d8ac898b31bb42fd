"""Vector operators: products, normalisation, exact top-k in blocks, an inverted index of cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.operators.linking import dense_numbers
from kgspark.session import cut

#: Rows of a block: a product of two blocks is one task's unit of work.
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), x.cast("double")))


def ranked(rows: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "cand_id", name: str = "rank") -> DataFrame:
    """The ``k`` best rows of each group with their rank from 1; ties by ascending id. Spark prunes groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def _blocks(df: DataFrame, id_col: str, count: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int")


def top_k(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False, self_score: float | None = None, before: bool = False) -> DataFrame:
    """Exact top-k inner products: ``(query_id, cand_id, score, rank)``; ties by ascending candidate id.

    Both sides are (id, embedding). Each is dealt into blocks of about 1,024 rows, a pair of blocks is one dense product, of
    which each query's ``k`` best remain; those are merged by rank. Beyond ``ALL_PAIRS`` pairs, only those that bounds can't rule out are multiplied, and many blocks are shipped together. ``exclude_self`` drops candidates of the query's own id; with
    ``self_score`` they stay, at that score, so that few candidates are filled up by the query itself. With ``before`` both sides have a number ``at`` and queries a
    ``floor``: only candidates of a smaller number and a score strictly above the floor count; numbers of candidates don't fall as ids grow. Rows without a vector find nothing and aren't found.

    Where vectors are often repeated, a vector's first ``k`` candidates stand for all of it, and equal queries are asked once.
    """
    queries, base = queries.where("embedding IS NOT NULL"), base.where("embedding IS NOT NULL")
    (rows_q, kinds_q), (rows_b, kinds_b) = (_kinds(df) for df in (queries, base))
    if not rows_q or not rows_b:
        return queries.sparkSession.createDataFrame([], HITS + ", rank int")
    apart = exclude_self or self_score is not None
    if self_score is None or self_score <= 0:
        if kinds_b * (k + apart) < REPEATED * rows_b:
            # of equal vectors only the first can be among a query's best
            w = Window.partitionBy("embedding").orderBy("id")
            base = cut(base.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k + apart).drop("__r"))
            rows_b = base.count()
        if not before and kinds_q < REPEATED * rows_q:
            return _once_a_vector(queries, base, k, exclude_self, self_score)
    n_q, n_b = (max(1, -(-n // BLOCK)) for n in (rows_q, rows_b))
    product = _product(k, exclude_self, self_score, before)
    if n_b == 1 < n_q and not before:
        return _with_few(queries, base, product)
    if n_q * n_b > ALL_PAIRS and min(n_q, n_b) > 1:
        return bounded_top_k(queries, base, k, product, self_score, before)[0]
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), *([F.col("at").alias("at"), "floor"] if before else []), _blocks(queries, "id", n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))).alias("bb"))
    b = base.select(F.col("id").alias("cand_id"), F.col("embedding").alias("b"), *([F.col("at").alias("at")] if before else []), _blocks(base, "id", n_b).alias("bb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    return ranked(q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(product, HITS), ["query_id"], k)


def _with_few(queries: DataFrame, base: DataFrame, product: Callable) -> DataFrame:
    """``top_k`` where the base is one block: its 1,024 rows at most pass the driver, and queries are answered where they are."""
    few = base.collect()
    right = pa.table({"cand_id": pa.array([r.id for r in few], pa.int64()), "b": pa.array([r.embedding for r in few], pa.list_(pa.float64()))})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = product(pa.Table.from_batches([batch]), right)
            who = out["query_id"].to_numpy()
            first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
            rank = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0)) + 1
            yield from out.append_column("rank", pa.array(rank, pa.int32())).to_batches()

    return queries.select(F.col("id").cast("long").alias("query_id"), F.col("embedding").alias("q")).mapInArrow(answer, HITS + ", rank int")


def _kinds(df: DataFrame) -> tuple[int, int]:
    """Numbers of rows and, about, of different vectors."""
    one = df.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("embedding")).alias("kinds")).first()
    return one.n, one.kinds


def _once_a_vector(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool, self_score: float | None) -> DataFrame:
    """``top_k`` by different vectors of queries: each is asked for by its smallest id, for one candidate more where a query's own id counts otherwise."""
    apart = exclude_self or self_score is not None
    heads = cut(queries.groupBy("embedding").agg(F.min("id").alias("head")))
    hits = top_k(heads.select(F.col("head").alias("id"), "embedding"), base, k + apart).select(F.col("query_id").alias("head"), "cand_id", "score", "rank")
    out = queries.select("id", "embedding").join(heads.hint("merge"), "embedding").select(F.col("id").alias("query_id"), "head").join(hits.hint("merge"), "head").drop("head")
    if not apart:
        return out.select("query_id", "cand_id", "score", "rank")
    own = F.col("query_id") == F.col("cand_id")
    out = out.where(~own) if exclude_self else out.withColumn("score", F.when(own, F.lit(float(self_score))).otherwise(F.col("score")))
    return ranked(out.drop("rank"), ["query_id"], k)


def top_members(queries: DataFrame, base: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Exact top-k of rows that share vectors: ``members`` with ``(query_id, score, rank)``; ties by ascending ``cand_id``.

    ``queries`` and ``base`` are (id, embedding); a member ``(base, cand_id, ...)`` has the vector of the row ``base``. Of ``base`` the ``k`` best, of equal ones those with the smallest first member, hold
    the ``k`` best members, so only they are looked up, with their first ``k`` members each.
    """
    first = cut(members.withColumn("__r", F.row_number().over(Window.partitionBy("base").orderBy("cand_id"))).where(F.col("__r") <= k))
    lead = cut(dense_numbers(first.where("__r = 1").select("base", F.col("cand_id").alias("lead")), "lead").select("base", "number"))
    hits = top_k(queries, base.join(lead.hint("merge"), F.col("id") == F.col("base")).select(F.col("number").alias("id"), "embedding"), k).select("query_id", F.col("cand_id").alias("number"), "score")
    return ranked(hits.join(lead.hint("merge"), "number").drop("number").join(first.drop("__r").hint("merge"), "base").drop("base"), ["query_id"], k)


#: Share of the rows up to which different vectors are so few that each is treated once.
REPEATED = 0.5
#: Pairs of blocks up to which all are multiplied; beyond, blocks are made of near vectors, and bounds say which pairs matter. Both give the same.
ALL_PAIRS = 64
#: Vectors around which blocks are made, at most: they pass the driver.
PIVOTS = 1024
HITS = "query_id long, cand_id long, score double"
#: Rows of a lot, at most: what a task holds of either side where blocks are shipped together. Numbers of a lot: 32 MB in double precision.
LOT, LOT_NUMBERS = 65_536, 1 << 22
#: Rows and columns of the product that is held at a time.
TILE = 1024, 4096


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors without nulls as rows of doubles."""
    one = vectors.combine_chunks()
    flat = one.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(one.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different sizes")
    return flat.reshape(len(one), -1) if len(one) else np.zeros((0, 0))


def _spheres(x: np.ndarray, blk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each block of rows, sorted by block, begins and ends, and its centre and radius."""
    cuts = np.r_[0, np.flatnonzero(np.diff(blk)) + 1, len(blk)]
    centre = np.add.reduceat(x, cuts[:-1], axis=0) / np.diff(cuts)[:, None]
    far = np.linalg.norm(x - np.repeat(centre, np.diff(cuts), axis=0), axis=1)
    return cuts, centre, np.maximum.reduceat(far, cuts[:-1])


def _upper(a: np.ndarray, ra: np.ndarray, c: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of centres, and what products of two blocks don't exceed."""
    na, nc = (np.linalg.norm(s, axis=1) for s in (a, c))
    middle = a @ c.T
    return middle, middle + ra[:, None] * nc + na[:, None] * rc + ra[:, None] * rc + SLACK


def _product(k: int, exclude_self: bool, self_score: float | None, before: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``k`` best of some candidates for each of some queries; a query's ``known`` is a score that it needs at least, if there is one.

    Products are made tile by tile in single precision where numbers allow it, and only what may reach a query's k-th best so far by what rounding can take (``_coarse``) is kept; its score is
    summed again in double precision and in one order, so that equal vectors tie. Where both sides have blocks ``blk``, those that can't reach the k-th best of any query of a tile aren't multiplied.
    """

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            blocks = "blk" in left.column_names
            if blocks:
                left, right = left.sort_by("blk"), right.sort_by("blk")
            x, y = matrix(left["q"]), matrix(right["b"])
            fast_x, fast_y, slack = _coarse(x, y)
            number = lambda t, c: t[c].to_numpy()
            qi, ci = number(left, "query_id"), number(right, "cand_id")
            known = number(left, "known") if "known" in left.column_names else np.full(len(qi), -np.inf)
            q_at, q_floor, b_at = (number(left, "at"), number(left, "floor"), number(right, "at")) if before else (None, None, None)
            if blocks:
                q_cuts, q_centre, q_radius = _spheres(x, number(left, "blk"))
                b_cuts, b_centre, b_radius = _spheres(y, number(right, "blk"))
                middle, upper = _upper(q_centre, q_radius, b_centre, b_radius)
                if self_score is not None:
                    upper = np.maximum(upper, self_score)
                b_rows = np.arange(len(ci))
            for start in range(0, len(qi), TILE[0]):
                at = slice(start, min(start + TILE[0], len(qi)))
                own, fast, ids, low = x[at], fast_x[at], qi[at], known[at].astype(np.float64)
                row, col, val = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                if blocks:
                    mine = slice(np.searchsorted(q_cuts, start, "right") - 1, np.searchsorted(q_cuts, at.stop, "left"))
                    top = upper[mine].max(axis=0)
                    order = np.argsort(-middle[mine].max(axis=0), kind="stable")
                    sizes = np.cumsum(np.diff(b_cuts)[order])
                    groups = np.split(order, np.searchsorted(sizes, np.arange(TILE[1], sizes[-1], TILE[1]), "right"))
                else:
                    groups = [np.arange(i, min(i + TILE[1], len(ci))) for i in range(0, len(ci), TILE[1])]
                for cols in groups:
                    if blocks:
                        cols = cols[top[cols] >= low.min() - slack]
                        cols = np.concatenate([b_rows[b_cuts[c] : b_cuts[c + 1]] for c in cols]) if len(cols) else cols
                    if not len(cols):
                        continue
                    score = fast @ fast_y[cols].T
                    same = ids[:, None] == ci[cols] if exclude_self or self_score is not None else None
                    if same is not None:
                        score[same] = -np.inf if self_score is None else self_score
                    if before:
                        score[(b_at[cols] >= q_at[at][:, None]) | (score <= q_floor[at][:, None] - slack)] = -np.inf
                    if low.min() == -np.inf and len(cols) > k:
                        low = np.maximum(low, np.partition(score, len(cols) - k, axis=1)[:, len(cols) - k])
                    hit = np.flatnonzero(score >= (low - slack).astype(score.dtype)[:, None])
                    hit = hit[score.ravel()[hit] > -np.inf]
                    if not len(hit):
                        continue
                    r, c = np.divmod(hit, len(cols))
                    v = np.einsum("ij,ij->i", own[r], y[cols[c]])
                    if self_score is not None:
                        v[same[r, c]] = self_score
                    c = cols[c]
                    if before:
                        fine = v > q_floor[at][r]
                        r, c, v = r[fine], c[fine], v[fine]
                    row, col, val = np.r_[row, r], np.r_[col, c], np.r_[val, v]
                    best = np.lexsort((ci[col], -val, row))
                    row, col, val = row[best], col[best], val[best]
                    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
                    full = place == k - 1
                    low[row[full]] = np.maximum(low[row[full]], val[full])
                    row, col, val = row[place < k], col[place < k], val[place < k]
                fits = val >= known[at][row] - SLACK
                out.append((ids[row[fits]], ci[col[fits]], val[fits]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"query_id": columns[0].astype(np.int64), "cand_id": columns[1].astype(np.int64), "score": columns[2].astype(np.float64)})

    return product


#: What rounding may take from a product, at most.
SLACK = 1e-9


def _coarse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides for coarse products, and twice what their rounding may take: in single precision (half a last digit for each number, product and sum), unless numbers are too large or not finite."""
    most = float(np.sqrt(np.einsum("ij,ij->i", x, x).max() * np.einsum("ij,ij->i", y, y).max()))
    if not most < 1e30:
        return x, y, SLACK
    return x.astype(np.float32), y.astype(np.float32), SLACK + 2.0**-22 * (x.shape[1] + 4) * most


def _in_line(x: np.ndarray) -> list[int]:
    """Positions in an order in which near vectors are near: halved along the widest axis, again and again."""

    def halves(at: np.ndarray) -> list[int]:
        if len(at) < 3:
            return at.tolist()
        axis = int(np.ptp(x[at], axis=0).argmax())
        at = at[np.argsort(x[at, axis], kind="stable")]
        return halves(at[: len(at) // 2]) + halves(at[len(at) // 2 :])

    return halves(np.arange(len(x)))


def _near_blocks(df: DataFrame, pivots: np.ndarray, block: int) -> tuple[DataFrame, int, int]:
    """``df`` with ``blk``: vectors of the nearest pivot, in blocks of about ``block``, and ``lot``: consecutive blocks that are shipped together; and the numbers of both."""
    norms = (pivots * pivots).sum(axis=1)

    @F.pandas_udf(T.IntegerType())
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series((norms - 2 * (x @ pivots.T)).argmin(axis=1).astype(np.int32))

    celled = cut(df.withColumn("cell", nearest("embedding")))
    sizes = {r.cell: r.n for r in celled.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("n")).collect()}  # a row a pivot
    starts = np.cumsum([0, *(sizes.get(i, 0) for i in range(len(pivots)))])
    # lots of a task's size, but some of them also where rows are few
    held = max(1, min(min(LOT, LOT_NUMBERS // max(1, pivots.shape[1])) // block, -(-int(starts[-1]) // 8)))
    plan = df.sparkSession.createDataFrame([(i, int(starts[i]), n) for i, n in sizes.items()], "cell int, first long, n long")
    dealt = celled.join(F.broadcast(plan), "cell").withColumn("blk", F.col("first") + F.pmod(F.xxhash64("id"), F.col("n")))
    return dealt.withColumn("lot", F.floor(F.col("blk") / held)).drop("cell", "first", "n"), int(starts[-1]), -(-int(starts[-1]) // held)


def _stats(rows: DataFrame, before: bool) -> DataFrame:
    """A row a block: its lot, centre, radius, and the smallest and largest ``at``."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("blk")
        blk = t["blk"].to_numpy()
        cuts, centre, radius = _spheres(matrix(t["embedding"]), blk)
        at = t["at"].to_numpy() if before else np.zeros(len(blk), np.int64)
        low, high = (f.reduceat(at, cuts[:-1]) for f in (np.minimum, np.maximum))
        return pa.table({"blk": blk[cuts[:-1]], "lot": t["lot"].to_numpy()[cuts[:-1]], "centre": pa.array(list(centre), pa.list_(pa.float64())), "radius": radius, "first": low, "last": high})

    return rows.groupBy("lot").applyInArrow(one, "blk long, lot long, centre array<double>, radius double, first long, last long")


def bounded_top_k(queries: DataFrame, base: DataFrame, k: int, product: Callable, self_score: float | None = None, before: bool = False, block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """``top_k`` where bounds leave out pairs of blocks: the result, how many pairs were open by their bounds and how many there are.

    Blocks are made of vectors around the same pivot. Each block of queries is first multiplied with the block whose centre has the largest product with its own, which gives each query a k-th best so
    far. No product of two blocks exceeds what centres and radii allow, so only pairs that may reach the least of their queries' k-th best are multiplied. Blocks are shipped in lots
    of up to 16,384 rows, to the lots with which they have an open pair: a row is copied once for each lot, not once for each block of the other side. Block
    statistics meet by the same lots; a row for each pair of lots leaves their tasks.
    """
    count = base.count()
    if not count:
        return queries.sparkSession.createDataFrame([], HITS + ", rank int"), 0, 0
    sample = base.orderBy(F.xxhash64("id")).limit(max(1, min(PIVOTS, -(-count // block)))).select("embedding").collect()
    pivots = np.array([r.embedding for r in sample], dtype=np.float64)
    pivots = pivots[_in_line(pivots)]
    (q, n_q, lots_q), (b, n_b, lots_b) = (_near_blocks(df, pivots, block) for df in (queries, base))
    q, b = cut(q), cut(b)
    sq, sb = (cut(_stats(df, before)) for df in (q, b))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    right = sb.select("*", F.col("lot").alias("lb"), copies(lots_q).alias("lq"))

    def bounds(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        middle, top = _upper(matrix(x["centre"]), x["radius"].to_numpy(), matrix(y["centre"]), y["radius"].to_numpy())
        if self_score is not None:
            top = np.maximum(top, self_score)
        if before:
            top[y["first"].to_numpy() >= x["last"].to_numpy()[:, None]] = -np.inf
        return middle, top

    def nearest(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"qb": pa.array([], pa.int64()), "bb": pa.array([], pa.int64()), "middle": pa.array([], pa.float64())})
        middle, top = bounds(x, y)
        middle = np.where(top > -np.inf, middle, -1e300)
        at = middle.argmax(axis=1)
        return pa.table({"qb": x["blk"].to_numpy(), "bb": y["blk"].to_numpy()[at], "middle": middle[np.arange(len(at)), at]})

    def open_lots(x: pa.Table, y: pa.Table) -> pa.Table:
        n, rest = 0, 0
        if x.num_rows and y.num_rows:
            _, top = bounds(x, y)
            near = (top >= x["least"].to_numpy()[:, None] - SLACK) & (top > -np.inf)
            n, rest = int(near.sum()), int((near & (y["blk"].to_numpy() != x["seed"].to_numpy()[:, None])).sum())
        lots = [[x["lq"][0].as_py()], [y["lb"][0].as_py()], [rest]] if n else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in lots], ["lq", "lb", "n"])

    def met(left: DataFrame, work: Callable, schema: str) -> DataFrame:
        return left.groupBy("lq", "lb").cogroup(right.groupBy("lq", "lb")).applyInArrow(work, schema)

    def dealt(s: DataFrame) -> DataFrame:
        return s.select("*", F.col("lot").alias("lq"), copies(lots_b).alias("lb"))

    qs = q.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), *([F.col("at").alias("at"), "floor"] if before else []), "blk", F.col("lot").alias("lq"))
    bs = b.select(F.col("id").alias("cand_id"), F.col("embedding").alias("b"), *([F.col("at").alias("at")] if before else []), "blk", F.col("lot").alias("lb"))

    seeds = cut(met(dealt(sq), nearest, "qb long, bb long, middle double").groupBy("qb").agg(F.max_by("bb", "middle").alias("bb")))
    x = qs.drop("lq").join(seeds.hint("merge"), F.col("blk") == F.col("qb")).drop("blk")
    y = bs.drop("lb").join(seeds.select(F.col("qb").alias("of"), "bb").hint("merge"), F.col("blk") == F.col("bb")).drop("blk", "bb")
    first = cut(x.groupBy("qb").cogroup(y.groupBy("of")).applyInArrow(product, HITS))
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    floor = F.coalesce(F.col("floor"), F.lit(float("-inf"))) if before else F.lit(float("-inf"))
    asked = cut(qs.join(kth, "query_id", "left").withColumn("known", F.greatest(F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("-inf"))), floor)).drop("n", "worst"))
    least = asked.groupBy("blk").agg(F.min("known").alias("least")).join(seeds.select(F.col("qb").alias("blk"), F.col("bb").alias("seed")), "blk")
    pairs = cut(met(dealt(sq.join(least, "blk")), open_lots, "lq long, lb long, n long"))
    tried = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # 24 bytes for each two lots
    x, y = asked.join(F.broadcast(pairs.select("lq", "lb")), "lq"), bs.join(F.broadcast(pairs.select("lq", "lb")), "lb")
    rest = x.groupBy("lq", "lb").cogroup(y.groupBy("lq", "lb")).applyInArrow(product, HITS)
    return ranked(rest, ["query_id"], k), n_q + tried, n_q * n_b


def product_sums(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """``(<by>, pairs, mean, most)`` of all products of a left and a right vector with the same ``by``; both sides are (by, embedding), pairs without a product count only as pairs.

    Both sides of a group meet in lots of up to 16,384 rows; a row for each two lots leaves their task.
    """
    sizes = lambda df, name: df.groupBy("g").agg(F.ceil(F.count("*") / LOT).alias(name))
    own = lambda n: F.pmod(F.xxhash64(F.lit(7), "v", F.monotonically_increasing_id()), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kind = left.schema[by].dataType.simpleString()
    left, right = (df.where(F.col(by).isNotNull()).select(F.col(by).alias("g"), F.col("embedding").alias("v")) for df in (left, right))
    plan = cut(sizes(left, "lots_q").join(sizes(right, "lots_b"), "g"))
    x = left.join(plan, "g").withColumn("lq", own("lots_q")).select("g", "v", "lq", every("lots_b").alias("lb"))
    y = right.join(plan, "g").withColumn("lb", own("lots_b")).select("g", "v", "lb", every("lots_q").alias("lq"))

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], a["g"].type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], ["g", "pairs", "n", "total", "most"])
        u, v = (matrix(t["v"].drop_null()) for t in (a, b))
        total, most = 0.0, None
        for i in range(0, len(u), TILE[0]):
            for j in range(0, len(v), TILE[1]):
                score = u[i : i + TILE[0]] @ v[j : j + TILE[1]].T
                total += score.sum()
                most = max(score.max(), score.max() if most is None else most)
        values = ([a["g"][0].as_py()], a["g"].type), ([a.num_rows * b.num_rows], pa.int64()), ([len(u) * len(v)], pa.int64()), ([total], pa.float64()), ([most], pa.float64())
        return pa.table([pa.array(x, t) for x, t in values], ["g", "pairs", "n", "total", "most"])

    each = x.groupBy("g", "lq", "lb").cogroup(y.groupBy("g", "lq", "lb")).applyInArrow(sums, f"g {kind}, pairs long, n long, total double, most double")
    return each.groupBy(F.col("g").alias(by)).agg(F.sum("pairs").alias("pairs"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"), F.max("most").alias("most"))


def top_k_two_stores(queries: DataFrame, opened: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The best of each store, open ones first: ``(query_id, kind, cand_id, score, rank)``."""
    first = top_k(queries, opened, k).withColumn("kind", F.lit("open"))
    return first.unionByName(top_k(queries, known, k).withColumn("kind", F.lit("kg")))


def argmax_above(rows: DataFrame, by: list[str], threshold: float, order: str, score: str = "score") -> DataFrame:
    """The best row of each group above ``threshold`` and above -1, both strictly; of equal scores the first by ``order``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), order)
    return rows.where((F.col(score) > threshold) & (F.col(score) > -1)).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def index_size(rows: int) -> tuple[int, int]:
    """Cells and probes by number of vectors."""
    for below, cells, probes in ((100_000, 256, 16), (1_000_000, 1024, 32), (10_000_000, 4096, 64)):
        if rows < below:
            return cells, probes
    return 8192, 128


class CellIndex:
    """Inverted lists: vectors by their nearest of ``cells`` centroids; centroids are at most 8,192 and stay on the driver."""

    def __init__(self, base: DataFrame, cells: int | None = None, seed: int = 42, sample: int = 200_000) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = base.count()
        self.cells = min(cells or index_size(n)[0], max(1, n))
        fit = base if n <= sample else base.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
        if self.cells == 1:
            one = base.select("embedding").first()
            self.centroids = np.array([one.embedding if one else []], dtype=np.float64)
            self.rows = base.select(F.col("id").alias("cand_id"), F.col("embedding").alias("b"), F.lit(0).alias("cell"))
            return
        model = KMeans(k=self.cells, seed=seed, maxIter=10, featuresCol="f").fit(fit.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("f")))
        self.centroids = np.stack(model.clusterCenters())
        self.rows = self.assigned(base, 1).withColumnRenamed("id", "cand_id").withColumnRenamed("embedding", "b")

    def save(self, path: str) -> None:
        """Vectors below ``vectors``, one folder a cell, and centroids below ``centroids``; an existing index raises."""
        self.rows.write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/vectors")
        self.save_centroids(self.rows.sparkSession, path)

    def save_centroids(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        """A saved index; a search reads the folders of the cells it probes."""
        index = cls.__new__(cls)
        index.centroids = cls.load_centroids(spark, path)
        index.cells = len(index.centroids)
        index.rows = spark.read.parquet(f"{path}/vectors")
        return index

    @staticmethod
    def load_centroids(spark: SparkSession, path: str) -> np.ndarray:
        return np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])  # at most 8,192

    def assigned(self, df: DataFrame, probes: int) -> DataFrame:
        """``(id, embedding, cell)``: one row for each of the ``probes`` nearest cells."""
        centroids, count = self.centroids, min(probes, len(self.centroids))
        norms = (centroids * centroids).sum(axis=1)

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def nearest(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()).astype(np.float64)
            far = norms - 2 * (x @ centroids.T)
            return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :count].astype(np.int32)))

        return df.select("id", "embedding", F.explode(nearest("embedding")).alias("cell"))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """Approximate top-k: queries and vectors of a cell meet in lots, whose dense products give each query's best of the lot; those are ranked."""
        asked = cut(self.assigned(queries.where("embedding IS NOT NULL"), probes))
        lots = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / LOT).alias(name))
        plan = F.broadcast(cut(lots(asked, "lots_q").join(lots(self.rows, "lots_b"), "cell")))  # a row a cell
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).alias("lq" if n == "lots_q" else "lb")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("lq" if n == "lots_q" else "lb")
        q = asked.join(plan, "cell").select("cell", F.col("id").alias("query_id"), F.col("embedding").alias("q"), own("id", "lots_q"), every("lots_b"))
        b = self.rows.where("b IS NOT NULL").join(plan, "cell").select("cell", "cand_id", "b", own("cand_id", "lots_b"), every("lots_q"))
        hits = q.groupBy("cell", "lq", "lb").cogroup(b.groupBy("cell", "lq", "lb")).applyInArrow(_product(k, False, None, False), HITS)
        return ranked(hits, ["query_id"], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    hit = exact.select("query_id", "cand_id").join(found.select("query_id", "cand_id", F.lit(1).alias("hit")), ["query_id", "cand_id"], "left")
    return hit.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), F.coalesce(F.try_divide(F.count("hit"), F.count("*")), F.lit(0.0)).alias("recall"))


