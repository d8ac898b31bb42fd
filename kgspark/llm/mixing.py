"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / weight`` from a hash of itself; within a source the smallest keys come first, and
their sizes are summed up to the source's budget. Whole passes (epochs) over a source precede the fractional selection.

No source is sorted in one piece. Keys are dealt into ordered bins; the sums of the bins give the bin in which a
source's budget runs out, and only that bin's rows are sorted and summed. The document that doesn't fit any more is passed over, and
more rounds fill the rest of the budget from the smaller documents behind it; at last the one whose size is nearest to the rest goes in. The outcome is a few ranges of keys for each source, so
documents themselves are never shuffled: the decision is a comparison with their source's ranges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import members, others, unused
from kgspark.session import written

#: Fixed value: the pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
SEED = 2024
#: Sampling weights by label of quality; unlabelled documents lie between.
WEIGHTS = {1: 1.0, None: 0.5, 0: 0.1}
MOST = 3.0
#: Rows of a bin, about, that are sorted at once.
BIN_ROWS = 20_000
#: The share of a source's target that may stay open; until then documents that don't fit the rest are passed over.
OPEN = 0.001
_FIRST = (-1.0, -(1 << 63))


@dataclass
class Source:
    """What is decided for one source."""

    source: str | None
    size: int
    rows: int
    weight: float
    target: float = 0.0
    #: (low key, low tie, high key, high tie, most size): rows above low, up to high, of that size at most are taken once more than ``epochs``.
    rules: list[tuple[float, int, float, int, int]] = field(default_factory=list)

    @property
    def epochs(self) -> int:
        return int(self.target // self.size) if self.size else 0


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: list[tuple[float, int]], most: float = MOST) -> list[float]:
    """Shares of the total size by weight; none above ``most`` times its size, the excess reshared by weight.

    ``sources`` are (weight, size).
    """
    total = float(sum(size for _, size in sources))
    out = [0.0] * len(sources)
    free = [i for i, (_, size) in enumerate(sources) if size > 0]
    left = total
    while free:
        weight = sum(sources[i][0] for i in free)
        over = [i for i in free if left * sources[i][0] / weight > most * sources[i][1]]
        if not over:
            for i in free:
                out[i] = left * sources[i][0] / weight
            break
        for i in over:
            out[i] = most * sources[i][1]
            left -= out[i]
            free.remove(i)
    return out


def tie(seed: int = SEED) -> Column:
    """A row's own random number."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def keyed(docs: DataFrame, weights: DataFrame | None, seed: int = SEED) -> DataFrame:
    """``docs`` as (doc_id, source, size, weight, key, tie): key is the exponential key, tie breaks equal keys.

    ``weights`` is (doc_id, quality) or None; several labels of one document count by their mean.
    """
    base = docs.select("doc_id", "source", words(F.col("text")).alias("size"), tie(seed).alias("tie"))
    if weights is None:
        base = base.withColumn("weight", F.lit(WEIGHTS[None]))
    else:
        label = weights.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.avg("quality").alias("quality"))
        scale = F.coalesce(F.col("quality") * (WEIGHTS[1] - WEIGHTS[0]) + WEIGHTS[0], F.lit(WEIGHTS[None]))
        # labels grow with the documents, so the join is never a broadcast, at any size; hashing them spares a sort of the texts
        base = base.join(label.hint("shuffle_hash"), F.col("doc_id") == F.col("labelled"), "left").withColumn("weight", scale).drop("labelled", "quality")
    # u in (0, 1) from the hash's upper 53 bits
    u = (F.shiftrightunsigned("tie", 11).cast("double") + 0.5) / float(1 << 53)
    return base.withColumn("key", -F.log(u) / F.col("weight"))


def decide(rows: DataFrame, shares: tuple[int, ...] = (1, 2, 3), most: float = MOST) -> list[Source]:
    """Targets and cuts of all sources, from ``keyed`` rows.

    The driver holds one record for each source, none for documents. Sources stand by code point, null last, and weigh
    ``shares`` in turn.
    """
    near = F.round("weight", 1).alias("near")
    stats = rows.groupBy("source", near).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    sizes: dict[str | None, list[int]] = {}
    mass: dict[float, int] = {}
    for r in stats:  # a source has at most ten rounded weights
        own = sizes.setdefault(r.source, [0, 0])
        own[0] += int(r["size"])
        own[1] += int(r["rows"])
        mass[r.near] = mass.get(r.near, 0) + int(r["rows"])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    found = [Source(s, *sizes[s], float(shares[i % len(shares)])) for i, s in enumerate(order)]
    for s, t in zip(found, targets([(s.weight, s.size) for s in found], most)):
        s.target = t
    left = {i: s.target - s.epochs * s.size for i, s in enumerate(found)}
    low, most_size = dict.fromkeys(left, _FIRST), dict.fromkeys(left, 1 << 62)
    bins = max(16, math.ceil(max((s.rows for s in found), default=0) / BIN_ROWS))
    # the keys' distribution function: it is monotone in the key, and equal steps of it are bins of about equal rows
    share = sum((F.lit(n / sum(mass.values())) * F.exp(-F.lit(w) * F.col("key")) for w, n in sorted(mass.items())), F.lit(0.0))
    binned = rows.select("source", "size", "key", "tie", F.floor((1 - share) * bins).cast("int").alias("bin"))
    closed: dict[int, float] = {}
    while live := [i for i, n in left.items() if n >= 1 and n > OPEN * found[i].target]:
        for i, (rule, rest, crossing) in _fill(binned, [(i, found[i].source, left[i], *low[i], most_size[i]) for i in live]).items():
            if rule is not None:
                found[i].rules.append((*low[i], *rule, most_size[i]))
            left[i] = rest if crossing is not None else 0.0  # nothing is left to take
            low[i], most_size[i] = crossing or _FIRST, int(rest)
            if crossing is None:
                closed[i] = rest
    for i, n in left.items():
        closed.setdefault(i, n)
    last = [i for i, n in closed.items() if n >= 1 and n > OPEN * found[i].target]
    for i, (key, tie, size) in (_nearest(binned, found, {i: closed[i] for i in last}) if last else {}).items():
        found[i].rules.append((key, tie - 1, key, tie, size))
    return found


Key = tuple[float, int]


def _fill(binned: DataFrame, live: list[tuple]) -> dict[int, tuple[Key | None, float, Key | None]]:
    """One round for sources (number, source, left, low key, low tie, most size).

    Of the rows above low and of that size at most, in order of keys, those that fit ``left`` up to the first that doesn't: the key of the
    last that fits, what is left then, and the key of the first that doesn't fit; None where there is no such row.
    """
    plan = F.broadcast(  # one row a source
        binned.sparkSession.createDataFrame(live, "number int, s string, left double, low_key double, low_tie long, most long")
    )
    above = (F.col("key") > F.col("low_key")) | ((F.col("key") == F.col("low_key")) & (F.col("tie") > F.col("low_tie")))
    dealt = binned.join(plan, F.col("source").eqNullSafe(F.col("s"))).where((F.col("size") <= F.col("most")) & above)
    sums = dealt.groupBy("number", "left", "bin").agg(F.sum("size").alias("size"), F.max(F.struct("key", "tie")).alias("last"))
    by_bin = Window.partitionBy("number").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sums.withColumn("before", F.coalesce(F.sum("size").over(by_bin), F.lit(0))).withColumn("edge", F.max("last").over(by_bin))
    breaks = (F.col("before") <= F.col("left")) & (F.col("before") + F.col("size") > F.col("left"))
    ends = bins.groupBy("number").agg(
        F.max(F.when(breaks, F.struct("bin", "before", "edge"))).alias("at"), F.sum("size").alias("size"), F.max("last").alias("last")
    ).collect()  # one row a source
    out: dict[int, tuple[Key | None, float, Key | None]] = {}
    budget = {x[0]: x[2] for x in live}
    for r in ends:
        out[r.number] = ((r.last.key, r.last.tie), budget[r.number] - r["size"], None)
    for i in budget.keys() - out.keys():
        out[i] = (None, budget[i], None)
    broken = [(r.number, r["at"].bin, int(r["at"].before)) for r in ends if r["at"] is not None]
    if not broken:
        return out
    at = F.broadcast(binned.sparkSession.createDataFrame(broken, "n int, b int, before long"))  # one row a source
    within = dealt.join(at, (F.col("number") == F.col("n")) & (F.col("bin") == F.col("b")))
    # rows of one tie are one step, however many there are
    steps = within.groupBy("number", "left", "before", "key", "tie").agg(F.sum("size").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("number").orderBy("key", "tie"))
    fits = F.col("upto") <= F.col("left")
    cuts = steps.withColumn("upto", upto).groupBy("number").agg(
        F.max(F.when(fits, F.struct("key", "tie"))).alias("high"), F.max(F.when(fits, F.col("upto"))).alias("taken"), F.min(F.when(~fits, F.struct("key", "tie"))).alias("cross")
    ).collect()  # one row a source
    edges = {r.number: r["at"] for r in ends if r["at"] is not None}
    for r in cuts:
        high = r.high or edges[r.number].edge
        taken = r.taken if r.taken is not None else edges[r.number].before
        out[r.number] = ((high.key, high.tie) if high else None, budget[r.number] - taken, (r.cross.key, r.cross.tie))
    return out


def _nearest(binned: DataFrame, found: list[Source], left: dict[int, float]) -> dict[int, tuple[float, int, int]]:
    """Of the rows not taken yet, for each source the one whose size is nearest to what is left of its budget, if it brings the sum nearer: (key, tie, size)."""
    plan = F.broadcast(  # one row a source, a few rules each
        binned.sparkSession.createDataFrame([(i, found[i].source, n, found[i].rules) for i, n in left.items()], f"number int, s string, left double, {RULES}")
    )
    open_ = binned.join(plan, F.col("source").eqNullSafe(F.col("s"))).where((F.col("size") > 0) & (F.col("size") < 2 * F.col("left")) & ~_hit())
    steps = open_.groupBy("number", "left", "key", "tie").agg(F.sum("size").alias("sum"), F.max("size").alias("size")).where(F.col("sum") < 2 * F.col("left"))
    best = steps.groupBy("number").agg(F.min(F.struct(F.abs(F.col("sum") - F.col("left")).alias("miss"), "key", "tie", "size")).alias("x")).collect()  # one row a source
    return {r.number: (r.x.key, r.x.tie, r.x["size"]) for r in best}


RULES = "rules array<struct<lk:double,lt:long,hk:double,ht:long,most:long>>"


def _hit() -> Column:
    """Whether one of ``rules`` takes the row."""

    def one(r: Column) -> Column:
        above = (F.col("key") > r.lk) | ((F.col("key") == r.lk) & (F.col("tie") > r.lt))
        upto = (F.col("key") < r.hk) | ((F.col("key") == r.hk) & (F.col("tie") <= r.ht))
        return above & upto & (F.col("size") <= r.most)

    return F.exists("rules", one)


def counts(rows: DataFrame, found: list[Source]) -> DataFrame:
    """``keyed`` rows with their source's figures and ``copies``: how often the mix takes the row."""
    plan = F.broadcast(  # one row a source, a few rules each
        rows.sparkSession.createDataFrame(
            [(s.source, s.size, s.target, s.epochs, s.rules) for s in found],
            f"s string, source_size long, target double, epochs int, {RULES}",
        )
    )

    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.col("epochs") + _hit().cast("int"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED, shares: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row for each row of ``docs``; taken is size times copies.

    Null texts have size 0; null sources are a source of their own, the last. Rows that agree in id and text draw the same key and
    are taken or left together. Sources without words have target 0. Empty tables give no rows. Reruns agree.
    """
    rows = written(keyed(docs, weights, seed), "mix")
    out = counts(rows, decide(rows, shares))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def resample(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED, shares: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, with the columns of ``docs``.

    Null texts and texts without words are rows of size 0 that go with their key: once more than the whole epochs where a range takes them. Null sources are a source of
    their own. Rows that agree in id and text are taken or left together. Empty tables give no rows. Reruns agree. Texts aren't shuffled: the
    rows that the fractional selection takes are known by their ties.
    """
    rows = written(keyed(docs, weights, seed), "mix")
    found = decide(rows, shares)
    taken = written(counts(rows, found).where("copies > epochs").select("tie").distinct(), "mix-taken")
    own, name, epochs = unused("tie", docs.columns), unused("s", docs.columns), unused("epochs", docs.columns)
    plan = rows.sparkSession.createDataFrame([(s.source, s.epochs) for s in found], f"`{name}` string, `{epochs}` int")  # one row a source
    marked = docs.withColumn(own, tie(seed))
    out = None
    for part, more in ((members(marked, own, taken), 1), (others(marked, own, taken), 0)):
        copies = F.explode(F.array_repeat(F.lit(True), F.col(epochs) + more)).alias(unused("copy", docs.columns))
        part = part.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col(name))).where(F.col(epochs) + more > 0)
        part = part.select(*[F.col(f"`{c}`") for c in docs.columns], copies).select(*[F.col(f"`{c}`") for c in docs.columns])
        out = part if out is None else out.unionAll(part)
    return out
