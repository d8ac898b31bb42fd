"""Scoring of linked graphs against gold graphs: blank-node alignment, set counts, precision and recall.

Triples are rows ``(doc_id, s, p, o)``, or with further columns ``by``, each value of which is a graph of its own that is scored by itself. A term is a new node ("blank") if it begins with its side's prefix; the rest of the term is its id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.names import GOLD_PREFIX, NEW_PREFIX
from kgspark.session import cut

PARTS = ("s", "p", "o")
FLAGS = ("sb", "pb", "ob")
#: Aligned blanks that are sent to all tasks, at most: some tens of megabytes.
SENT = 500_000


By = tuple[str, ...]


def split_blank(triples: DataFrame, prefix: str, by: By = ()) -> DataFrame:
    """Terms without the prefix, and flags ``sb``, ``pb``, ``ob`` for those that had it; the bag stays a bag."""
    cols: list[str | Column] = [*by, "doc_id"]
    for c in PARTS:
        new = F.col(c).startswith(prefix)
        cols += [F.when(new, F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(F.col(c)).alias(c), new.alias(f"{c}b")]
    return triples.select(*cols)


def checked_gold(gold: DataFrame) -> DataFrame:
    """Gold triples; a triple with two blank terms raises when it is read."""
    blanks = sum((F.col(f"{c}b").cast("int") for c in PARTS), F.lit(0))
    text = F.concat(F.lit("gold triple with two blank nodes: "), F.concat_ws(", ", *PARTS))
    return gold.withColumn("sb", F.when(blanks > 1, F.raise_error(text).cast("boolean")).otherwise(F.col("sb")))


def blank_pairs(gold: DataFrame, system: DataFrame, local: bool, by: By = ()) -> DataFrame:
    """``([doc_id,] gold_blank, system_blank, n)``: in how many triples two blanks stand beside the same two terms.

    Both sides are ``split_blank`` rows, repeats allowed. Blanks of either side are set down with their place and the other two terms, once each, and meet in one join: whole triples aren't shuffled.
    """
    left, right = _places(gold, "gold_blank", by, False), _places(system, "system_blank", by, True)
    keys = [*by] + (["doc_id"] if local else []) + ["gold_blank", "system_blank"]
    return left.join(right, [*by, "doc_id", "place", "x1", "x2"]).groupBy(*keys).agg(F.count("*").alias("n"))


def _places(side: DataFrame, name: str, by: By, alone: bool) -> DataFrame:
    """``(by, doc_id, place, x1, x2, <name>)``, once each: blanks beside their triple's other terms, with ``alone`` only where those aren't blank."""
    found = []
    for i, c in enumerate(PARTS):
        others = [x for x in PARTS if x != c]
        here = F.col(f"{c}b")
        for x in others if alone else []:
            here = here & ~F.col(f"{x}b")
        found.append(F.when(here, F.struct(F.lit(i).alias("place"), F.col(others[0]).alias("x1"), F.col(others[1]).alias("x2"), F.col(c).alias(name))))
    return side.where("sb OR pb OR ob").select(*by, "doc_id", F.explode(F.array_compact(F.array(*found))).alias("b")).select(*by, "doc_id", "b.*").distinct()


def align(pairs: DataFrame, local: bool, strict_one_to_one: bool = False, by: By = ()) -> DataFrame:
    """``([doc_id,] system_blank, gold_blank)``: each system blank's most frequent partner, ties by the smaller gold id.

    As the scores to match have it, one gold blank may receive several system blanks. ``strict_one_to_one`` keeps, of those, the most
    frequent only.
    """
    scope = [*by] + (["doc_id"] if local else [])
    w = Window.partitionBy(*scope, "system_blank").orderBy(F.desc("n"), "gold_blank")
    out = pairs.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    if strict_one_to_one:
        w = Window.partitionBy(*scope, "gold_blank").orderBy(F.desc("n"), "system_blank")
        out = out.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return out.select(*scope, "system_blank", "gold_blank")


def renamed(system: DataFrame, alignment: DataFrame, local: bool, by: By = ()) -> DataFrame:
    """System triples with aligned blanks under their gold names, and their flags as they were; two triples may become one, so repeats are possible.

    Up to ``SENT`` aligned blanks, which is counted, go to the tasks, and triples stay where they are. With more, triples meet them in a shuffle; terms
    that aren't blank then get a key of their own, so that a predicate of many triples doesn't come together in one task.
    """
    alignment = cut(alignment)
    few = alignment.count() <= SENT
    out = system
    apart = F.lit(None) if few else F.concat(F.lit("\0"), F.xxhash64("doc_id", *PARTS).cast("string"))
    for c in PARTS:
        to = alignment.select(*(F.col(x).alias(f"_{x}") for x in alignment.columns))
        out = out.withColumn("_key", F.when(F.col(f"{c}b"), F.col(c)).otherwise(apart))
        on = F.col("_key") == F.col("_system_blank")
        for x in (*by, "doc_id") if local else by:
            on = on & (F.col(x) == F.col(f"_{x}"))
        out = out.join(F.broadcast(to) if few else to.hint("merge"), on, "left").withColumn(c, F.coalesce("_gold_blank", c)).drop("_key", *to.columns)
    return out.select(*by, "doc_id", *PARTS, *FLAGS)


def _confusion(both: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each element of either side, with flags; a single shuffle on the element instead of an outer join."""
    return both.groupBy(*keys).agg(F.max("g").alias("g"), F.max("y").alias("y"))


def _sums(extra: Column | None = None) -> list[Column]:
    return [
        F.count_if(F.col("g") & F.col("y")).alias("tp"),
        F.count_if(~F.col("g") & F.col("y")).alias("fp"),
        F.count_if(F.col("g") & ~F.col("y")).alias("fn"),
    ]


def counts(gold: DataFrame, mapped: DataFrame, by: By = (), kinds: tuple[str, ...] = ("triple", "entity", "relation")) -> DataFrame:
    """``(label, tp, fp, fn)`` for the ``kinds`` among triple, entity and relation, and the last two split into known and new nodes; both sides count as sets.

    Both sides are split rows, repeats allowed. A term is known if it isn't blank in some triple of either side. Terms are read from the rows as they come, where those of a subject often stand together, and
    not from distinct triples; whole triples are shuffled once, and only for the triples' own counts.
    """
    both = (
        gold.select(*by, "doc_id", *PARTS, *FLAGS, F.lit(True).alias("g"), F.lit(False).alias("y"))
        .unionAll(mapped.select(*by, "doc_id", *PARTS, *FLAGS, F.lit(False).alias("g"), F.lit(True).alias("y")))
    )
    out = []
    if "triple" in kinds:
        met = _confusion(both.drop(*FLAGS), [*by, "doc_id", *PARTS])
        out.append(met.groupBy(*by).agg(*_sums()).select(*by, F.lit("triple").alias("label"), "tp", "fp", "fn"))
    if {"entity", "relation"} & set(kinds):
        split = _term_counts(both, by).where(F.col("kind").isin(*kinds))
        out.append(split.groupBy(*by, F.col("kind").alias("label")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))
        out.append(split.select(*by, F.concat_ws("_", "known", "kind").alias("label"), "tp", "fp", "fn"))
    return reduce(DataFrame.unionAll, out)


def _term_counts(both: DataFrame, by: By) -> DataFrame:
    """``(by, kind, known, tp, fp, fn)`` of a document's distinct terms, at most four rows a graph, cut from their plan.

    Terms by document and kind first, then by term, which tells whether it is known anywhere; both are partial aggregates.
    """
    places = F.array(*[F.struct(F.lit(c == "p").alias("rel"), F.col(c).alias("x"), (~F.col(f"{c}b")).alias("kg")) for c in PARTS])
    terms = both.select(*by, "doc_id", "g", "y", F.explode(places).alias("t")).select(*by, "doc_id", "g", "y", "t.*")
    each = terms.groupBy(*by, "doc_id", "rel", "x").agg(F.max("g").alias("g"), F.max("y").alias("y"), F.max("kg").alias("kg"))
    cases = {"tp": F.col("g") & F.col("y"), "fp": ~F.col("g") & F.col("y"), "fn": F.col("g") & ~F.col("y")}
    names = [(kind, c) for kind in ("entity", "relation") for c in cases]
    named = each.groupBy(*by, "x").agg(F.coalesce(F.max("kg"), F.lit(False)).alias("kg"), *[F.count_if((F.col("rel") == (kind == "relation")) & cases[c]).alias(f"{kind}_{c}") for kind, c in names])
    sums = named.groupBy(*by, F.when(F.col("kg"), "kg").otherwise("nil").alias("known")).agg(*[F.sum(f"{kind}_{c}").alias(f"{kind}_{c}") for kind, c in names])
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), *[F.col(f"{kind}_{c}").alias(c) for c in cases]) for kind in ("entity", "relation")])
    return cut(sums.select(*by, "known", F.explode(kinds).alias("k")).select(*by, "k.kind", "known", "k.tp", "k.fp", "k.fn").where("tp + fp + fn > 0"))


def prf(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 beside tp, fp, fn; 0 where a denominator is 0."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    out = rows.withColumn("precision", p).withColumn("recall", r)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def length_ratio(gold: DataFrame, system: DataFrame) -> DataFrame:
    """Shares of documents with more, fewer and as many system triples as gold ones; bags, before any deduplication."""
    n = (
        gold.select("doc_id", F.lit(1).alias("g"), F.lit(0).alias("y"))
        .unionAll(system.select("doc_id", F.lit(0).alias("g"), F.lit(1).alias("y")))
        .groupBy("doc_id").agg(F.sum("g").alias("g"), F.sum("y").alias("y"))
    )
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return n.agg(
        share(F.col("y") > F.col("g")).alias("more_triples_created"),
        share(F.col("y") < F.col("g")).alias("fewer_triples_created"),
        share(F.col("y") == F.col("g")).alias("exact_triples_created"),
    )


def prepared(gold: DataFrame, system: DataFrame, system_prefix: str = NEW_PREFIX, by: By = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides as split triples; a gold triple of two blanks raises. They are read more than once, so what is dear to make should be cut before."""
    return checked_gold(split_blank(gold, GOLD_PREFIX, by)), split_blank(system, system_prefix, by)


def evaluate(gold: DataFrame, system: DataFrame, local: bool, system_prefix: str = NEW_PREFIX, strict_one_to_one: bool = False, by: By = ()) -> DataFrame:
    """``([by...,] label, tp, fp, fn, precision, recall, f1)`` for seven labels.

    ``local`` aligns blanks within each document, else over all documents together. Documents pair up by ``doc_id``. With ``by`` many graphs are scored at once, each by itself.
    """
    g, y = prepared(gold, system, system_prefix, by)
    alignment = align(blank_pairs(g, y, local, by), local, strict_one_to_one, by)
    return prf(counts(g, renamed(y, alignment, local, by), by))


def macro_triple_prf(gold: DataFrame, system: DataFrame) -> DataFrame:
    """Macro averages over distinct lower-cased triple strings, documents as samples: ``(classes, precision, recall, f1)``."""
    text = F.lower(F.concat_ws(" | ", *PARTS)).alias("triple")
    both = (
        gold.select("doc_id", text, F.lit(True).alias("g"), F.lit(False).alias("y"))
        .unionAll(system.select("doc_id", text, F.lit(False).alias("g"), F.lit(True).alias("y")))
    )
    by_class = prf(_confusion(both, ["doc_id", "triple"]).groupBy("triple").agg(*_sums()))
    return by_class.agg(
        F.count("*").alias("classes"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")
    )


def closure(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, int]:
    """``node``: everything reachable from ``start`` (column node) along ``(src, dst)``, start included; and the number of rounds.

    Nodes with one way out are followed by jumps of 1, 2, 4 ... steps, so a chain takes rounds in the logarithm of its length; cycles end, as nothing new is found. Only where ways part a round is
    one step, from the nodes found last. Null ends lead nowhere.
    """
    ways = cut(edges.select("src", "dst").where("src <> dst").distinct())
    out = ways.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"))
    jumps = [cut(out.where("n = 1").select("src", "dst"))]
    forks = cut(ways.join(out.where("n > 1").select("src"), "src", "left_semi"))
    seen = front = cut(start.select("node").distinct())
    rounds = 0
    while True:
        # all that chains reach from the front: after jumps of 1, 2, ... 2^i steps nothing nearer than 2^(i+1) is missing
        level = 0
        while True:
            if level == len(jumps):
                far = jumps[-1].select(F.col("src").alias("dst"), F.col("dst").alias("end"))
                jumps.append(cut(jumps[-1].join(far, "dst").select("src", F.col("end").alias("dst"))))
            rounds += 1
            new = cut(front.join(jumps[level], F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
            if new.isEmpty():
                break
            seen, front = cut(seen.unionAll(new)), cut(front.unionAll(new))
            level += 1
        rounds += 1
        front = cut(front.join(forks, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen, rounds
        seen = cut(seen.unionAll(front))


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node``: everything reachable from ``start`` (column node), start included."""
    return closure(edges, start)[0]


def reachable_overlap(edges: DataFrame, gold: DataFrame, system: DataFrame) -> DataFrame:
    """Share of the nodes reachable from ``gold`` that are reachable from ``system`` too; 0 where there are none."""
    g, y = descendants(edges, gold), descendants(edges, system).select("node", F.lit(1).alias("hit"))
    return g.join(y, "node", "left").agg(
        F.count("*").alias("reachable"), F.count("hit").alias("shared"), F.coalesce(F.try_divide(F.count("hit"), F.count("*")), F.lit(0.0)).alias("overlap")
    )
