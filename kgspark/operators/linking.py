"""Entity linking by clustering: alignment graph, components, splitting by best paths, identifiers.

Mention-entity edges are ``(mention, entity, score)``, mention-mention edges ``(m1, m2, score, ord)`` in order of emission. Nodes are
strings, ``m:`` or ``e:`` and an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.graph import connected_components
from kgspark.names import NEW_ENTITY, NEW_RELATION
from kgspark.session import cut



def alignment_edges(me: DataFrame, mm: DataFrame, me_threshold: float = 0.5, mm_threshold: float = 0.5) -> DataFrame:
    """``(a, b, weight)``, undirected and once: scores strictly above their threshold, at most 1.

    Of several edges between two mentions the one emitted last counts.
    """
    first = me.where(F.col("score") > me_threshold).select(F.concat(F.lit("m:"), "mention").alias("a"), F.concat(F.lit("e:"), "entity").alias("b"), "score", F.lit(-1).cast("long").alias("ord"))
    second = mm.where(F.col("score") > mm_threshold).select(
        F.concat(F.lit("m:"), F.least("m1", "m2")).alias("a"), F.concat(F.lit("m:"), F.greatest("m1", "m2")).alias("b"), "score", F.col("ord").cast("long")
    )
    return first.unionAll(second).where("a <> b").groupBy("a", "b").agg(F.max_by(F.least("score", F.lit(1.0)), "ord").alias("weight"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes, lonely ones included; a component is named by its smallest node."""
    found = connected_components(edges, "a", "b")
    return nodes.select("node").distinct().join(found, F.col("node") == F.col("id"), "left").select("node", F.coalesce("component", "node").alias("component"))


def validity(comps: DataFrame) -> DataFrame:
    """``(component, mentions, entities, valid)``: at most one entity makes a component valid."""
    is_entity = F.col("node").startswith("e:")
    out = comps.groupBy("component").agg(F.count_if(~is_entity).alias("mentions"), F.count_if(is_entity).alias("entities"))
    return out.withColumn("valid", F.col("entities") <= 1)


def best_paths(edges: DataFrame, sources: DataFrame, floor: float | Column = 0.0) -> DataFrame:
    """``(node, source, score)``: for each node the source with the largest product of weights along a path; ties by source.

    Relaxation from the nodes that changed last, until none does: only these are joined with their edges and with what is known of their neighbours, and what changed is put down beside
    the earlier rounds instead of rewriting them (the rounds are merged now and then). Paths at ``floor`` or below, a number or an expression of ``node``, are dropped, as no continuation can rise above it.
    """
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    both = cut(edges.select("a", "b", "weight").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    front = cut(sources.select("node", F.col("node").alias("source"), F.lit(1.0).alias("score")))

    def hop(front: DataFrame) -> DataFrame:
        step = front.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "source", F.round(F.col("score") * F.col("weight"), 12).alias("score"))
        return step.where((F.col("score") > floor) & ~F.col("node").startswith("e:"))

    return _relaxed(front, hop, ["node"])


def _relaxed(front: DataFrame, hop: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """``(*keys, source, score)``: the best of each key that ``hop`` after hop from ``front`` gives, ``front`` included."""
    known = [front]
    while True:
        step = _best(hop(front), keys)
        held = known[0]
        for k in known[1:]:
            held = held.unionAll(k)
        old = held.join(step.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.max("score").alias("old"), F.min_by("source", F.struct(-F.col("score"), "source")).alias("old_source"))
        better = (F.col("old").isNull()) | (F.col("score") > F.col("old")) | ((F.col("score") == F.col("old")) & (F.col("source") < F.col("old_source")))
        front = cut(step.join(old, keys, "left").where(better).select(*keys, "source", "score"))
        if front.isEmpty():
            return _best(held, keys)
        known.append(front)
        if len(known) > MERGED:
            known = [cut(_best(held.unionAll(front), keys))]


#: Rounds of ``best_paths`` that are kept side by side.
MERGED = 8


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by("source", F.struct(-F.col("score"), "source")).alias("source"), F.max("score").alias("score"))


def clusters(edges: DataFrame, nodes: DataFrame, path_threshold: float | Column = 0.75) -> DataFrame:
    """``(node, cluster, entity)`` of all mentions; ``path_threshold`` is a number or an expression of ``node``.

    Valid components are clusters. In others each mention joins the entity of its best path if that scores strictly above
    ``path_threshold``; the remaining mentions form the components of what they induce.
    """
    comps = cut(components(edges, nodes))
    state = validity(comps)
    marked = comps.join(state, "component")
    entity_of = comps.where(F.col("node").startswith("e:")).groupBy("component").agg(F.min("node").alias("entity"))
    fine = marked.where("valid").join(entity_of, "component", "left").where(F.col("node").startswith("m:")).select("node", F.coalesce("entity", "component").alias("cluster"), "entity")
    broken = cut(marked.where("NOT valid").select("node"))
    inner = edges.join(broken, F.col("a") == F.col("node"), "left_semi")
    paths = best_paths(inner, broken.where(F.col("node").startswith("e:")), path_threshold)
    assigned = paths.where(F.col("node").startswith("m:") & (F.col("score") > path_threshold)).select("node", F.col("source").alias("cluster"), F.col("source").alias("entity"))
    rest = cut(broken.where(F.col("node").startswith("m:")).join(assigned, "node", "left_anti"))
    left = edges.join(rest, F.col("a") == F.col("node"), "left_semi").join(rest, F.col("b") == F.col("node"), "left_semi")
    loose = components(left, rest).select("node", F.col("component").alias("cluster"), F.lit(None).cast("string").alias("entity"))
    return fine.unionAll(assigned).unionAll(loose)


def identifiers(clustered: DataFrame) -> DataFrame:
    """``(node, identifier)``: the cluster's entity, or a new one numbered by the cluster's smallest mention.

    Numbers come from counts of ranges, so clusters are never sorted in one task.
    """
    named = clustered.where("entity IS NOT NULL").select("node", F.substring("entity", 3, 1 << 20).alias("identifier"))
    new = clustered.where("entity IS NULL")
    heads = new.groupBy("cluster").agg(F.min("node").alias("head"))
    return named.unionAll(
        new.join(dense_numbers(heads, "head"), "cluster").select("node", F.concat(F.lit(NEW_ENTITY), F.col("number").cast("string")).alias("identifier"))
    )


def grid_identifiers(mentions: DataFrame, me: DataFrame, mm: DataFrame, grid: list[tuple[float, float, float]]) -> DataFrame:
    """``(point, mention, identifier)``: every mention at every point ``(me, mm, path)`` of ``grid``, in the clusters that ``clusters`` gives there; a new identifier has the number of its cluster's smallest mention.

    Nodes are numbers here, entities before mentions, and edges stay one table that isn't copied for the points: a hop reads the thresholds of the rows that it carries. Mentions are joined once for each
    mention-mention threshold, components and paths with entities are found once for each pair of thresholds, with the lowest path threshold of its points as floor: a path above a higher one has no
    part below it. Only what stays without an entity in a component of several is clustered point by point.
    """
    graphs = sorted({(float(a), float(b)) for a, b, _ in grid})
    lows, levels = sorted({a for a, _ in graphs}), sorted({b for _, b in graphs})
    floors = [min(float(c) for a, b, c in grid if (float(a), float(b)) == g) for g in graphs]
    rows_of = lambda rows, names: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    points = rows_of([(i, graphs.index((float(a), float(b))), float(c)) for i, (a, b, c) in enumerate(grid)], ("point", "graph", "path"))
    pairs = rows_of([(i, lows.index(a), levels.index(b), a) for i, (a, b) in enumerate(graphs)], ("graph", "low", "level", "me"))
    at = lambda values, column: F.element_at(F.array(*map(F.lit, values)), F.col(column) + 1)
    by_index = lambda values: rows_of(enumerate(values), ("i", "t"))

    ends = [mentions.select("mention"), me.select("mention"), mm.select(F.col("m1").alias("mention")), mm.select(F.col("m2").alias("mention"))]
    ends = ends[0].unionAll(ends[1]).unionAll(ends[2]).unionAll(ends[3]).distinct()
    names = me.select(F.concat(F.lit("e:"), "entity").alias("node")).distinct().unionAll(ends.select(F.concat(F.lit("m:"), "mention").alias("node")))
    numbers = cut(dense_numbers(names, "node"))
    size, new = numbers.agg(F.count("*"), F.count_if(F.col("node").startswith("e:"))).first()  # from ``new`` on numbers are mentions
    size = F.lit(max(size, 1)).cast("long")
    number = lambda kind, column: numbers.where(F.col("node").startswith(kind)).select(F.substring("node", 3, 1 << 20).alias(column), F.col("number").alias(f"{column}_n"))
    to_entity = cut(
        me.where("score IS NOT NULL").join(number("m:", "mention"), "mention").join(number("e:", "entity"), "entity")
        .groupBy(F.col("mention_n").alias("a"), F.col("entity_n").alias("b")).agg(F.max("score").alias("score"))
    )
    both = mm.where("score IS NOT NULL AND m1 <> m2").join(number("m:", "m1"), "m1").join(number("m:", "m2"), "m2")
    # an edge counts from the largest score that was emitted later for the same two mentions up to its own
    later = Window.partitionBy("a", "b").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    between = both.select(F.least("m1_n", "m2_n").alias("a"), F.greatest("m1_n", "m2_n").alias("b"), "score", "ord").withColumn("later", F.max("score").over(later))
    between = cut(between.where("later IS NULL OR score > later").drop("ord"))
    counts_at = lambda t: (F.col("score") > t) & F.coalesce(F.col("later") <= t, F.lit(True))

    alike = between.select("a", "b", F.explode(F.filter(by_index(levels), lambda x: counts_at(x["t"]))).alias("x")).select((F.col("x.i") * size + F.col("a")).alias("u"), (F.col("x.i") * size + F.col("b")).alias("v"))
    found = connected_components(alike, "u", "v")
    heads = found.groupBy((F.col("id") % size).alias("node")).agg(F.map_from_entries(F.collect_list(F.struct(F.floor(F.col("id") / size).cast("int"), F.col("component") % size))).alias("heads"))
    every = numbers.where(F.col("number") >= new).select(F.col("number").alias("node")).join(heads, "node", "left")
    every = cut(every.withColumn("heads", F.transform(F.array(*map(F.lit, range(len(levels)))), lambda i: F.coalesce(F.try_element_at("heads", i), F.col("node")))))
    head = lambda level: F.element_at("heads", level + 1)
    met = to_entity.join(every, F.col("a") == F.col("node")).select("b", "heads", F.explode(F.filter(pairs, lambda x: F.col("score") > x["me"])).alias("x"))
    whole = cut(connected_components(met.select((F.col("x.graph") * size + head(F.col("x.level"))).alias("u"), (F.col("x.graph") * size + F.col("b")).alias("v")), "u", "v"))
    # a component with an entity bears the number of its first
    several = whole.where(F.col("id") % size < new).groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.lit(True).alias("several"))
    whole = whole.where(F.col("id") % size >= new).join(several, "component", "left").select("id", (F.col("component") % size).alias("entity"), F.coalesce("several", F.lit(False)).alias("several"))
    state = every.select("node", "heads", F.explode(pairs).alias("x")).select("node", "x.graph", "x.low", "x.level", head(F.col("x.level")).alias("head"))
    state = cut(state.join(whole, F.col("graph") * size + F.col("head") == F.col("id"), "left").select("graph", "low", "level", "node", "head", "entity", F.coalesce("several", F.lit(False)).alias("several")))

    first = to_entity.select("a", "b", "score", F.explode(F.filter(by_index(lows), lambda x: F.col("score") > x["t"])).alias("x"))
    first = _best(first.select(F.col("a").alias("node"), F.col("x.i").alias("low"), F.col("b").alias("source"), F.round(F.least("score", F.lit(1.0)), 12).alias("score")), ["node", "low"])
    front = cut(state.where("several").select("graph", "low", "node").join(first, ["node", "low"]).where(F.col("score") > at(floors, "graph")).select("graph", "node", "source", "score"))
    ways = between.unionAll(between.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "later")).withColumn("weight", F.least("score", F.lit(1.0)))

    def hop(front: DataFrame) -> DataFrame:
        step = front.withColumnRenamed("score", "so_far").join(ways, F.col("node") == F.col("a")).where(counts_at(at([b for _, b in graphs], "graph")))
        return step.select("graph", F.col("b").alias("node"), "source", F.round(F.col("so_far") * F.col("weight"), 12).alias("score")).where(F.col("score") > at(floors, "graph"))

    paths = _relaxed(front, hop, ["graph", "node"])
    each = state.join(paths, ["graph", "node"], "left").select("*", F.explode(F.filter(points, lambda x: x["graph"] == F.col("graph"))).alias("x"))
    reached = F.coalesce(F.col("score") > F.col("x.path"), F.lit(False))
    each = cut(each.select("x.point", "level", "node", "head", F.when(~F.col("several"), F.col("entity")).when(reached, F.col("source")).alias("entity"), (F.col("several") & ~reached).alias("rest")))
    rest = each.where("rest").select("point", "level", "node")
    inner = rest.join(between, F.col("node") == F.col("a")).where(counts_at(at(levels, "level"))).select((F.col("point") * size + F.col("a")).alias("u"), (F.col("point") * size + F.col("b")).alias("v"))
    inner = inner.join(rest.select((F.col("point") * size + F.col("node")).alias("v")), "v", "left_semi")
    loose = rest.join(connected_components(inner, "u", "v"), F.col("point") * size + F.col("node") == F.col("id"), "left").select("point", "node", F.coalesce(F.col("component") % size, "node").alias("head"), F.lit(None).cast("long").alias("entity"))
    out = each.where("NOT rest").select("point", "node", "head", "entity").unionAll(loose)
    name = lambda column, on: numbers.select(F.col("number").alias(on), F.substring("node", 3, 1 << 20).alias(column))
    out = out.join(name("mention", "node"), "node").join(name("identifier", "entity").where(F.col("entity") < new), "entity", "left")
    return out.select("point", "mention", F.coalesce("identifier", F.concat(F.lit(NEW_ENTITY), F.col("head").cast("string"))).alias("identifier"))


def dense_numbers(df: DataFrame, order: str, name: str = "number") -> DataFrame:
    """0, 1, 2 ... by ``order``, over all rows: sorted by range, counted by partition, and offset; no task holds all rows."""
    spark = df.sparkSession
    tagged = cut(df.sort(order).withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__row", 33)
    sizes = {r.p: r.n for r in tagged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    plan = F.broadcast(spark.createDataFrame(starts, "__p long, __at long"))
    return tagged.join(plan, part == F.col("__p")).withColumn(name, F.col("__at") + F.col("__row").bitwiseAND((1 << 33) - 1)).drop("__row", "__p", "__at")


def linked(triples: DataFrame, ids: DataFrame, relations: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """``(doc_id, pos, s, p, o)`` with identifiers of the document's entities and URIs of relations.

    ``ids`` is (doc_id, entity, identifier), ``relations`` (rel, uri). Triples with an unlinked end go; ``keep_unknown`` keeps the relation's label where it has no URI.
    """
    name = lambda side: ids.select("doc_id", F.col("entity").alias(side), F.col("identifier").alias(f"{side}_id"))
    out = triples.join(name("subj"), ["doc_id", "subj"]).join(name("obj"), ["doc_id", "obj"]).join(relations, "rel", "left" if keep_unknown else "inner")
    return out.select("doc_id", "pos", F.col("subj_id").alias("s"), F.coalesce("uri", "rel").alias("p"), F.col("obj_id").alias("o"))


def relation_uris(triples: DataFrame, opened: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, pos, rel, uri)``: the open schema's number, else the KG's URI, else a new URI for every occurrence.

    New numbers follow the open schema's, in order of documents and positions.
    """
    size = opened.count()
    rows = (
        triples.join(opened.select(F.col("label").alias("rel"), F.col("ord").alias("open_ord")), "rel", "left")
        .join(known.select(F.col("label").alias("rel"), F.col("uri").alias("kg_uri")), "rel", "left")
        .select("doc_id", "pos", "rel", F.coalesce(F.concat(F.lit(NEW_RELATION), F.col("open_ord").cast("string")), "kg_uri").alias("uri"))
    )
    fresh = dense_numbers(rows.where("uri IS NULL").withColumn("__key", F.struct("doc_id", "pos")), "__key").drop("__key")
    return rows.where("uri IS NOT NULL").unionAll(
        fresh.select("doc_id", "pos", "rel", F.concat(F.lit(NEW_RELATION), (F.col("number") + size).cast("string")).alias("uri"))
    )
