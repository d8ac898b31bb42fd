"""Folds whose rows see what earlier rows left, settled in rounds over all rows instead of row by row.

Every row states what an earlier, unsettled row would have to be to change its outcome: close enough to enter its candidates, or of its own label. Rows that no
such row stands before are settled as the sequential fold settles them, all at once; what they add then reaches the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.names import NEW_ENTITY
from kgspark.operators import vectors as V
from kgspark.operators.linking import dense_numbers
from kgspark.session import cut

CANDS = "array<struct<less: double, cand_id: bigint, label: string>>"
Judge = Callable[[DataFrame], DataFrame]


def _candidates(rows: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """``(id, found)``: the ``k`` best rows of ``store`` (id, label, own) before each row and above its bar, best first; at most ``k`` of them meet in a row."""
    hits = V.top_k(rows.select("id", F.col("id").alias("at"), "embedding", F.col("bar").alias("floor")), store.select("id", F.col("id").alias("at"), F.col("own").alias("embedding")), k, before=True)
    named = hits.join(store.select(F.col("id").alias("cand_id"), "label"), "cand_id")
    return named.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "cand_id", "label"))).cast(CANDS).alias("found"))


def _stands_after(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``(id)`` of the rows that an earlier one of ``others`` could change: it has the label, or would be among the candidates."""
    near = V.top_k(rows.select("id", F.col("id").alias("at"), "embedding", F.col("bar").alias("floor")), others.select("id", F.col("id").alias("at"), F.col("own").alias("embedding")), 1, before=True).select(F.col("query_id").alias("id"))
    first = others.groupBy("label").agg(F.min("id").alias("first"))
    return near.unionAll(rows.join(first, "label").where("first < id").select("id")).distinct()


def settle(rows: DataFrame, store: DataFrame, k: int, judge: Judge, certain: bool = False) -> tuple[DataFrame, int]:
    """``(id, adds, chosen, cands)`` of every row as the sequential fold has them, and the number of rounds.

    ``rows`` is (id, label, embedding, own, floor) and what ``judge`` reads: ``embedding`` looks for candidates, ``own`` is found once the row is in the store. ``store`` (id, label, own) is what is
    there from the start, with smaller ids; ids are unique and give the order. A row's candidates are the ``k`` best of the store and of earlier rows that added themselves, above ``floor``, ties by id. ``judge`` sets
    ``adds`` and ``chosen`` from ``cands``, where ``stale`` says that they are new. A row whose label an earlier row added is that label.

    Each round judges all open rows by the store as it stands and settles those before the first one that an addition would change, and further those that no earlier open row could
    change; only rows whose candidates a round's additions changed are judged again. ``certain`` says that a row that doesn't add never will, however many
    candidates come: such rows stop others no longer (their ``chosen`` and ``cands`` are then those of the round). Each round settles the first open row at least.
    """
    extra = [c for c in rows.columns if c not in ("id", "label", "embedding", "own", "floor")]
    bar = lambda: F.when(F.size("cands") >= k, F.greatest("floor", -F.col("cands")[k - 1].less)).otherwise(F.col("floor"))
    none = F.array().cast(CANDS)
    began = cut(rows.withColumn("bar", F.col("floor")))
    todo = began.join(_candidates(began, store, k), "id", "left").withColumn("cands", F.coalesce("found", none)).drop("found")
    todo = todo.withColumns({"bar": bar(), "stale": F.lit(True), "adds": F.lit(None).cast("boolean"), "chosen": F.lit(None).cast("string")})
    done: list[DataFrame] = []
    rounds = 0
    while True:
        todo = cut(judge(todo).select("id", "label", "embedding", "own", "floor", *extra, "cands", "bar", "stale", "adds", "chosen"))
        if todo.isEmpty():
            break
        rounds += 1
        changed = cut(_stands_after(todo, todo.where("adds")))
        first = changed.agg(F.min("id")).first()[0]
        if first is None:
            done.append(todo)
            break
        late = todo.where(F.col("id") >= first)
        waiting = changed if certain else cut(changed.unionAll(_stands_after(late, late)))
        kept = late.join(waiting, "id", "left_semi")
        kept = kept.where("adds") if certain else kept
        settled = cut(todo.join(kept.select("id"), "id", "left_anti"))
        new = settled.where("adds").select("id", "label", "own")
        names = new.groupBy("label").agg(F.min("id").alias("first"))
        left = cut(kept.join(names, "label", "left").withColumn("named", F.coalesce(F.col("first") < F.col("id"), F.lit(False))).drop("first"))
        done += [settled, left.where("named").withColumns({"adds": F.lit(False), "chosen": F.col("label")})]
        open_ = left.where("NOT named").drop("named")
        more = _candidates(open_, new, k)
        todo = open_.join(more, "id", "left").withColumns({"stale": F.col("found").isNotNull(), "cands": F.when(F.col("found").isNull(), F.col("cands")).otherwise(F.slice(F.array_sort(F.concat("cands", "found")), 1, k))})
        todo = todo.drop("found").withColumn("bar", bar())
    out = [d.select("id", "adds", "chosen", "cands") for d in done] or [todo.select("id", "adds", "chosen", "cands")]
    for d in out[1:]:
        out[0] = out[0].unionAll(d)
    return cut(out[0]), rounds


def numbered_rows(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``rows`` with dense numbers in the order of several columns."""
    return dense_numbers(rows.withColumn("__key", F.struct(*order)), "__key", name).drop("__key")


def canonicalize_ordered(rows: DataFrame, opened: DataFrame, threshold: float) -> DataFrame:
    """The strict fold: ``(doc_id, pos, rel, canonical)``; each relation that is added can be chosen by the next row.

    ``rows`` is (doc_id, pos, rel, embedding) of relations, ``opened`` (label, embedding). In order of document and position a row takes the label that it has
    if that is in the schema, else the nearest relation above ``threshold`` (ties: open ones by label, then in order of addition), or joins the schema. Rows without a
    vector match nothing. Settled in rounds; rows that find a relation above the threshold never add one later.
    """
    return canonicalize_on(rows, opened.select("label", "embedding", F.lit(0).alias("ord")), threshold)[0]


def canonicalize_on(rows: DataFrame, opened: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``canonicalize_ordered`` from a schema that has grown before, and what the rows add to it: ``(label, embedding, ord)``.

    ``opened`` is (label, embedding, ord), its rows in order of ``ord`` and label; the numbers of additions are row numbers from 0 in order of addition.
    """
    size = opened.count()
    store = cut(numbered_rows(opened.select("label", F.col("embedding").alias("own"), "ord"), ["ord", "label"]).withColumn("id", F.col("id") - size)).drop("ord")
    all_ = cut(numbered_rows(rows.select("doc_id", "pos", F.col("rel").alias("label"), "embedding"), ["doc_id", "pos"]))
    is_open = all_.join(store.select("label").distinct(), "label", "left_semi").select("doc_id", "pos", F.col("label").alias("rel"), F.col("label").alias("canonical"))
    fresh = cut(all_.join(store.select("label").distinct(), "label", "left_anti").withColumns({"own": F.col("embedding"), "floor": F.lit(float(threshold))}))
    judge = lambda df: df.withColumns({"adds": F.size("cands") == 0, "chosen": F.try_element_at("cands", F.lit(1)).label})
    decided, _ = settle(fresh.select("id", "label", "embedding", "own", "floor"), store, 1, judge, certain=True)
    added = cut(fresh.join(decided.where("adds").select("id"), "id", "left_semi").select("id", "label", "own"))
    names = added.groupBy("label").agg(F.min("id").alias("first"))
    rest = cut(fresh.join(names, "label", "left").where("first IS NULL OR id < first"))
    near = _candidates(rest.withColumn("bar", F.col("floor")), store.select("id", "label", "own").unionAll(added), 1)
    taken = rest.join(near, "id", "left").select("doc_id", "pos", F.col("label").alias("rel"), F.col("found")[0].label.alias("canonical"))
    own = fresh.join(names, "label").where("id >= first").select("doc_id", "pos", F.col("label").alias("rel"), F.col("label").alias("canonical"))
    return is_open.unionAll(own).unionAll(taken), added.select("label", F.col("own").alias("embedding"), F.col("id").alias("ord"))


def nil_fold(mentions: DataFrame, threshold: float, kg_candidates: DataFrame | None = None, kg_threshold: float = 0.5) -> DataFrame:
    """Sequential linking: ``(doc_id, ent_pos, identifier)``.

    A mention takes the best of its KG candidates strictly above ``kg_threshold`` or the best earlier new entity strictly above ``threshold``, whichever scores higher, KG
    first on ties; else it founds a new entity. New entities are visible to later documents only; numbers are given once and never again, in order.

    Who is in the store doesn't depend on whom they name: a mention without a KG candidate is in it for certain, and one with a candidate if some earlier member is nearer than that.
    Rounds carry this from member to member; then each member points at its nearest earlier one, and pointers are doubled until they
    reach founders. Rounds follow the longest chain of mentions that are in the store because of one another.
    """
    held = mentions.sparkSession.createDataFrame([], "number long, embedding array<double>, ord long")
    return nil_fold_on(mentions, held, 0, threshold, kg_candidates, kg_threshold)[0]


def nil_fold_on(mentions: DataFrame, held: DataFrame, start: int, threshold: float, kg_candidates: DataFrame | None = None, kg_threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``nil_fold`` after documents that were folded before, and what the mentions add to the store: ``(number, embedding, ord, founds)``.

    ``held`` is (number, embedding, ord): the store's mentions in order of ``ord`` with the numbers of their entities; all are visible. New entities are numbered from ``start``.
    In what is added, ``ord`` counts the mentions given from 0 and ``founds`` tells the founder of an entity from those who joined it.
    """
    rows = mentions.select("doc_id", "ent_pos", F.col("embedding").cast("array<double>").alias("embedding"))
    if kg_candidates is not None:
        best = V.argmax_above(kg_candidates, ["doc_id", "ent_pos"], kg_threshold, "cand_id").select("doc_id", "ent_pos", F.col("cand_id").cast("string").alias("kg"), F.col("score").alias("kg_score"))
        rows = rows.join(best, ["doc_id", "ent_pos"], "left")
    else:
        rows = rows.withColumns({"kg": F.lit(None).cast("string"), "kg_score": F.lit(None).cast("double")})
    never = -(1 << 63)
    place = F.coalesce(F.greatest(F.col("doc_id").cast("long"), F.lit(never + 2)), F.lit(never + 1))
    rows = cut(numbered_rows(rows, ["doc_id", "ent_pos"]).withColumns({"at": place, "floor": F.greatest(F.lit(float(threshold)), "kg_score")}))
    point = ("id", "at", "embedding")
    size = held.count()
    old = cut(numbered_rows(held.select("number", "embedding", "ord"), ["ord"]).withColumns({"id": F.col("id") - size, "at": F.lit(never)}))
    members = rows.where("kg IS NULL")
    front = members.select(*point).unionAll(old.select(*point))
    todo = rows.where("kg IS NOT NULL")
    while True:
        hit = V.top_k(todo.select(*point, "floor"), front.select(*point), 1, before=True)
        front = cut(todo.join(hit.select(F.col("query_id").alias("id")), "id", "left_semi"))
        if front.isEmpty():
            break
        members = members.unionByName(front)
        todo = cut(todo.join(front.select("id"), "id", "left_anti"))
    members = cut(members)
    nearest = V.top_k(members.select(*point, "floor"), members.select(*point).unionAll(old.select(*point)), 1, before=True).select(F.col("query_id").alias("id"), F.col("cand_id").alias("up"))
    roots = old.select("id", F.col("id").alias("up"))
    up = cut(members.select("id").join(nearest, "id", "left").select("id", F.coalesce("up", "id").alias("up")).unionAll(roots))
    while True:
        above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jumped = cut(up.join(above, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        up = jumped.select("id", "up")
        if jumped.where("moved").isEmpty():
            break
    founders = dense_numbers(up.where("id = up AND id >= 0").select("up"), "up").select("up", (F.col("number") + start).alias("number"))
    entities = founders.unionAll(old.select(F.col("id").alias("up"), "number"))
    named = cut(members.join(up, "id").join(entities, "up").withColumn("founds", F.col("id") == F.col("up")))
    new = named.select("doc_id", "ent_pos", F.concat(F.lit(NEW_ENTITY), F.col("number").cast("string")).alias("identifier"))
    out = todo.select("doc_id", "ent_pos", F.col("kg").alias("identifier")).unionAll(new)
    return out, named.select("number", "embedding", F.col("id").alias("ord"), "founds")
