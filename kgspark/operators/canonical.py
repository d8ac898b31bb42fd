"""Relation canonicalisation with schema enrichment, refinement hints, in batches and in strict order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import models as M
from kgspark.functions import text as X
from kgspark.operators import ordered as O
from kgspark.operators import sampling
from kgspark.operators import vectors as V
from kgspark.operators.linking import dense_numbers
from kgspark.session import cut, spread

VERIFY = "Text: {text}\nTriple: {triple}\nDefinition: {definition}\nWhich relation means the same?\n{choices}\nAnswer:"


def known_relations(triples: DataFrame, opened: DataFrame, known: DataFrame) -> DataFrame:
    """``triples`` with ``is_known``: whether the relation already is in either schema."""
    labels = opened.select("label").unionAll(known.select("label")).distinct().select(F.col("label").alias("rel"), F.lit(True).alias("is_known"))
    return triples.join(labels, "rel", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def retrieved(definitions: DataFrame, opened: DataFrame, known: DataFrame, embedder: M.Embedder, k: int = 5) -> DataFrame:
    """``(definition, candidates)``: labels of the ``k`` nearest open relations, then of the ``k`` nearest of the KG.

    Each distinct definition is embedded once.
    """
    q = cut(spread(dense_numbers(definitions.select("definition").distinct(), "definition", "id")).select("id", "definition", M.embed(embedder, F.col("definition"), X.STS_PREFIX).alias("embedding")))
    found = retrieved_for(q.select("id", "embedding"), opened, known, embedder, k)
    return q.select("id", "definition").join(found, "id").select("definition", "candidates")


def retrieved_for(queries: DataFrame, opened: DataFrame, known: DataFrame, embedder: M.Embedder, k: int = 5) -> DataFrame:
    """``(id, candidates)`` as ``retrieved`` for all ``queries`` (id, embedding)."""
    parts = []
    for kind, schema in enumerate((opened, known)):
        s = cut(spread(dense_numbers(schema.select("label", "definition").distinct(), "label", "id")).select("id", "label", M.embed(embedder, F.col("definition")).alias("embedding")))
        hits = V.top_k(queries, s.select("id", "embedding"), k)
        parts.append(hits.join(s.select(F.col("id").alias("cand_id"), "label"), "cand_id").select("query_id", F.lit(kind).alias("kind"), "rank", "label"))
    found = parts[0].unionAll(parts[1]).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "rank", "label"))), lambda x: x.label).alias("candidates"))
    return queries.select("id").join(found, F.col("id") == F.col("query_id"), "left").select("id", F.array_distinct(F.coalesce("candidates", F.array().cast("array<string>"))).alias("candidates"))


def _with_hints(rows: DataFrame, hints: DataFrame | None) -> DataFrame:
    """``rows`` with their document's ``hints``, an empty list where there are none."""
    none = F.array().cast("array<string>")
    return rows.withColumn("hints", none) if hints is None else rows.join(hints.select("doc_id", "hints"), "doc_id", "left").withColumn("hints", F.coalesce("hints", none))


def _verified(verifier: M.Completer, candidates: Column, asked: Column) -> Column:
    """The candidate that the verifier names for a row's text, triple and definition, where it is ``asked``."""
    triple = X.list_text(F.array("subj", "rel", "obj"))
    prompt = X.fill(VERIFY, text=F.col("text"), triple=triple, definition=F.col("definition"), choices=X.lettered_choices(candidates, 190))
    answer = M.complete(verifier, F.when(asked, prompt), 5)
    return F.try_element_at(candidates, X.chosen_letter(answer, F.size(candidates)) + 1)


def canonicalize(
    docs: DataFrame, triples: DataFrame, definitions: DataFrame, opened: DataFrame, known: DataFrame, embedder: M.Embedder, verifier: M.Completer,
    hints: DataFrame | None = None, enrich: bool = True, k: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Canonical triples ``(doc_id, pos, subj, rel, obj, open_rel, candidates)`` and the enriched open schema.

    All unknown relations of a call are verified together against the schema as it stood before; those that no candidate matches enter
    the schema at their first occurrence by document and position, which also gives their definition. A relation without a definition is dropped
    unless it is known. ``canonicalize_strict`` makes each addition visible to the very next triple instead.
    """
    marked = cut(known_relations(triples, opened, known))
    kept = marked.where("is_known").select("doc_id", "pos", "subj", "rel", "obj", F.col("rel").alias("open_rel"), F.array().cast("array<string>").alias("candidates"))
    rows = marked.where("NOT is_known").join(definitions, ["doc_id", "rel"])
    cands = retrieved(rows, opened, known, embedder, k)
    rows = _with_hints(rows.join(cands, "definition").join(docs.select("doc_id", "text"), "doc_id"), hints)
    rows = rows.withColumn("candidates", X.hints_in_front(F.col("hints"), F.col("candidates"))).drop("hints")
    judged = cut(rows.withColumn("chosen", _verified(verifier, F.col("candidates"), F.size("candidates") > 0)).drop("text"))
    new = judged.where("chosen IS NULL").groupBy(F.col("rel").alias("label")).agg(F.min_by("definition", F.struct("doc_id", "pos")).alias("definition"), F.min(F.struct("doc_id", "pos")).alias("at"))
    out = kept.unionAll(judged.select("doc_id", "pos", "subj", F.coalesce("chosen", "rel").alias("rel"), "obj", F.col("rel").alias("open_rel"), "candidates"))
    if not enrich:
        return out, opened
    size = opened.count()
    added = dense_numbers(new, "at").select("label", "definition", (F.col("number") + size).alias("ord"))
    return out, cut(opened.select("label", "definition", "ord").unionAll(added))


def canonicalize_strict(
    docs: DataFrame, triples: DataFrame, definitions: DataFrame, opened: DataFrame, known: DataFrame, embedder: M.Embedder, verifier: M.Completer,
    hints: DataFrame | None = None, k: int = 5,
) -> tuple[DataFrame, DataFrame, int]:
    """``canonicalize`` as if triple followed triple, each seeing every relation added before it; and the number of rounds that took.

    A round asks the verifier about all open triples by the schema as it stands; triples whose open candidates no addition of an earlier one would change are settled
    (``ordered.settle``), the others are asked again only if their candidates did change. Rows and results are those of ``canonicalize``.
    """
    marked = cut(known_relations(triples, opened, known))
    kept = marked.where("is_known").select("doc_id", "pos", "subj", "rel", "obj", F.col("rel").alias("open_rel"), F.array().cast("array<string>").alias("candidates"))
    rows = marked.where("NOT is_known").join(definitions, ["doc_id", "rel"])
    fixed = retrieved(rows, opened.limit(0), known, embedder, k).withColumnRenamed("candidates", "fixed")
    rows = _with_hints(rows.join(fixed, "definition").join(docs.select("doc_id", "text"), "doc_id"), hints)
    vectors = cut(spread(rows.select("definition").distinct()).select("definition", M.embed(embedder, F.col("definition"), X.STS_PREFIX).alias("embedding"), M.embed(embedder, F.col("definition")).alias("own")))
    rows = rows.join(vectors, "definition").withColumn("floor", F.lit(float("-inf")))
    rows = cut(O.numbered_rows(rows, ["doc_id", "pos"]))
    size = opened.count()
    store = cut(O.numbered_rows(opened.select("label", "definition"), ["label"]).select((F.col("id") - size).alias("id"), "label", M.embed(embedder, F.col("definition")).alias("own")))
    options = lambda: X.hints_in_front(F.col("hints"), F.array_distinct(F.concat(F.transform("cands", lambda c: c.label), F.col("fixed"))))

    def judge(df: DataFrame) -> DataFrame:
        said = df.withColumn("said", _verified(verifier, options(), F.col("stale") & (F.size(options()) > 0)))
        return said.withColumns({"chosen": F.when(F.col("stale"), F.col("said")).otherwise(F.col("chosen")), "adds": F.when(F.col("stale"), F.col("said").isNull()).otherwise(F.col("adds"))})

    seen = rows.select("id", F.col("rel").alias("label"), "embedding", "own", "floor", "doc_id", "pos", "text", "subj", "rel", "obj", "definition", "fixed", "hints")
    decided, rounds = O.settle(seen, store, k, judge)
    full = cut(rows.drop("embedding", "own", "floor", "text").join(decided, "id"))
    out = kept.unionAll(full.select("doc_id", "pos", "subj", F.coalesce("chosen", "rel").alias("rel"), "obj", F.col("rel").alias("open_rel"), options().alias("candidates")))
    added = dense_numbers(full.where("adds").select(F.col("rel").alias("label"), "definition", "id"), "id").select("label", "definition", (F.col("number") + size).alias("ord"))
    return out, cut(opened.select("label", "definition", "ord").unionAll(added)), rounds


def crawl(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Sentences that introduce relations: in order, skip those with a relation already collected or a triple that isn't three parts; stop at ``limit`` relations.

    ``rows`` is (ord, rels array, well_formed), ord a unique number. A round picks the first row that is free of what was collected: ``limit`` rounds of a filter and a minimum.
    """
    spark = rows.sparkSession
    taken: list[str] = []
    picked = []
    while len(taken) < limit:
        free = rows.where(F.col("well_formed") & (F.size("rels") > 0))
        if taken:
            free = free.where(~F.arrays_overlap("rels", F.array(*map(F.lit, taken))))
        if picked:
            free = free.where(F.col("ord") > picked[-1])
        first = free.agg(F.min(F.struct("ord", "rels")).alias("x")).first().x
        if first is None:
            break
        picked.append(first.ord)
        taken += list(dict.fromkeys(first.rels))
    return rows.join(F.broadcast(spark.createDataFrame([(o,) for o in picked], "ord long")), "ord", "left_semi")  # at most ``limit`` rows


def relation_examples(triples: DataFrame, docs: DataFrame, external: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``(rel, text, subj, obj)``: one pseudo-random example of each relation that external examples don't cover."""
    rows = triples if external is None else triples.join(external.select("rel").distinct(), "rel", "left_anti")
    one = sampling.one_of_each(rows, "rel", "doc_id", "pos", seed=seed)
    return one.join(docs.select("doc_id", "text"), "doc_id").select("rel", "text", "subj", "obj")


def relation_hint(relations: Column, definitions: Column, examples: Column) -> Column:
    """Numbered hint lines of relations that have a definition; numbers count skipped relations too."""
    line = lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r, F.lit(": "), definitions[r], F.coalesce(F.concat(F.lit(" Example: "), examples[r]), F.lit("")))
    return F.array_join(F.filter(F.transform(relations, line), lambda x: x.isNotNull()), "\n")


def refinement_hints(docs: DataFrame, previous: DataFrame, retrieved_: DataFrame) -> DataFrame:
    """``(doc_id, entities, relations)``: what the last round extracted, then what was retrieved, without repeats.

    ``previous`` is triples, ``retrieved_`` (doc_id, relations array).
    """
    last = previous.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "subj", "rel", "obj"))).alias("t"))
    out = docs.select("doc_id").join(last, "doc_id", "left").join(retrieved_, "doc_id", "left")
    t = F.coalesce("t", F.array().cast(last.schema["t"].dataType))
    ends = F.array_distinct(F.flatten(F.transform(t, lambda x: F.array(x.subj, x.obj))))
    rels = X.union_ordered(F.transform(t, lambda x: x.rel), F.coalesce("relations", F.array().cast("array<string>")))
    return out.select("doc_id", ends.alias("entities"), rels.alias("relations"))
