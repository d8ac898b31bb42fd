"""Hand-written cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from kgspark.functions import models as M
from kgspark.functions import parsers as P
from kgspark.functions import text as X
from kgspark.names import NEW_ENTITY
from kgspark.operators import canonical as C
from kgspark.operators import evaluation as E
from kgspark.operators import graph, linking, metrics, spans
from kgspark.operators import ordered as O
from kgspark.operators import vectors as V
from kgspark.plans import graphs as G
from kgspark.sources import readers as R
from kgspark.sources import sinks


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema or "x int").select(column.alias("out")).first().out


def test_triples_literal():
    assert P.triples_of("[['a','r',['b','c']]]") == [["a", "r", "b, c"]]
    assert P.triples_of("[['a','r','_']]") == []
    assert P.triples_of("]['a','r','b']") == [["a", "r", "b"]]
    assert P.triples_of(None) == [] and P.triples_of("") == []


def test_entities_literal():
    assert P.entities_of("x ['a','b'] ['c']") == ["a", "b"]
    assert P.entities_of("no list") == [] and P.entities_of("] [") == []


def test_definitions(spark):
    got = one(spark, P.parse_definitions(F.col("t")), t=("string", "- p: x: y\nAnswer: z\nno colon\nq: 1\nq: 2"))
    assert got == {"p": "x: y", "q": "2"}


def test_mentions(spark):
    got = one(spark, P.parse_mentions(F.col("t"), F.array(F.lit("a"), F.lit("b"))), t=("string", '[{"entity":"a"}, 3]'))
    assert [tuple(x) for x in got] == [("a", "", "", False), ("b", "", "", True)]
    assert [x.stub for x in one(spark, P.parse_mentions(F.col("t"), F.array(F.lit("a"))), t=("string", "broken ["))] == [True]


def test_generated_and_first_definition(spark):
    text = '[{"e":" a ","d":"1"},{"e":"a","d":"2"},{"e":"b"}]'
    assert [tuple(x) for x in one(spark, P.parse_generated(F.col("t"), ["e", "d"]), t=("string", text))] == [("a", "1")]
    samples = ["no json", '{"definition": 3}', 'so {"definition":"good"}', '{"definition":"late"}']
    assert one(spark, P.first_definition(F.col("s")), s=("array<string>", samples)) == "good"


def test_answers(spark):
    ten = F.lit(10)
    assert one(spark, X.chosen_number(F.col("t"), ten), t=("string", "11")) is None
    assert one(spark, X.chosen_number(F.col("t"), ten, compat=True), t=("string", "11")) == 0
    assert one(spark, X.chosen_letter(F.col("t"), ten), t=("string", "")) is None
    ids = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, P.answered_id(F.col("t"), ids), t=("string", '{"ID": 1}')) == "y"
    assert one(spark, P.answered_id(F.col("t"), ids), t=("string", "?")) is None


def test_choices_run_out_of_letters(spark):
    with pytest.raises(Exception, match="more choices than letters"):
        one(spark, X.lettered_choices(F.col("o")), o=("array<string>", [str(i) for i in range(26)]))


def test_text_functions(spark):
    assert tuple(one(spark, X.split_tag(F.col("t")), t=("string", "foo@bar@de"))) == ("foo@bar", "de")
    d = X.full_description(F.lit("L"), F.lit("D"), F.array(*map(F.lit, ["x", "", "y", "z", "w"])))
    assert one(spark, d, t=("string", "")) == "L (x, y, z): D"
    assert one(spark, X.fill("{a} {b} {a}", a=F.lit("{b}"), b=F.lit(None)), t=("string", "")) == "{b} None {b}"
    assert one(spark, X.webnlg(F.col("t"), last=True), t=("string", "FooBar_baz (city)")) == "foo bar baz"
    assert one(spark, X.list_text(F.array(F.lit("it's"), F.lit("b"))), t=("string", "")) == '["it\'s", \'b\']'


def test_alignment_is_not_one_to_one(spark):
    pairs = spark.createDataFrame([("g1", "s1", 3), ("g1", "s2", 2), ("g2", "s2", 1)], "gold_blank string, system_blank string, n long")
    assert {tuple(r) for r in E.align(pairs, False).collect()} == {("s1", "g1"), ("s2", "g1")}
    assert {tuple(r) for r in E.align(pairs, False, strict_one_to_one=True).collect()} == {("s1", "g1")}


def test_two_blanks_in_gold_raise(spark):
    gold = spark.createDataFrame([(1, "_:a", "p", "_:b")], "doc_id long, s string, p string, o string")
    with pytest.raises(Exception, match="two blank nodes"):
        E.evaluate(gold, gold, False).collect()


def test_prf_of_nothing(spark):
    r = E.prf(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first()
    assert (r.precision, r.recall, r.f1) == (0, 0, 0)


def test_golden_figures(spark):
    sf = "/root/testdata/sf0.01"
    for local, want in ((False, (101138, 12893, 32608)), (True, (106805, 5962, 26941))):
        row = E.evaluate(G.gold(spark, sf), G.system(spark, sf), local).where("label = 'triple'").first()
        assert (row.tp, row.fp, row.fn) == want


def test_undirected_edge_keeps_the_last(spark):
    me = spark.createDataFrame([], "mention string, entity string, score double")
    mm = spark.createDataFrame([("1", "2", 0.9, 1), ("2", "1", 0.7, 2)], "m1 string, m2 string, score double, ord long")
    assert [tuple(r) for r in linking.alignment_edges(me, mm).collect()] == [("m:1", "m:2", 0.7)]


def test_paths_and_clusters(spark):
    edges = spark.createDataFrame([("m:1", "e:1", 0.9), ("m:1", "m:2", 0.8), ("m:2", "m:3", 0.9), ("m:3", "e:2", 0.95)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(f"m:{i}",) for i in range(1, 5)] + [("e:1",), ("e:2",)], "node string")
    got = {r.node: r.entity for r in linking.clusters(edges, nodes, 0.75).collect()}
    assert got == {"m:1": "e:1", "m:2": "e:2", "m:3": "e:2", "m:4": None}
    ids = {r.node: r.identifier for r in linking.identifiers(linking.clusters(edges, nodes, 0.75)).collect()}
    assert ids["m:1"] == "1" and ids["m:4"] == NEW_ENTITY + "0"


def test_components_of_paths_cycles_and_hubs(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)] + [(200, x) for x in range(201, 260)] + [(7, 7), (None, 1)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 103)) and all(got[i] == 200 for i in range(200, 260))
    assert len(got) == 61 + 3 + 60
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_descendants_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert sorted(r.node for r in E.descendants(edges, spark.createDataFrame([("a",)], "node string")).collect()) == ["a", "b", "c"]


def test_self_fills_up_few_candidates(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    got = {(r.query_id, r.cand_id): r.score for r in V.top_k(v, v, 10, self_score=-1.0).collect()}
    assert got == {(1, 2): 0.0, (1, 1): -1.0, (2, 1): 0.0, (2, 2): -1.0}


def test_assignment_is_the_best_permutation():
    for n in (1, 3, 5):
        table = [[((i * 7 + j * 13) % 11) / 10 for j in range(n)] for i in range(n)]
        best = max(sum(table[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(sum(table[i][j] for i, j in enumerate(spans.assignment(table))) - best) < 1e-9
    big = [[((i * 7 + j * 13) % 17) / 10 for j in range(14)] for i in range(14)]
    assert sorted(spans.assignment(big)) == list(range(14))
    small = [row[:12] for row in big[:12]]
    padded = [row + [0.0, 0.0] for row in small] + [[0.0] * 14] * 2
    value = lambda t, p: sum(t[i][j] for i, j in enumerate(p))
    assert abs(value(small, spans.assignment(small)) - value(padded, spans.assignment(padded))) < 1e-9


def test_span_scores():
    perfect = spans.score_entry([("a b", "likes", "c")], [("a b", "likes", "c")])[0]
    assert all(perfect[k, "all"] == [3, 0, 0, 0, 0] for k in spans.SCHEMES)
    half = spans.score_entry([("new york city", "in", "usa")], [("york", "in", "usa")])[0]
    assert half["partial", "SUB"][2] == 1 and half["strict", "SUB"][1] == 1
    swapped = spans.score_entry([("a", "p", "b")], [("b", "p", "a")])[0]
    assert swapped["exact", "all"][0] == 3 and swapped["strict", "all"][0] == 1
    missing = spans.score_entry([("a", "p", "b"), ("c", "q", "d")], [("c", "q", "d")])
    assert sum(s["strict", "all"][3] for s in missing) == 3


def test_metrics(spark):
    rows = spark.createDataFrame([("q", 1, 0.9, 0), ("q", 2, 0.8, 1), ("q", 3, 0.1, 1)], "query string, item long, score double, relevant int")
    r = metrics.ranking(rows).first()
    assert abs(r.map - (1 / 2 + 2 / 3) / 2) < 1e-12 and r.mrr == 0.5
    d = metrics.detection(rows).first()
    assert (d.tp, d.fp, d.fn) == (1, 1, 0)


def test_nil_store_is_seen_by_later_documents_only(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 0, [1.0, 0.0])], "doc_id long, ent_pos int, embedding array<float>")
    got = [r.identifier[-1] for r in O.nil_fold(rows, 0.5).orderBy("doc_id", "ent_pos").collect()]
    assert got == ["0", "1", "0"]


def test_ordered_fold(spark):
    rows = spark.createDataFrame([(1, 0, "r1", [1.0, 0.0]), (1, 1, "r2", [0.99, 0.1]), (2, 0, "r3", [0.0, 1.0])], "doc_id long, pos long, rel string, embedding array<float>")
    opened = spark.createDataFrame([], "label string, embedding array<float>")
    assert [r.canonical for r in O.canonicalize_ordered(rows, opened, 0.9).orderBy("doc_id", "pos").collect()] == ["r1", "r1", "r3"]


def test_crawl_skips_collected_relations(spark):
    rows = spark.createDataFrame([(1, ["a"], True), (2, ["a", "b"], True), (3, ["c"], False), (4, ["b"], True)], "ord long, rels array<string>, well_formed boolean")
    assert sorted(r.ord for r in C.crawl(rows).collect()) == [1, 4]


def test_last_token_pool():
    import numpy as np

    states = np.arange(12.0).reshape(2, 3, 2)
    assert M.last_token_pool(states, np.array([[0, 1, 1], [1, 1, 1]])).tolist() == states[:, 2].tolist()
    assert M.last_token_pool(states, np.array([[1, 1, 0], [1, 0, 0]])).tolist() == [states[0, 1].tolist(), states[1, 0].tolist()]


def test_bounded_retry():
    calls = []

    def call(prompts, max_tokens, n):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [["x"]] * len(prompts)

    assert M.Retrying(call, attempts=3, wait=0).complete(["a"]) == [["x"]]
    with pytest.raises(OSError):
        M.Retrying(lambda *a: (_ for _ in ()).throw(OSError()), attempts=2, wait=0).complete(["a"])


def test_sources_and_sinks(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "d.jsonl").write_text('{"text":"t1","triplets":[["a","p","b"]]}\n{"text":"t2","linked_triplets":[["c","q","d"]]}\n')
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        json.dump([{"text": "t1", "triplets": [["a", "p", "b"]]}], f)
    assert [(r.doc_id, r.text, r.triples) for r in R.dataset(spark, f"{tmp_path}/d.jsonl").orderBy("doc_id").collect()] == [(0, "t1", [["a", "p", "b"]]), (1, "t2", [["c", "q", "d"]])]
    assert R.dataset(spark, f"{tmp_path}/d.json.gz").count() == 1
    with pytest.raises(ValueError):
        R.dataset(spark, "x.csv")
    (tmp_path / "s.csv").write_text('u1,l1,"a, b"\nu2,l1,c\n')
    schema = R.relation_schema(spark, f"{tmp_path}/s.csv")
    assert R.last_by_label(schema).first().uri == "u2"
    (tmp_path / "k.nt").write_text('<http://a> <http://b> "x y"@en .\n# comment\n\n<http://a> <http://b> <http://c> .\n')
    assert sorted(r.o for r in R.nt(spark, f"{tmp_path}/k.nt").collect()) == ['"x y"@en', "<http://c>"]
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert [(r.doc_id, r.text) for r in R.text_lines(spark, f"{tmp_path}/t.txt").orderBy("doc_id").collect()] == [(0, "one"), (1, "two")]
    (tmp_path / "e.json").write_text('{"r":[{"text":"t","triplet":["a","r","b"]}]}')
    assert R.relation_examples(spark, f"{tmp_path}/e.json").first().rel == "r"
    (tmp_path / "x.xml").write_text('<b><entries><entry eid="1"><modifiedtripleset><mtriple>a | p | b</mtriple><mtriple>c | p | d</mtriple></modifiedtripleset></entry></entries></b>')
    assert R.entries_xml(spark, f"{tmp_path}/x.xml").first().triples == ["a | p | b", "c | p | d"]
    sinks.relation_csv(schema, f"{tmp_path}/out")
    assert R.relation_schema(spark, f"{tmp_path}/out").count() == 2
    with pytest.raises(Exception):
        sinks.relation_csv(schema, f"{tmp_path}/out")
    docs = spark.createDataFrame([(1, [("a", "r", "it's")])], "doc_id long, triples array<struct<subj:string,rel:string,obj:string>>")
    sinks.canonical_text(docs, f"{tmp_path}/canon")
    assert P.triples_of(spark.read.text(f"{tmp_path}/canon").first().value) == [["a", "r", "it's"]]


def test_stage_results_come_back(spark, tmp_path):
    from kgspark.plans import pipeline as K

    docs = spark.createDataFrame([(0, "Alan Bean was born in Wheeler Texas"), (1, "")], "doc_id long, text string")
    known = spark.createDataFrame([("http://kg/p", "was", "states a thing")], "uri string, label string, definition string")
    triples, opened = K.extract_kg(docs, known, K.Config(), 1, output=f"{tmp_path}/run")
    stages, schema, n = R.latest_stage(spark, f"{tmp_path}/run")
    assert n == 1 and stages.count() == 2 and schema.count() == opened.count() and triples.count() > 0
    linked = K.link_entities(docs, triples, opened, known, None, K.Config.documented())
    assert linked.count() == triples.count() and all(r.s.startswith(NEW_ENTITY) for r in linked.collect())
    gold = linked.select("doc_id", "s", "p", "o")
    best = K.tune(docs, triples, spark.createDataFrame([(r.rel, f"http://kg/{r.rel}", "d") for r in triples.select("rel").distinct().collect()], "label string, uri string, definition string"), None, gold, K.Config(), [(0.2, 0.9, 0.5)])
    assert best.count() == 1 and len(K.default_grid()) == 810 and len(K.default_grid(False)) == 81


def test_saved_index_finds_the_same(spark, tmp_path):
    import random

    draw = random.Random(2)
    v = spark.createDataFrame([(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(200)], "id long, embedding array<double>")
    index = V.CellIndex(v, cells=8)
    index.save(f"{tmp_path}/index")
    key = lambda df: sorted((r.query_id, r.rank, r.cand_id) for r in df.collect())
    queries = v.where("id < 20")
    again = V.CellIndex.load(spark, f"{tmp_path}/index")
    assert key(index.search(queries, 3, 2)) == key(again.search(queries, 3, 2))
    assert key(again.search(queries, 3, 8)) == key(V.top_k(queries, v, 3))


def test_training_examples_join_by_label(spark, tmp_path):
    row = {
        "text": "t", "entities": [{"qid": "q1"}, {"qid": "q2"}, {"qid": "unknown"}], "triples": [["a", "r", "b"]],
        "generated_entities": [{"entity": "L1", "surface_form": ["old"], "definition": "x", "type": "one"}, {"entity": "L1", "surface_form": "form", "definition": ["first", "second"], "types": ["t1", "t2"]}],
    }
    import json

    (tmp_path / "g.jsonl").write_text(json.dumps(row) + "\n")
    elements = spark.createDataFrame([("q1", "L1"), ("q2", "L2")], "identifier string, label string")
    got = R.training_examples(R.generated_mentions(spark, f"{tmp_path}/g.jsonl"), elements).orderBy("pos").collect()
    assert [(r.qid, r.mention, r.definition, r.types) for r in got] == [("q1", "form", "first", ["t1", "t2"]), ("q2", None, None, [])]


def test_clean_up_deletes_what_was_written(spark):
    from kgspark.session import clean_up, written

    df = written(spark.range(5), "test")
    assert df.count() == 5 and clean_up(spark) >= 1
    with pytest.raises(Exception):
        df.collect()


def test_sums_in_tasks_are_sums_of_entries(spark):
    rows = [(i, [["a b", "p", "c"], ["d", "q", str(i)]], [["d", "q", "5"], ["a", "p", "c x"]][: 1 + i % 2]) for i in range(9)] + [(9, None, [["a", "b", "c"]])]
    df = spark.createDataFrame(rows, "entry_id long, gold array<array<string>>, said array<array<string>>")
    key = lambda x: sorted((r.scheme, r.tag, r.correct, r.incorrect, r.partial, r.missed, r.spurious, round(r.precision, 9), round(r.recall, 9), round(r.f1, 9)) for r in x.collect())
    assert key(spans.system_scores_of(df)) == key(spans.system_scores(spans.entry_scores(df)))


@pytest.mark.parametrize("name", ["refine_loop", "extract_and_link"])
def test_model_stages_read_all_documents(spark, monkeypatch, name):
    from kgspark import catalogue
    from kgspark.plans import training

    class Seen(Exception):
        pass

    def seen(docs, *args, **kwargs):
        raise Seen(sorted(map(tuple, docs.collect()), key=str))

    monkeypatch.setattr(training.K, "extract_kg", seen)
    sf = "/root/testdata/sf0.001"
    with pytest.raises(Seen) as met:
        catalogue.queries()[name](spark, sf)
    assert met.value.args[0] == sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("local", [True, False])
def test_many_aligned_blanks_are_shuffled_to_the_same_scores(spark, monkeypatch, local):
    sf = "/root/testdata/sf0.001"
    rows = [sorted(map(tuple, E.evaluate(G.gold(spark, sf), G.system(spark, sf), local).collect()))]
    monkeypatch.setattr(E, "SENT", 0)
    assert rows == [sorted(map(tuple, E.evaluate(G.gold(spark, sf), G.system(spark, sf), local).collect()))]


def test_numbers_follow_files_and_lines(spark, tmp_path):
    for name, lines in (("a", 3), ("b", 4000), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(lines)))
    got = [r.text for r in R.text_lines(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(4000)] + ["c0"]
    assert sorted(r.doc_id for r in R.text_lines(spark, str(tmp_path)).collect()) == list(range(4004))


def test_strict_literals(spark):
    assert P.literal_triples("[['a', 'b', 'c'], ('d', 'e', 'f')]") == [["a", "b", "c"], ["d", "e", "f"]]
    assert P.literal_triples("[]") == []
    for broken in (None, "", "x", "[['a', 'b']]", "[['a', 'b', 3]]", "{'a': 1}", "[" * 5000):
        assert P.literal_triples(broken) is None


def test_new_entities_grow_beyond_one_matrix(spark):
    import numpy as np

    x = np.eye(200)
    rows = spark.createDataFrame([(i, 0, [float(v) for v in x[i % 200]]) for i in range(400)], "doc_id long, ent_pos int, embedding array<double>")
    got = [r.identifier for r in O.nil_fold(rows, 0.5).orderBy("doc_id").collect()]
    assert got == [f"{NEW_ENTITY}{i % 200}" for i in range(400)]
