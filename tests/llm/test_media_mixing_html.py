import collections
import hashlib
import math
import random
import tarfile
import time
import zlib

import pytest

from kgspark.llm import htmltext as H
from kgspark.llm import media as M
from kgspark.llm import mixing as X


def test_png_round_trip():
    for text in (None, "", "a", "é" * 33, "x" * 100_000):
        p = M.payload(text)
        png = M.to_png(p)
        assert M.from_png(png) == p and M.png_header(png[:33]) == (64, len(p) // 64, 8, 0)
    with pytest.raises(ValueError):
        M.from_png(png[:-20] + b"\0" * 20)
    with pytest.raises(ValueError):
        M.png_header(b"\x89PNG" + png[4:20])


def test_media_rows(odd, empty, tmp_path):
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    got = M.media_columns(odd).collect()
    assert len(got) == odd.count() and M.media_columns(empty).count() == 0
    for r in got:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.width, r.height, r.bit_depth) == (64, len(p) // 64, 8)
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1


def test_shards_are_tar_files_with_each_payload_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "doc_id long, text string").coalesce(1)
    catalog = M.store(docs, base=f"file://{tmp_path}/m").collect()
    shard = {r.shard for r in catalog}
    assert len(shard) == 1
    with tarfile.open(shard.pop().removeprefix("file://")) as tar:
        members = {m.name: m for m in tar.getmembers()}
        assert len(members) == 3
        for r in catalog:
            m = members[f"{r.digest}.png"]
            assert (m.offset_data, m.size) == (r.offset, r.length)


def brute_feature(p):
    lines = [p[i : i + 64] for i in range(0, len(p), 64)]
    mean = sum(p) / len(p)
    std = math.sqrt(sum((x - mean) ** 2 for x in p) / len(p))
    entropy = -sum(n / len(p) * math.log2(n / len(p)) for n in collections.Counter(p).values())
    fields = [[[] for _ in range(8)] for _ in range(8)]
    for i, line in enumerate(lines):
        for k in range(8):
            fields[i * 8 // len(lines)][k].append(sum(line[8 * k : 8 * k + 8]))
    means = [sum(f) / max(1, len(f)) for row in fields for f in row]
    middle = sum(means) / 64
    return mean, std, entropy, sum(1 << (63 - i) for i, v in enumerate(means) if v > middle + 1e-9), sum(1 << (63 - i) for i, v in enumerate(means) if v > middle - 1e-9)


def test_features_and_headers_like_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = M.media_columns(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        p = M.payload(texts[r.doc_id])
        mean, std, entropy, least, most = brute_feature(p)
        f = dict(x.split("=") for x in r.feature.split(";"))
        assert all(math.isclose(float(f[k]), v, abs_tol=6e-5) for k, v in (("mean", mean), ("std", std), ("entropy", entropy)))
        assert int(f["ahash"], 16) in (least, most) or int(f["ahash"], 16) & ~most == 0 == least & ~int(f["ahash"], 16)
        assert (r.width, r.height, r.bit_depth, r.colour_type, r.payload_bytes) == (64, len(p) // 64, 8, 0, len(p))


@pytest.mark.parametrize("hot", [1024, 3])
def test_payloads_are_stored_once_in_all(spark, tmp_path, monkeypatch, hot):
    """Over many tasks, also where texts differ in zeros at their end alone, and where a payload is a third of the rows."""
    monkeypatch.setattr(M, "HOT_ROWS", hot)
    texts = ["hot"] * 60 + [f"text {i % 20}" for i in range(60)] + [f"own {i}" for i in range(50)] + ["a", "a\0", "", None, "\0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    catalog = M.store(docs, base=f"file://{tmp_path}/m").collect()
    assert sorted(r.id for r in catalog) == list(range(len(texts)))
    want = {i: (hashlib.sha256(M.to_png(M.payload(t))).hexdigest(), len((t or "").encode())) for i, t in enumerate(texts)}
    assert {r.id: (r.digest, r.n_bytes) for r in catalog} == want
    assert len({(r.digest, r.shard, r.offset, r.length) for r in catalog}) == len({d for d, _ in want.values()})
    names = []
    for path in (tmp_path / "m").glob("*.tar"):
        with tarfile.open(path) as tar:
            names += tar.getnames()
    assert sorted(names) == sorted(f"{d}.png" for d in {d for d, _ in want.values()})
    assert {r.id: r.payload for r in M.read_back(M.store(docs), payloads=True).collect()} == {i: M.payload(t) for i, t in enumerate(texts)}


def brute_targets(sizes, shares=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: shares[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped and sizes[s]]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | share | {s: 0.0 for s in order if not sizes[s]}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets():
    sizes = {"a": 10, "b": 1000, "c": 5, None: 400, "z": 0}
    want = brute_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    got = X.targets([((1, 2, 3)[i % 3], sizes[s]) for i, s in enumerate(order)])
    assert all(math.isclose(g, want[s], abs_tol=1e-9) for g, s in zip(got, order))
    assert math.isclose(sum(got), sum(sizes.values()))


@pytest.mark.parametrize("bin_rows", [20_000, 3])
def test_mix_like_sorting_everything(spark, sf, monkeypatch, bin_rows):
    monkeypatch.setattr(X, "BIN_ROWS", bin_rows)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.keyed(docs, labels).collect()
    got = {r.doc_id: r for r in X.mix(docs, labels).collect()}
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    for source, target in brute_targets(sizes).items():
        own = sorted((r for r in rows if r.source == source), key=lambda r: (r.key, r.tie))
        epochs = int(target // sizes[source])
        left = most = target - epochs * sizes[source]
        done, taken = False, set()
        for r in own:
            if left >= 1 and r["size"] <= left and not done:
                left -= r["size"]
                taken.add(r.doc_id)
            elif r["size"] <= most:  # it would have fitted when the round began
                most = left
                done = left <= X.OPEN * target
        if left >= 1 and left > X.OPEN * target:
            rest = [r for r in own if r.doc_id not in taken and 0 < r["size"] < 2 * left]
            taken |= {r.doc_id for r in sorted(rest, key=lambda r: (abs(r["size"] - left), r.key, r.tie))[:1]}
        for r in own:
            assert got[r.doc_id].taken == r["size"] * (epochs + (r.doc_id in taken))
        assert math.isclose(got[own[0].doc_id].target, target)
    assert all(r.taken <= 3 * r["size"] for r in got.values())


def test_weights_order_the_sample(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(2000)] + [(i, "w " * 10, "t") for i in range(2000, 6000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(6000)], "doc_id long, quality int")
    taken = [r.doc_id for r in X.mix(docs, labels).where("source_size = 40000 AND taken > 0").collect()] + [r.doc_id for r in X.mix(docs, labels).where("source_size = 20000 AND taken > 0").collect()]
    few = X.mix(docs, labels).groupBy("source_size").agg({"taken": "sum"}).collect()
    assert all(r[1] > 0 for r in few)
    part = X.mix(docs, labels).where("source_size = 20000").toPandas()
    assert abs(part.taken.sum() - part.target[0]) <= 10 and taken
    good = part[part.doc_id % 2 == 0].taken.sum()
    assert good >= part[part.doc_id % 2 == 1].taken.sum()


def test_mix_rows(odd, empty, labels):
    got = X.mix(odd, labels).collect()
    assert len(got) == odd.count() and X.mix(empty, labels).count() == 0
    assert all(r["size"] == 0 for r in got if r.doc_id in (1, 2, 3))
    again = X.mix(odd, labels).collect()
    key = lambda rs: sorted((str(r.doc_id), r["size"], r.taken) for r in rs)
    assert key(got) == key(again)
    out = X.resample(odd, labels)
    assert out.schema.simpleString() == odd.schema.simpleString()
    assert out.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')) AS n").first().n == sum(r.taken for r in got)
    assert X.resample(empty, labels).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="x"><header>H</header><nav><ul><li><a href="/">N</a></ul></nav>
<main><h1>Title</h1><p>One <b>two</b>&nbsp;three &lt;x&gt;<div class="ad-box">AD</div><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>
<aside>S</aside><section id="comments"><p>C</p></section><form><p>F</p></form><script>if(a<b)"</p>"</script><p hidden>no</p><!-- <p>no</p> --></main><footer>F</footer>"""


def test_text_of_a_page():
    assert H.text_of(H.parse(PAGE)) == "Title\nOne two three <x>\na\nb\n1\n2\n3"


def test_broken_markup():
    assert H.text_of(H.parse("<div>x<p>y</div>z<br>w</i>")) == "x\ny\nz w"
    assert H.text_of(H.parse("a < b & c <!-- open")) == "a < b & c"
    assert H.text_of(H.parse("<div>" * 20_000 + "deep")) == "deep"


def test_names_of_prose_and_parts_of_names_delete_nothing():
    page = '<article><p class="notice-board">A</p><div id="related-work">B</div><p class="comment">C</p><div class="ad">D</div><div class="comments">E</div>one<br>two</article>'
    assert H.text_of(H.parse(page)) == "A\nB\nC\none two"


@pytest.mark.parametrize("page", [
    "<a " * 300_000, '<a "' * 300_001, "<div>" * 100_000 + "</i>" * 100_000, "<i><article>" + "<div>" * 50_000 + "</i>" * 50_000, "<b>" * 50_000 + "<hr>" * 50_000,
    "<ul><li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<div>" * 50_000 + "<td></td>" * 50_000, "<!--" * 100_000, "<script>" * 100_000, "</" * 300_000, "<p class=" * 100_000,
])
def test_hostile_pages_take_seconds(page):
    began = time.time()
    root = H.parse(page)
    H.subtrees(root), H.boxes(root), H.text_of(root)
    assert time.time() - began < 15


def test_templates_like_brute_force(spark):
    """Boxes inside and outside of articles, some on many pages of their host: the texts are those left by counting rendered boxes."""
    draw = random.Random(8)
    shared = [f"<div class='b{k}'>Box {k} <a href='/{k}'>more</a></div>" for k in range(12)]
    rows, expected = [], {}
    for i in range(120):
        host = f"h{i % 3}.example.org"
        inner, outer = draw.sample(range(12), 2), draw.sample(range(12), 2)
        rows.append((i, f"https://{host}/{i}", f"<body>{''.join(shared[k] for k in outer)}<article><p>own {i}</p>{''.join(shared[k] for k in inner)}</article></body>"))
        expected[i] = (host, inner)
    seen = collections.Counter((h, k) for h, inner in expected.values() for k in inner)
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "\n".join([f"own {i}"] + [f"Box {k} more" for k in inner if seen[h, k] < 0.2 * 40]) for i, (h, inner) in expected.items()}
    assert got == want and any("Box" in t for t in got.values()) and sum("Box" in t for t in got.values()) < 120


def test_articles_without_reader_comments():
    page = '<article><header><h1>A</h1><p>by somebody</p></header><p>text</p><article class="comment"><p>me too</p></article></article><article class="teaser related"><p>other</p></article>'
    assert H.text_of(H.parse(page)) == "A\ntext"


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_site_templates_go(spark, monkeypatch, sent):
    monkeypatch.setattr(H, "SENT", sent)  # both ways of deleting
    frame = lambda i, host: (i, f"https://{host}/p/{i}", f"<body><div><p>Welcome to the site</p></div><div><p>Story number {i}</p><p>shared line {i % 2}</p></div><div>All rights</div></body>")
    rows = [frame(i, "big.example.org") for i in range(20)] + [frame(100 + i, "small.example.org") for i in range(3)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3"  # half of the pages share the other line: a template too
    assert got[101] == "Welcome to the site\nStory number 101\nshared line 1\nAll rights"


def test_shared_passages_of_articles_stay(spark):
    rows = [(i, f"https://h.example.org/{i}", f"<body><nav>menu</nav><article><p>shared passage</p><p>own {i}</p></article></body>") for i in range(12)]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"shared passage\nown {r.page_id}" and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_site_templates_inside_articles_go(spark, monkeypatch, sent):
    monkeypatch.setattr(H, "SENT", sent)
    box = '<div class="zz"><p>Tell your friends</p><ul><li>one</li><li>two</li></ul></div>'
    page = lambda i, inner, host="h.example.org": (i, f"https://{host}/{i}", f"<body><article><h2>Facts</h2>{inner}</article></body>")
    rows = [page(i, f'<div>own {i} by <a href="/a">me</a></div><ul><li>salt</li><li>item {i}</li></ul>{box}<a href="/all">All stories</a>') for i in range(12)]
    rows += [page(100 + i, "<div>one article</div><div>under many urls</div>", "same.example.org") for i in range(12)]
    rows += [page(1000 + i, f"<p>own {i}</p>" + "<section>In this series</section>" * (i < 55), "hot.example.org") for i in range(300)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Facts\nown 3 by me\nsalt\nitem 3"
    assert got[103] == "Facts\none article\nunder many urls"
    assert got[1003] == "Facts\nown 3" and got[1200] == "Facts\nown 200"


def test_page_rows(spark):
    rows = [(1, "https://a/b", "<p>x</p>", 1)] * 2 + [(2, None, None, 1), (3, "no url", "", 1), (None, "https://a/c", "<article>é</article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.main_text(df).collect()), key=str)
    assert got == sorted([(1, "x", 1), (1, "x", 1), (2, "", 0), (3, "", 0), (None, "é", 1)], key=str)
    assert H.main_text(df.where("false")).count() == 0


def test_pages_like_another_route(spark, sf):
    import html
    import re

    def other(page):
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"<(?:/?p|/?h1|br)>", "\x01", body)).split("\x01")
        return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: other(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in H.main_text(pages).collect()} == want


def test_words_inside_attribute_values_delete_nothing():
    """Only attributes that an element has count, by their own names."""
    from kgspark.llm import htmltext as H

    kept = [
        '<p style="overflow:hidden">x</p>', '<p title="nothing hidden here">x</p>', '<p data-hidden="false">x</p>', '<div data-role="form">x</div>', "<div title='class=ad'>x</div>",
        '<div data-class="ad">x</div>', "<div title=class=ad>x</div>", '<div title="a" class = "add"/ >x</div>', '<p title=hidden>x</p>', '<p aria-hidden="false">x</p>', '<div title="role=navigation" id=y>x</div>',
    ]
    gone = ['<p hidden>x</p>', '<p title="a" aria-hidden=true>x</p>', '<div class="a ad b">x</div>', "<div id='comments'>x</div>", "<div CLASS=Ad>x</div>", '<div\nrole="navigation">x</div>', '<p class="advert">x</p>', '<div title="a>b"class="ad">x</div>', "<section class=notice/x class=ad id=notice>x</section>"]
    for box in kept:
        assert H.text_of(H.parse(f"<article><p>a</p>{box}</article>")) == "a\nx", box
    for box in gone:
        assert H.text_of(H.parse(f"<article><p>a</p>{box}</article>")) == "a", box
