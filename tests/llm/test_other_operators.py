"""HTML extraction, top-k search, WARC audits and the pipeline, with the odd cases of their contracts."""

import gzip
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundspark.llm import html_extract, queries, topk, warc
from tests.compare import database, same
from tests.llm.test_text_operators import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return html_extract.Model(html_extract.counted(html_extract.labelled_pages()))


PAGES = {
    "<article><h1>T&amp;a</h1><p>One <b>bold.<br><p>Two\n  lines&nbsp;here &lt;x&gt;</article><footer>no</footer>": "T&a\n\nOne bold.\n\nTwo lines here <x>",
    "<body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>Buy</div><main><p>Text of some length that is the article itself.</p><script>var a='<p>no</p>';</script><style>p{}</style></main></body>": "Text of some length that is the article itself.",
    "<article><p>Story with enough words to be one, and more.</p><form><label>Mail</label><input></form><div class=newsletter>Sign up</div></article><section class=comments><div class=comment><p>What a nice long comment with many words in it.</p></div></section>": "Story with enough words to be one, and more.",
    "<div class='cookie-banner'><p>We use cookies on this site for many reasons.</p></div><article><p>Kept.</p><p>&#x41;&#66; &copy;</p></article><aside class=sidebar>Else</aside>": "Kept.\n\nAB ©",
    "": "",
    "   ": "",
    None: "",
    "plain words": "plain words",
    "<article><p>cut off in a tag <b": "cut off in a tag",
    "<article><p>broken <!-- comment": "broken",
    "<article><p data-golden=1>marks</p><p data-gold=\"1\">that</p><p data-gold=2>aren't labels</p></article>": "marks\n\nthat\n\naren't labels",
    "<article><p class=it's>bare quote</p><p title=\"a > b\">and a sign</p><p title = 'x>y' id=a\"b>more</p></article>": "bare quote\n\nand a sign\n\nmore",
    "<article><p>Before.</p><script src=\"a.js\" />var hidden = 1;</script><p>After.</p></article>": "Before.\n\nAfter.",
    "<article><p>Before.</p><script src=\"a.js\" /><p>Between.</p><script>var x;</script><svg/><p>After.</p></article>": "Before.\n\nBetween.\n\nAfter.",
    "<article><p>one</p><scripted>two</scripted><p>three</article>": "one\n\ntwo\n\nthree",
}


@pytest.mark.parametrize("page", PAGES)
def test_extraction(model, page):
    assert html_extract.extract_text(page, model) == PAGES[page]


def test_extraction_of_labelled_pages(model):
    good = total = 0
    for page in html_extract.labelled_pages(80, 99):
        nodes = html_extract.order(html_extract.parse(page, True))
        for x, p in zip(nodes, model.marginals(nodes), strict=True):
            if x.chars:
                total += 1
                good += (max(range(3), key=lambda s: p[s]) == 1) == (x.gold == 1)
    assert good / total > 0.93


def test_marginals_against_enumeration(model):
    import itertools

    nodes = html_extract.order(html_extract.parse("<body><article><p>some words of text here</p></article><div class=ad>x</div></body>"))
    place = {id(x): i for i, x in enumerate(nodes)}
    weights = np.zeros((len(nodes), 3))
    for states in itertools.product(range(3), repeat=len(nodes)):
        w = math.prod(model.potential(x)[s] for x, s in zip(nodes, states, strict=True))
        w *= math.prod(model.edge(x)[states[place[id(x.parent)]]][s] for x, s in zip(nodes, states, strict=True) if x.parent)
        for i, s in enumerate(states):
            weights[i, s] += w
    assert np.allclose(model.marginals(nodes), weights / weights.sum(1, keepdims=True))


def test_training_on_a_table_of_labelled_pages(spark, model):
    pages = html_extract.labelled_pages()
    got = html_extract.train(spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(-1, None)], "id long, html string").repartition(5))
    assert got.node == model.node and got.edges == model.edges
    assert html_extract.extract_text("<p>x</p>", html_extract.train(spark.createDataFrame([], "html string"))) in ("x", "")


def test_extraction_of_very_long_pages(model):
    page = "<body><nav><a href=x>m</a></nav><article>" + "<p>word and more words of the text here &amp; there.</p>" * 20_000 + "</article><footer>f</footer>"
    assert html_extract.extract_text(page, model).split("\n\n") == ["word and more words of the text here & there."] * 20_000
    deep = "<article>" + "<div>" * 30_000 + "deep" + "</div>" * 30_000 + "</article>"
    assert html_extract.extract_text(deep, model) in ("deep", "")


def test_extraction_over_tables(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "t"), (None, None, None, None), (1, "u", "<article><p>x</p></article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.n_chars, r.text) for r in html_extract.digests(df).collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert html_extract.digests(df.limit(0)).count() == 0
    assert html_extract.extract(df).columns == ["page_id", "url", "text"]


def brute_top(rows, k=10):
    sound = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in sound.items():
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound.items() if i != q)
            out |= {(q, r + 1, i, -d) for r, (d, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("parts", [64, 8192])
def test_top_k(spark, monkeypatch, parts):
    monkeypatch.setattr(topk, "ROWS", parts)
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 8))
    rows = [(i, [float(x) for x in (centres[i % 5] + r.normal(size=8) * 0.2)]) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # many equal vectors
    rows += [(900, None), (None, rows[0][1]), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, block int")
    got = {(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.nearest_of_hundredths(df).collect()}
    assert got == brute_top(rows)
    assert topk.nearest_of_hundredths(df.limit(0)).count() == 0
    assert topk.nearest_of_hundredths(df.where("vec_id = 100")).count() == 0


def test_top_k_of_repeated_ids(spark):
    r = np.random.default_rng(4)
    rows = [(i % 150, [float(x) for x in r.normal(size=4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    same(topk.nearest_of_hundredths(df), con, queries.OP3_SQL)


def scored_pairs(queries_, data, k=10):
    calls, offer = [], topk.Best.offer
    topk.Best.offer = lambda self, a, b, s, *x: (calls.append(s.size), offer(self, a, b, s, *x))[1]
    try:
        got = topk.dual_search(queries_, np.full(len(queries_), -1), np.full(len(queries_), topk.NONE), data, np.arange(len(data)), k)
    finally:
        topk.Best.offer = offer
    return sum(calls), got


@pytest.mark.parametrize("clusters, spread, most", [(20, 60, 0.5), (400, 300, 0.5), (1, 4000, 1.01)])
def test_cover_trees_prune(clusters, spread, most):
    r = np.random.default_rng(0)
    data = (np.repeat(r.normal(size=(clusters, 8)) * 4000, 4000 // clusters, 0) + r.normal(size=(4000, 8)) * spread).astype(np.int64)
    pairs, (row, score, ids) = scored_pairs(data[::100], data)
    assert pairs < most * 40 * 4000
    exact = data[::100] @ data.T
    for q in range(40):
        assert sorted(zip(-score[row == q], ids[row == q], strict=True)) == sorted(zip(-exact[q], range(4000), strict=True))[:10]


def test_cover_tree_invariants():
    r = np.random.default_rng(5)
    points = np.concatenate([r.normal(size=(900, 3)) * 1000, r.normal(size=(900, 3)) * 10, np.ones((100, 3))]).round()
    t = topk.CoverTree(points, 4)
    assert sorted(t.order.tolist()) == list(range(len(points)))
    for i, kids in enumerate(t.kids):
        rows = points[t.order[t.first[i] : t.end[i]]]
        assert np.sqrt(((rows - t.centre[i]) ** 2).sum(1)).max() <= t.radius[i] + 1e-9 <= t.cover[i] + 1e-8
        if kids:
            assert any((t.centre[c] == t.centre[i]).all() for c in kids)  # nested
            assert sum(t.end[c] - t.first[c] for c in kids) == t.end[i] - t.first[i]
            assert all(t.radius[c] <= t.cover[i] / 2 and t.cover[c] <= t.cover[i] / 2 for c in kids)  # halved
            assert all(np.sqrt(((t.centre[c] - t.centre[d]) ** 2).sum()) > t.cover[i] / 2 for c in kids for d in kids if c < d)  # separated
    assert len(t.kids) > 100


def test_queries_with_sql(spark):
    con = database(SF)
    for name, sql in queries.ORACLE.items():
        same(queries.QUERIES[name](spark, SF), con, sql)


def record_rows(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return warc.records(df, F.floor(F.col("page_id") / 40), F.col("page_id"), F.col("url"), F.col("html"))


def test_audit_finds_damage(spark):
    r = random.Random(2)
    pages = [(i, f"http://h/{i}", words(r, r.randint(0, 30)) if i % 7 else None) for i in range(120)]
    hurt = [(i, u, (h or "") + "x" if i == 45 else h) for i, u, h in pages]
    same_ = {x.file: x for x in warc.audit(record_rows(spark, pages), record_rows(spark, pages)).collect()}
    assert all(x.intact and x.n_compared == 1 and not x.ranges for x in same_.values())
    got = {x.file: x for x in warc.audit(record_rows(spark, pages), record_rows(spark, hurt)).collect()}
    assert [got[f].intact for f in range(3)] == [True, False, True]
    assert got[1].n_corrupt == 35 and got[1].n_records == 40  # the longer record moves all that follow
    swapped = [(i, u, h[:-1] + "~" if i == 50 else h) for i, u, h in pages]
    one = {x.file: x for x in warc.audit(record_rows(spark, pages), record_rows(spark, swapped)).collect()}[1]
    assert one.n_corrupt == 1 and one.n_compared < 40
    assert {x.file: x.intact for x in warc.audit(record_rows(spark, pages), record_rows(spark, pages[:80])).collect()} == {0: True, 1: True, 2: False}
    assert warc.audit(record_rows(spark, []), record_rows(spark, [])).count() == 0


def test_audit_of_odd_pages(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (97, "v", "é" * 50_000)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "page_id long, url string, html string, digest string")
    got = {x.file: x for x in warc.audited(df).collect()}
    assert set(got) == {-1, 0} and not got[0].intact and got[-1].intact
    loose = spark.createDataFrame([(None, f"u{i}", "x" * i) for i in range(600)] + [(97, "v", None)], "page_id long, url string, html string")
    got = {x.file: x for x in warc.audited(loose).collect()}
    assert set(got) == {-5, -4, -3, -2, -1, 0} and sum(x.n_records for x in got.values()) == 601 and max(x.n_records for x in got.values()) < 200
    loose.createOrReplaceTempView("loose")
    con = duckdb.connect()
    con.register("pages", loose.toArrow())
    same(warc.audited(loose), con, queries.OP10_SQL)


def test_work_ends_at_equal_nodes(spark, monkeypatch):
    """Of files that are equal nothing but the roots is paired."""
    r = random.Random(3)
    pages = [(i, f"http://h/{i}", words(r, 9)) for i in range(400)]
    sizes, paired = [], warc._paired
    monkeypatch.setattr(warc, "_paired", lambda a, b: (sizes.append((a.count(), b.count())), paired(a, b))[1])
    hurt = [(i, u, h[:-1] + "~" if i == 50 else h) for i, u, h in pages]
    warc.audit(record_rows(spark, pages), record_rows(spark, hurt)).collect()
    assert sizes == [(10, 10), (3, 3), (16, 16)]


def test_warc_files_are_read_back(spark, tmp_path):
    body = "".join(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: u{i}\r\nContent-Length: {i}\r\n\r\n{'x' * i}\r\n\r\n" for i in range(4))
    (tmp_path / "a.warc").write_bytes(body.encode() + b"WARC/1.0 cut")
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(("WARC/1.0\r\nContent-Length: 2\r\n\r\nab\r\n\r\n").encode()) for _ in range(2)))
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    plain = sorted((r.offset, r.type, r.url, bytes(r.payload)) for r in got if r.file.endswith("a.warc"))
    assert [x[2:] for x in plain[:4]] == [(f"u{i}", b"x" * i) for i in range(4)] and plain[4][1] == "broken"
    assert [bytes(r.payload) for r in got if r.file.endswith("gz")] == [b"ab", b"ab"]


def test_pipeline_judges_rows_of_one_id_by_their_texts(spark, tmp_path):
    r = random.Random(13)
    leak, a, b = words(r, 40, 10_000), words(r, 100), words(r, 100)
    rows = [(1, a), (1, b), (1, "x " + leak), (2, a), (2, b), (3, a), (None, a), (None, words(r, 50)), (None, leak), (4, words(r, 30)), (4, words(r, 30))]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows + rows[:1]], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((str(x.doc_id), x.text) for x in df.collect())
    kept = texts(stages["near_duplicates"](spark, docs, str(tmp_path)))
    assert kept == sorted((str(i), t) for i, t in [rows[0], rows[1], rows[2], rows[7], rows[9], rows[10]])  # the leak without an id is close to that of document 1
    clean = texts(stages["decontamination"](spark, docs, str(tmp_path)))
    assert clean == sorted((str(i), t) for i, t in rows + rows[:1] if leak not in t)


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(12)
    leak = words(r, 40, 10_000)
    base = words(r, 200)
    texts = [words(r, 60) for _ in range(30)] + [base, base, base + " more"] + [words(r, 20) + " " + leak + " " + words(r, 20)]
    texts += [words(r, 30) + " password=0a1b2c3d4e5f60718293", None, "", "short"]
    rows = [(i, t, "en", "s", None, "extra") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = dict(corpus_pipeline.STAGES)
    kept = labels["near_duplicates"](spark, docs, str(tmp_path))
    ids = {x.doc_id for x in kept.collect()}
    assert kept.columns == corpus_pipeline.COLUMNS and 30 in ids and 31 not in ids and None in ids
    assert {x.doc_id for x in labels["decontamination"](spark, docs, str(tmp_path)).collect()} == {x[0] for x in rows} - {33}
    clean = {x.doc_id: x for x in labels["secrets"](spark, docs, str(tmp_path)).collect()}
    assert "0a1b2c" not in clean[34].text and clean[34].n_chars == len(clean[34].text) and len(clean) == len(rows)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) <= len(rows) and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(out[0].asDict())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pages_of_negative_numbers_and_of_none_share_no_file(spark):
    rows = [(-5, "u", "<p>a"), (-300, "v", "<p>b"), (None, "w", "<p>c"), (3, "x", "<p>d"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r.file, r.n_records) for r in warc.audited(df).collect()} == {(-1, 1), (-3, 1), (0, 1), (-4, 2)}
