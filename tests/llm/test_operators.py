"""Each operator against a plain version, and on odd input: nulls, empty and long texts, ties,
repeated rows, empty tables, clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablerecon.llm import bpe, docstats, html_extract, jaccard_join, language_id, licenses, packing, pii, quality_qda, quality_rules, topk_search
from tablerecon.llm.common import among, stored

SF = "/root/testdata/sf0.001"
ODD = [
    (None, "no id at all"), (900001, None), (900002, ""), (900003, "   \n\t "), (900004, "x" * 20000), (900005, "one two three"), (900006, "one two three"), (900006, "one two three"),
    (900007, "İstanbul ΣΑΣ don't  we'll\r\n\t 12³ ½x 日本語 \x1c\x1d \x85 🎉 é"), (900008, "a  b\n\n c <|endoftext|>  x y z  "), (900009, "a@b.c_d@e.f x\x01y \x02 1.2.3.4.5.6.7.8 +1 (555) 123-4567. 4111 1111 1111 1111 0004.1.1.1 300.1.1.1"),
    (900010, "same word " * 400), (900011, "Привет мир как дела"), (900012, "12345 !!! 678"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(150)
    odd = spark.createDataFrame([(i, t, "en" if i == 900011 else None) for i, t in ODD], "doc_id long, text string, lang string")
    # columns that clash with names that operators use inside
    return stored(rows.unionByName(odd).selectExpr("*", "1 as n_words", "'x' as base", "2 as length", "3 as score", "4 as piece"), "docs")


@pytest.fixture(scope="module")
def empty(docs):
    return stored(docs.limit(0), "empty")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_packing(docs, empty, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).toPandas()
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            p = ids[k : k + 2048]
            want[(i, k // 2048, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))] += 1
    assert Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist()) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 2
    assert packing.pack_documents(empty, path).count() == 0


def test_bin_slack_fills_bins():
    rng = random.Random(3)
    counts = Counter(rng.randint(1, 100) for _ in range(3000))
    bins = packing.pack_lengths(dict(counts), 100)
    used = Counter()
    for n, own in bins:
        assert sum(a * b for a, b in own) <= 100
        for a, b in own:
            used[a] += n * b
    # no packing has fewer bins than the total asks for, or than there are items over half a bin
    least = max(-(-sum(a * b for a, b in counts.items()) // 100), sum(n for a, n in counts.items() if a > 50))
    assert used == counts and sum(n for n, _ in bins) <= 1.01 * least


def test_topk(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:400] = x[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(700, None, 1), (750, [None] * 8, 1), (800, [float("nan")] * 8, 1), (850, [1.0] * 3, 1), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk_search.search(df, "vec_id % 50 = 0", 5, block=128, query_block=4).toPandas()
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 700, 50):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == best and own.score.tolist() == s[best].tolist()
    assert set(got.query_id) == set(range(0, 700, 50))
    assert topk_search.search(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_topk_negative_ids(spark):
    x = np.random.default_rng(6).normal(size=(40, 4)).astype(np.float32)
    ids = list(range(-20, 20))
    df = spark.createDataFrame([(i, a.tolist()) for i, a in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = topk_search.search(df, "vec_id % 5 = 0", 5, block=16, query_block=4).toPandas()
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for n in range(0, 40, 5):
        s = v @ v[n]
        best = [ids[i] for i in np.lexsort((np.arange(40), -s)) if i != n][:5]
        assert got[got.query_id == ids[n]].sort_values("rank").vec_id.tolist() == best
    few = topk_search.search(df.where("vec_id in (-5, -1, 3)"), "vec_id = -5", 5)
    assert {r.vec_id for r in few.collect()} == {-1, 3}


def test_topk_clashing_ids(spark):
    """An id with two vectors is two candidates."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.5]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.25, 0.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in topk_search.search(df, "vec_id = 1", 2).orderBy("rank").collect()] == [(1, 2, 65536), (2, 2, 32768)]


def test_topk_prunes(spark):
    """On clustered vectors most pairs are never scored, blocks of other clusters are not even
    searched, and the result is still exact."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(250, 16)) * 0.05 for c in centres])
    v = np.floor(256 * x).astype(np.int64)
    tree, asked = topk_search.cover_tree(v, np.arange(len(v))), topk_search.cover_tree(v[::50], np.arange(0, len(v), 50), topk_search.GROUP)
    _, _, scored = topk_search.dual_search(asked, tree, 5)
    assert scored < 0.35 * len(v) * len(v[::50])
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk_search.search(df, "vec_id % 50 = 0", 5, block=128, query_block=16).toPandas()
    for q in range(0, len(v), 50):
        s = v @ v[q]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:5]
    rows = stored(topk_search.integer_vectors(df), "v")
    pivots = topk_search.chosen_pivots(rows, 24)
    assert pivots == topk_search.chosen_pivots(rows, 24) and len({min(range(12), key=lambda i: sum((centres[i] * 256 - p) ** 2)) for p in map(np.array, pivots)}) == 12
    dealt = topk_search.cells(rows, pivots, 128)
    data = topk_search._trees(dealt, 128, 6)
    queries = topk_search._trees(topk_search._query_cells(dealt.where("vec_id % 50 = 0"), 16), 16, 1 << 62, topk_search.GROUP)
    pairs = topk_search.block_pairs(queries, data, topk_search._first_search(queries, data, 5)).count()
    assert pairs < 0.35 * data.count() * queries.count()


def test_topk_deals_again(spark, monkeypatch):
    """Few pivots for many vectors: cells are dealt again until they are blocks, except where all
    vectors are equal; every row stays, and the result is exact."""
    monkeypatch.setattr(topk_search, "PIVOTS", 3)
    monkeypatch.setattr(topk_search, "FAN", 4)
    monkeypatch.setattr(topk_search, "DEAL_BYTES", 4000)
    monkeypatch.setattr(topk_search, "CHUNK", 4)
    rng = np.random.default_rng(10)
    x = np.concatenate([c + rng.normal(size=(100, 6)) * 0.1 for c in rng.normal(size=(8, 6)) * 2] + [np.ones((400, 6))])
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    rows = stored(topk_search.integer_vectors(df), "v")
    dealt = topk_search.cells(rows, [r.v for r in rows.orderBy("vec_id").limit(3).collect()], 10)
    assert sorted(r.vec_id for r in dealt.select("vec_id").collect()) == list(range(1200))
    held = {r.cell: r["count"] for r in dealt.groupBy("cell").count().collect()}
    assert max(map(len, held)) > 3 and sorted(held.values())[-2] <= 20 and max(held.values()) >= 400
    blocks = topk_search._trees(dealt, 10, 1 << 62)
    roots = [(np.frombuffer(r.centre), r.radius, np.frombuffer(r.centres).reshape(-1, 6), np.frombuffer(r.radii)) for r in topk_search._over(topk_search._roots(blocks)).collect()]
    assert all((np.linalg.norm(cs - c, axis=1) + rs <= radius).all() for c, radius, cs, rs in roots)
    got = topk_search.search(df, "vec_id % 50 = 0", 5, block=10, query_block=4).toPandas()
    v = np.floor(256 * x).astype(np.int64)
    for q in range(0, len(v), 50):
        s = v @ v[q]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:5]


def test_topk_overflow(spark):
    """Scores of up to 63 bits are exact; larger ones are refused."""
    big = float(2**22)
    df = spark.createDataFrame([(0, [big, big]), (1, [big, 1.0]), (2, [-big, 3.0])], "vec_id long, embedding array<double>")
    n = int(256 * big)
    assert [(r.vec_id, r.score) for r in topk_search.search(df, "vec_id = 0", 2).orderBy("rank").collect()] == [(1, n * n + 256 * n), (2, -n * n + 768 * n)]
    with pytest.raises(OverflowError):
        topk_search.search(df.union(spark.createDataFrame([(3, [1e9, 1e9])], df.schema)), "vec_id = 0")


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_pii(spark, docs, empty, texts):
    model = pii.train(spark)
    got = Counter((r.doc_id, r.base_sha256) for r in pii.digests(pii.find(docs, model)).collect())
    want = Counter()
    for i, t in texts:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if passes(k, m[0])]
        want[(i, hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert got == want
    assert pii.find(empty, model).count() == 0
    one = spark.createDataFrame([(1, 'tel: 415-555-2671, ssn 123-45-6789; token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" and é@ me@x.org.')], "doc_id long, text string")
    found = pii.find(one, model, keep=["text"]).select(pii.redact(F.col("text"), F.concat("base", "added")).alias("t")).first().t
    assert found == 'tel: [LOCAL_PHONE], ssn [SSN]; token = "[SECRET]" and é@ [EMAIL].'
    plain = "The and attion to thanedble the, anea. Version 2.0.1 has 123 pages and internationalization."
    assert pii.find(spark.createDataFrame([(1, plain)], "doc_id long, text string"), model).where("size(base) + size(added) > 0").count() == 0


def test_pii_long_texts(spark):
    """Time is about linear in the candidates, and nothing is lost at the seams of runs and chunks."""
    import time

    model = pii.train(spark)
    rng = random.Random(8)
    numbers = ", ".join(str(rng.randint(10, 99999)) for _ in range(150_000))
    mixed = " ".join(f'a{i}@b.com key="{rng.getrandbits(120):x}Zq9{i}" 10.0.{i % 250}.7 é' for i in range(6000))
    df = spark.createDataFrame([(1, numbers), (2, mixed)], "doc_id long, text string")
    began = time.time()
    found = pii.find(df, model, keep=["text"]).select("doc_id", "base", "added", pii.redact(F.col("text"), F.concat("base", "added")).alias("clean")).orderBy("doc_id").collect()
    assert time.time() - began < 60
    assert found[0].base == [] and found[0].added == [] and found[0].clean == numbers
    want = [(k, m.start(), m.end()) for k in ("email", "ip") for m in re.finditer(PATTERNS[k], mixed)]
    assert [tuple(s) for s in found[1].base if s.kind in ("email", "ip")] == want
    assert len(found[1].added) > 5900
    holes = sorted(((s.start, s.end, s.kind) for s in [*found[1].base, *found[1].added]), key=lambda x: (x[0], -x[1], x[2]))
    out, at = [], 0
    for lo, hi, kind in holes:
        if lo >= at:
            out += [mixed[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    assert found[1].clean == "".join(out) + mixed[at:]


def test_pii_overlaps(spark):
    """Greedy choice over a chain, and added spans that base spans cover."""
    span = "struct<start:int,score:double,order:int,kind:string,end:int>"
    df = spark.sql(f"""select cast(array(named_struct('start', 0, 'score', 3D, 'order', 0, 'kind', 'a', 'end', 5), named_struct('start', 4, 'score', 2D, 'order', -1, 'kind', 'b', 'end', 9),
      named_struct('start', 8, 'score', 1D, 'order', -2, 'kind', 'c', 'end', 12), named_struct('start', 20, 'score', 1D, 'order', 0, 'kind', 'a', 'end', 22)) as array<{span}>) as s,
      cast(array(named_struct('kind', 'ip', 'start', 8, 'end', 30)) as array<struct<kind:string,start:int,end:int>>) as base""")
    chains = df.select(F.flatten(F.transform(pii._chains(F.col("s")), pii._greedy)).alias("k")).first().k
    assert [(x.kind, x.start) for x in chains] == [("a", 0), ("c", 8), ("a", 20)]
    left = df.select(pii._uncovered(F.col("base"), F.col("s")).alias("k")).first().k
    assert [(x.kind, x.start) for x in left] == [("a", 0), ("b", 4)]


def test_html(spark):
    model = html_extract.train()
    for style in html_extract.STYLES:
        pages = [html_extract.generated_page(np.random.default_rng(s), style) for s in range(500, 560)]
        own = [(b, p) for b, p in zip(html_extract.label([a for a, _ in pages], model), pages, strict=True) if b[0] == [t for t, _ in p[1]]]
        right = sum(int(((b[1] >= 0.5) == np.array([y for _, y in p[1]])).sum()) for b, p in own)
        assert len(own) == len(pages) and right / sum(len(b[0]) for b, _ in own) > (0.99 if style == "named" else 0.97)
    real = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, None, "<p>" * 3000), (-4, "v", "no tags & <"), (-5, "w", "<script>alert(1)")], "page_id long, url string, html string")
    got = html_extract.extract(real.unionByName(odd).withColumn("text", F.lit(1)), model).toPandas()
    import html as h

    for r in real.collect():
        parts = re.split(r"<(?:/?p|/?h1|/?article)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want = "\n".join(s for x in parts if (s := " ".join(h.unescape(re.sub("<br>", " ", x).replace("<b>", "").replace("</b>", "")).split())))
        assert got[got.page_id == r.page_id].text.tolist() == [want]
    assert len(got) == real.count() + 5 and got[got.page_id.isin([-1, -2, -3, -5])].n_chars.sum() == 0


def test_html_unknown_layouts():
    """Pages as people write them, with names that no generated page has."""
    model = html_extract.train()
    some = "It was late when the train from the north came in, and nobody had thought of a porter or of the rain that fell on the old platform"
    para = lambda n: f"<p>{' '.join([some] * n)}.</p>"
    head = "<html><head><title>x</title></head><body>"
    pages = {
        f'{head}<div class="zone-x"><a href="1">Start</a> <a href="2">Archive</a></div><div class="zone-a">{para(3)}{para(4)}</div><div class="zone-b">Copyright 2020 Someone</div></body>': (2, 2),
        f'{head}<table><tr><td><a href="1">Start</a><br><a href="2">Archive</a></td><td><h1>The late train</h1>{para(3)}{para(2)}</td></tr></table></body>': (3, 1),
        f'{head}<article><h1>The late train</h1>{para(3)}{para(4)}{para(2)}</article><section class="responses"><h3>2 responses</h3><div><b>Ann</b>{para(1)}</div><div><b>Bob</b>{para(1)}</div></section></body>': (4, 5),
        f'{head}<div class="q7"><div class="q8">{para(2)}{para(2)}{para(5)}</div></div></body>': (3, 0),
    }
    for (texts, p), (main, other) in zip(html_extract.label(list(pages), model), pages.values(), strict=True):
        assert len(texts) == main + other and sum(p >= 0.5) == main
        assert all((some in t or t == "The late train") for t, x in zip(texts, p, strict=True) if x >= 0.5)


def test_html_structures():
    """Data tables, lists, terms, code and figures of an article are kept cell by cell, within
    and at the end of it; a table of links beside it is not."""
    some = "It was late when the train from the north came in, and nobody had thought of a porter or of the rain that fell on the old platform"
    para = lambda n: f"<p>{' '.join([some] * n)}.</p>"
    cells = [("Oslo", "1990", "12,300"), ("Bergen", "1991", "9,870"), ("Turku", "2003", "411"), ("Kiel", "2010", "77 %")]
    parts = [
        "<table><tr><th>City</th><th>Year</th><th>Riders</th></tr>" + "".join(f"<tr>{''.join(f'<td>{x}</td>' for x in row)}</tr>" for row in cells) + "</table>",
        "<table>" + "".join(f"<tr>{''.join(f'<td>{x}' for x in row)}" for row in cells) + "</table>", "<ol>" + "".join(f"<li>item {i} of the list" for i in range(5)) + "</ol>",
        "<dl><dt>Porter</dt><dd>A man who carries things.</dd><dt>Rain</dt><dd>Water.</dd></dl>", "<pre>for i in range(3):\n  print(i)</pre>", "<figure><img src=a><figcaption>The old platform</figcaption></figure>",
    ]
    menu = '<nav><ul><li><a href="1">Home</a></li><li><a href="2">News</a></li><li><a href="3">Contact</a></li></ul></nav>'
    side = '<div class="sidebar"><h3>Popular</h3><table><tr><td><a href="4">Scores</a></td><td>3:1</td></tr></table></div>'
    pages, want = [], []
    for part in parts:
        for tag in ("article", 'div class="post-body"'):
            for end in (para(3), ""):
                body = f"<{tag}><h1>The late train</h1>{para(2)}{part}{end}</{tag.split()[0]}>"
                pages.append(f"<html><head><title>x</title></head><body>{menu}{body}{side}<footer><p>© 2020 Someone. All rights reserved.</p></footer></body></html>")
                want.append([b[0] for b in html_extract.leaf_blocks(body)])
    for (texts, p), own in zip(html_extract.label(pages, html_extract.train()), want, strict=True):
        assert [t for t, x in zip(texts, p, strict=True) if x >= 0.5] == own


def test_html_layout_left_out():
    """Trained without tables, with which the model is then tested."""
    styles = {"named": 0.5, "opaque": 0.3, "bare": 0.2}
    model = html_extract.train(5, 500, 6, 48, tuple(styles))
    pages = [html_extract.generated_page(np.random.default_rng(s), "table") for s in range(900, 960)]
    own = list(zip(html_extract.label([a for a, _ in pages], model), pages, strict=True))
    right = sum(int(((b[1] >= 0.5) == np.array([y for _, y in p[1]])).sum()) for b, p in own)
    assert right / sum(len(b[0]) for b, _ in own) > 0.93


def test_html_linear():
    """A megabyte of what has no end."""
    import time

    began = time.time()
    for page in ("<a " * 300_000, '<a x=">" ' * 110_000, "<! " * 300_000, "</script " * 100_000, "<script>" + "</script " * 110_000, "<div>x" * 150_000, "<div>" * 100_000 + "</x>" * 100_000, "<svg>" * 100_000 + "<g>" * 100_000, "&amp" * 250_000, "<p class='" * 100_000):
        html_extract.leaf_blocks(page)
    assert time.time() - began < 30
    texts = lambda page: [t for t, _, _ in html_extract.blocks(page)]
    assert texts("<p>1 < 2</p><p>a</p><p title='x>y'>b</p><p title=it's>c</p><p>d <b") == ["1 < 2", "a", "b", "c", "d"]


def test_html_unclosed():
    texts = lambda page: [t for t, _, _ in html_extract.blocks(page)]
    body = "<article><p>One two.</p><p>Three.</p></article>"
    for head in ("<head><title>x</title>", "<head><title>x</title></head>", "<HEAD><meta a='b'><link><script>a<b</script>\n", "<head><noscript><link></noscript><style>p{}</style>"):
        for start in ("<body>", ""):
            assert texts(f"<html>{head}{start}{body}</html>") == ["One two.", "Three."]
    assert texts("<head><title>x</title>Plain text") == ["Plain text"]
    assert texts("<p>a <svg width='1'/> b <math/> c</p><p>d</p>") == ["a b c", "d"]
    assert texts("<p>a <svg><title>t</title><script/><g><text>x</text></g></svg> b</p>") == ["a b"]
    assert texts("<p>a <svg><path d='x'/> y</p><p>b</p>") == ["a", "b"]
    for tag in ("select", "object", "noscript", "iframe", "template"):
        assert texts(f"<p>a</p><{tag}>{body}") == ["a", "One two.", "Three."]
        assert texts(f"<p>a</p><{tag}>{body}<{tag}>hidden</{tag}>") == ["a", "One two.", "Three."]
        assert texts(f"<p>a</p><{tag}><i>hidden</i></{tag}>{body}") == ["a", "One two.", "Three."]
    for tag in ("script", "style", "textarea", "title"):
        assert texts(f"<p>a</p><{tag}>b<p>c</p>") == ["a"]
    assert texts("<p>a</p><object>x<object>y</object>z</object><p>b</p>") == ["a", "b"]
    assert len(texts("<svg>" * 20000 + "<p>a</p>")) == 1


def brute_groups(texts):
    sets = []
    for _, t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    held, up = defaultdict(list), list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in held[g])
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
        for g in s:
            held[g].append(i)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(texts))


def test_jaccard(spark, docs, empty, texts, monkeypatch):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    made = []
    for i in range(60):  # chains of near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"z{i}"
        made.append((10_000 + i, " ".join(w[: rng.randint(90, 120)])))
    made += [(20_000 + i, " ".join(base[:60]) + f" tail{i} " + " ".join(f"q{i}_{j}" for j in range(rng.randint(5, 40)))) for i in range(40)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    want = brute_groups(texts + made)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 1.0)  # the sample is all: shingles of the made texts are hot
    monkeypatch.setattr(jaccard_join, "HOT_ONE_IN", 10)
    df = stored(df, "j")
    assert len(jaccard_join._hot(df, 5, 1.0)) > 20
    for more in ({}, {"pairs_per_set": 1}, {"bucket_bytes": 4096, "lanes": 8}):  # the last with a second exchange
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(df, **more).collect())
        assert got == want, more
    assert jaccard_join.similar_groups(empty).count() == 0


def test_counts_and_rules(spark, docs, empty, texts):
    got = Counter(tuple(r) for r in docstats.document_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for i, t in texts:
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))] += 1
    assert got == want
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.judge(docs, labels)
    assert rows.where("base_failed and kept").count() == 0 and rows.where("base_failed is null or kept is null").count() == 0
    assert quality_rules.judge(empty, labels.limit(0)).count() == 0


def test_binomial_bound():
    assert abs(quality_rules.binomial_upper(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert abs(quality_rules.binomial_upper(5, 50, 0.05) - 0.2) < 0.01 and quality_rules.binomial_upper(3, 3, 0.1) == 1.0


def test_binomial_bound_is_exact():
    from fractions import Fraction
    from math import comb

    for n in (1, 7, 40, 300):
        for r in {0, 1, n // 3, n - 1, n}:
            for p in (0.001, 0.05, 0.5, 0.97):
                q = Fraction(p)
                want = float(sum(comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(r + 1)))
                assert abs(quality_rules.binomial_at_most(r, n, p) - want) < 1e-9
    assert abs(quality_rules.binomial_upper(50_000_000, 10**9, 0.01) - 0.05) < 1e-4
    assert 0 < quality_rules.binomial_at_most(49_990_000, 10**9, 0.05) < 0.5


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_cutoffs_on_unseen_labels(spark, sf):
    """Chosen on two thirds of the labels, judged on the rest: the method decides something, and
    good documents stay."""
    d = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = quality_rules.judge(docs, labels.where(~late)).join(labels.where(late), "doc_id").where("not base_failed")
    good, bad = (rows.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.95 and bad < 0.3, (good, bad)
    cutoffs = quality_rules.choose_cutoffs(stored(docstats.document_counts(docs), "counts"), labels)
    assert sum(map(len, cutoffs.values())) > 0
    assert not any(quality_rules.choose_cutoffs(docstats.document_counts(docs), labels.limit(0)).values())


def test_kept_by_a_plain_version(spark, docs):
    """apply_rules against a loop over rows."""
    cutoffs = {0: {"symbols": 0.1}, 1: {"capitals": 0.3, "echo": 0.05}, 2: {"lines": 0.2, "shouting": 0.05}}
    counts = docstats.document_counts(docs)
    for r in quality_rules.apply_rules(counts, cutoffs).collect():
        s = sum(r.n_words >= top for top in quality_rules.BANDS)
        failed = [n for n in cutoffs[s] if r[quality_rules.RULES[n][0]] / max(r[quality_rules.RULES[n][1]], 1) > cutoffs[s][n]]
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert (sorted(r.failed_rules), r.base_failed, r.kept) == (sorted(failed), base, not base and not failed)


def test_bpe(docs, empty, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.encode_and_decode(docs, path).collect()) == want
    assert bpe.encode_and_decode(empty, path).count() == 0


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    lengths = [0, 1, 5, 3, 0, 4]
    scores = rng.normal(size=(sum(lengths), 3)).astype(np.float32) * 2
    first = np.concatenate(([0], np.cumsum(lengths)))
    got = language_id.viterbi(scores, first, 1.5)
    from itertools import product

    for a, b in zip(first, first[1:], strict=False):
        best = max((sum(scores[a + k, x] for k, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False)) for p in product(range(3), repeat=b - a)), default=0)
        own = got[a:b]
        assert abs(sum(scores[a + k, x] for k, x in enumerate(own)) - 1.5 * sum(own[1:] != own[:-1]) - best) < 1e-4


def test_language(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learned(d)
    rows = language_id.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").where("pmod(crc32(cast(doc_id as string)), 3) = 1")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (900001, 900002, 900003, 900012)) and all(0 <= s <= 1 for _, s in got.values())
    en, de = (d.where(f"lang = '{x}' and n_chars > 800").orderBy("doc_id").first().text[:600] for x in ("en", "de"))
    mixed = language_id.identify(spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string"), model, spans=True).first()
    assert [s.lang for s in mixed.spans if s["last"] - s["first"] > 20] == ["en", "de"]
    assert language_id.identify(empty, language_id.learned(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learned(empty)).collect()} == {"und"}


def test_quality_classifier(spark, docs, empty):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_qda.judge(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("pmod(crc32(cast(doc_id as string)), 5) = 0")
    assert rows.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.97
    assert quality_qda.judge(docs, labels).where("score is null or score < 0 or score > 1").count() == 0
    assert quality_qda.judge(empty, labels.limit(0)).count() == 0
    counts = docstats.document_counts(docs)
    model = quality_qda.Discriminant(np.zeros((2, 10)), np.stack([np.eye(10), 2 * np.eye(10)]), np.zeros(2))
    x = quality_qda._featured(counts).toPandas()[list(quality_qda.FEATURES)].to_numpy()
    assert np.allclose(sorted(model.scores(x)), sorted(r.score for r in quality_qda.score(counts, model).collect()))


def test_licenses(spark, docs, empty):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE")), (2, mit + " and more"), (3, "text\nReleased under the  MIT licence\nlicensed under cc by-nc 4.0"), (4, None)]
    got = {r.doc_id: (r.license_id, r.line_licenses, r.n_license_lines) for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "", 0), 2: (None, "", 0), 3: (None, "CC-BY-NC-4.0,MIT", 2), 4: (None, "", 0)}
    assert licenses.scan(spark, docs).count() == docs.count() and licenses.scan(spark, empty).count() == 0


def _same_as_sql(rows):
    """The scan's rows against its SQL over the same texts."""
    import duckdb
    import pandas as pd

    db = duckdb.connect()
    db.register("documents", pd.DataFrame({"doc_id": [r.doc_id for r in rows], "text": [r.text for r in rows]}))
    want = {r[0]: r[1:] for r in db.execute(licenses.oracle_sql()).fetchall()}
    assert [(r.text, want[r.doc_id]) for r in rows if want[r.doc_id] != (r.digest, r.license_id, r.line_licenses, r.n_license_lines)] == []


def _with_text(spark, df):
    return licenses.scan(spark, df).join(df, "doc_id").collect()


def test_licence_sql(spark):
    """Lines that begin like a notice, running text among them, alone and between others."""
    words = ["copyright", "copyright ", "(c)", "©", "by", "notice", "holder", "Foo Ltd", "2020", "in 1999", ":", ",", "  ", "&copy;", "[year]", "and", "years", "by law", "noticeboard", "x"]
    made = random.Random(5)
    lines = ["".join(made.choice(["", " ", "# ", "\t"]) + w for w in made.choices(words, k=made.randint(1, 6))) for _ in range(1500)]
    texts = ["", None, "copyright  notice 2020", "copyright  holders: Foo", "(c) copyright owners", "\ncopyright notice: 2001 x", "(a) x\n(b) y\n\n(c) z 2020", *lines]
    for _ in range(1500):
        texts.append("\n".join(made.choice(lines + ["", "MIT License", "Released under the MIT licence", "(b) item"]) for _ in range(made.randint(2, 6))))
    _same_as_sql(_with_text(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))


def test_licenses_wrapped(spark):
    import textwrap

    heads = ["Copyright (c) 2020 Someone", "# Copyright 2019-2021, Some One <a@b.c>", "(c) 2020 X\n(C) Copyright Y", "© Z", "Copyright The Foo Authors\nCopyright Bar Inc. All rights reserved.", "Copyright Foo 2011", "Copyright <YEAR> <HOLDER>", "(c) Foo Ltd"]
    rows, want = [], {}
    for license_id, t in licenses.KNOWN:
        for width in (20, 33, 40, 57, 60, 65, 72, 76, 79, 80, 100):
            rows.append("\n".join(textwrap.fill(x, width, break_long_words=False) for x in t.split("\n")))
            want[rows[-1]] = license_id
        for head in heads if len(t) > 300 else []:
            rows.append(head + "\n\n" + t)
            want[rows[-1]] = license_id
    lead = dict(reversed(licenses.KNOWN[:2]))["MIT"]
    for head in heads:
        rows.append("MIT License\n" + head + "\n\n" + lead)
        want[rows[-1]] = "MIT"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    scanned = _with_text(spark, df)
    _same_as_sql(scanned)
    got = {r.doc_id: (r.license_id, r.digest) for r in scanned}
    assert [(t, want[t]) for i, t in enumerate(rows) if got[i][0] != want[t]] == []
    assert all(hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest() == got[i][1] for i, t in enumerate(rows))
    for t in ("keep the\ncopyright notice", "the\ncopyright owner agrees", "(a) x\n\n(b) y\n\n(c) you must keep"):
        assert "copyright" in licenses.canonical_text(t) or "you must keep" in licenses.canonical_text(t)


def test_whole_licences(spark):
    """The texts as Debian ships them, if they are there: digests are those of the canonical form."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts on this machine")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
    rows, want = [], []
    for i, (name, license_id) in enumerate(names.items()):
        text = (folder / name).read_text()
        rows += [(3 * i, text), (3 * i + 1, "  " + text.upper().replace("\n", "\n * ")), (3 * i + 2, text + "\nAnd a pony.")]
        want += [(3 * i, license_id), (3 * i + 1, license_id), (3 * i + 2, None)]
        one = " ".join(text.split())  # a whole licence as one line of a longer text
        rows.append((1000 + i, "Notes\n" + one + "\nmore"))
    got = {r.doc_id: r for r in _with_text(spark, spark.createDataFrame(rows, "doc_id long, text string"))}
    _same_as_sql(got.values())
    assert [(i, got[i].license_id) for i, _ in want] == want
    assert {got[1000 + i].line_licenses for i, name in enumerate(names) if name in ("MPL-2.0", "Artistic")} == {"MPL-2.0", "Artistic-1.0-Perl"}


def test_licence_rows_stay(spark):
    rows = [(None, "Released under the MIT License."), (None, "x"), (1, "x"), (1, "x"), (1, "Released under the MIT License.\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as digest", "2 as _row", "3 as lines")
    assert Counter((r.doc_id, r.license_id, r.line_licenses, r.n_license_lines) for r in licenses.scan(spark, df).collect()) == Counter([(None, "MIT", "MIT", 1), (None, None, "", 0), (1, None, "", 0), (1, None, "", 0), (1, None, "MIT", 2)])


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_among(spark, most_bytes):
    edge = [None, -40000, -32768, -1, 0, 1, 2, 7, 8, 9, 32767, 32768, 32769, 65536, 10**12, 2**62]
    rows = spark.createDataFrame([(i, "t") for i in [*edge, *range(-300, 300, 3), 5, 5]], "doc_id long, text string")
    for kept in ([], edge, [1, 1, 32768, None], list(range(-300, 300, 7))):
        ids = spark.createDataFrame([(i,) for i in kept], "doc_id long")
        got = among(rows, ids, most_bytes)
        assert got.columns == rows.columns
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in rows.collect() if r.doc_id is not None and r.doc_id in kept)


def test_near_duplicate_stage(spark):
    import corpus_pipeline as p

    rng = random.Random(4)
    text = lambda n=60: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    near = lambda t: t + " tail"
    rows = [
        (None, a), (None, b), (None, near(b)), (None, near(b)), (7, c), (None, c), (None, near(c)),  # null ids
        (8, d), (8, d), (8, d), (9, near(d)),  # repeated rows
        (10, e), (11, f), (11, near(e)), (12, g), (12, text()), (13, near(g)), (14, near(f)),  # shared ids
        (15, None), (15, None), (None, ""), (None, ""), (None, None), (16, " \n"), (17, "x y"), (17, "x y"), (-3, "X  y"),
    ]
    clean = [(i, text(30)) for i in range(100, 110)]

    def wanted(rows):
        at = brute_groups([(i, t) for i, (_, t) in enumerate((d, t or "") for d, t in rows)])  # ids are row numbers
        groups = defaultdict(list)
        for i, n, root in at:
            groups[root if n else ("alone", i)].append(rows[i])
        return [{r for r in own if (r[0] is None, r[0] or 0) == min((x is None, x or 0) for x, _ in own)} for own in groups.values()]

    for own in (rows + clean, clean + [(99, near(clean[3][1]))], [r for r in rows if r[0] is None], []):
        df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in own], "doc_id long, text string, lang string, source string, n_chars long")
        got = Counter((r.doc_id, r.text) for r in p.near_duplicate_stage(spark, stored(df, "d"), SF).collect())
        want = wanted(own)
        assert got.total() == len(want)
        for options in want:  # a row of each group, of those with its least id
            own = next(o for o in options if got[o])
            got[own] -= 1
        assert got.total() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs
    for name, stage in p.STAGES[:-1]:
        kept = stored(stage(spark, rows, SF), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= rows.count()
        if name == "near_duplicates":
            texts = [(r.doc_id, r.text) for r in rows.collect()]
            assert {r.doc_id for r in kept.collect()} == {d for d, _, c in brute_groups(texts) if d == c}
        rows = kept
    packed = p.run(spark, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in rows.collect()}


def test_rule_cutoffs_are_compiled(spark, docs):
    """No step of learning or applying cutoffs falls back to interpretation."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert quality_rules.judge(docs, labels).count() == docs.count()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
