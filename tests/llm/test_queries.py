"""The registered queries and the pipeline's stages, on tables with odd rows and on empty ones."""

import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablerecon.llm import language_id, quality_qda
from tablerecon.llm.common import stored
from tablerecon.llm.docstats import document_counts
from tablerecon.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "no id at all", None, None, None), (None, None, "en", "s", 0), (900001, None, None, "s", None), (900002, "", "de", None, 0), (900003, " \n\t ", None, "s", 4),
    (900004, "word " * 30_000, "en", "s", 150_000), (900005, "one two three", None, "s", 13), (900005, "one two three", None, "s", 13), (900006, "x" * 50_000, None, "s", 50_000),
    (900007, "12345 !!! 678", None, "s", 13), (900008, "mail me@example.org or call +1 555 123 4567", "en", "s", 43), (900009, "Привет мир", None, "s", 10), (-5, "negative id", "en", "s", 11),
]
#: contract columns of each query and their types
COLUMNS = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_topk_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op5_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_license_scan": "doc_id bigint, digest string, license_id string, line_licenses string, n_license_lines bigint",
    "op11_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op12_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}
PER_DOCUMENT = [n for n in COLUMNS if n.startswith(("op3", "op5", "op6", "op7", "op8", "op9", "op10", "op11"))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a small corpus with odd rows; every one has columns that clash with inner names."""
    root = tmp_path_factory.mktemp("odd")
    clash = ["*", "1 as n_words", "'x' as base", "2 as length", "3 as score", "4 as piece", "'y' as digest", "5 as _row", "6 as _text", "7 as quality"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).limit(120)
    docs.unionByName(spark.createDataFrame(ODD, DOCUMENTS)).selectExpr(*clash).coalesce(3).write.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd_labels = spark.createDataFrame([(None, 1, 0), (900005, None, None), (900005, 1, 0), (900005, 0, 0), (900004, 7, 0)], "doc_id long, quality int, toxic int")
    labels.select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")).unionByName(odd_labels).withColumn("n_words", F.lit(1)).write.parquet(f"{root}/labels.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(10)
    pages.unionByName(spark.createDataFrame([(None, None, None), (-1, "u", ""), (-1, "u", ""), (-2, None, "<p>")], "page_id long, url string, html string")).withColumn("text", F.lit(1)).write.parquet(f"{root}/pages.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").limit(60)
    odd_vectors = spark.createDataFrame([(None, [1.0] * 64), (1000, None), (1050, [float("nan")] * 64), (1100, [None] * 64), (1150, []), (1200, [0.5] * 64), (1200, [0.5] * 64)], "vec_id long, embedding array<float>").withColumn("label", F.lit(None).cast("int"))
    vectors.unionByName(odd_vectors).withColumn("dim", F.lit(1)).write.parquet(f"{root}/embeddings.parquet")
    return str(root)


@pytest.fixture(scope="module")
def nothing(spark, folder, tmp_path_factory):
    root = tmp_path_factory.mktemp("nothing")
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def documents(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


def crc(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def test_all_are_registered():
    assert list(QUERIES) == list(COLUMNS) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_odd_rows(spark, folder, name):
    rows = QUERIES[name](spark, folder)
    kinds = dict(rows.dtypes)
    assert {c: kinds.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    got, docs = rows.collect(), documents(spark, folder)
    if name in PER_DOCUMENT:
        assert Counter(r.doc_id for r in got) == Counter(d[0] for d in docs)
    if name.startswith("op1_"):
        assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(d[0] for d in docs)
        assert max(r.offset + r.length for r in got) <= 2048
    if name.startswith("op4_"):
        assert len(got) == 14 and sum(r.text == "" for r in got if r.page_id in (None, -1, -2)) == 4
    if name.startswith("op2_"):
        # an id of a vector without dimensions has nobody to compare with
        assert {r.query_id for r in got} == {i for i in (0, 50, 1200) if i == 1200 or any(r.query_id == i for r in got)} and not any(r.vec_id == r.query_id for r in got)
        assert Counter(r.query_id for r in got) == {q: 5 for q in {r.query_id for r in got}}
    if name.startswith(("op8_", "op9_")):
        modulus, held = (3, 1) if name.startswith("op8_") else (5, 0)
        assert all(r.held_out == (None if r.doc_id is None else crc(r.doc_id, modulus) == held) for r in got)
        assert all(0 <= r.score <= 1 for r in got)
    if name.startswith("op9_"):
        assert all(r.predicted == (r.score >= 0.3) for r in got)
    if name.startswith("op8_"):
        letterless = {900001, 900002, 900003, 900007}
        assert {r.doc_id for r in got if r.lang_pred == "und" and r.doc_id is not None} == letterless


@pytest.mark.parametrize("name", ["op11_source_mixing", "op12_hard_negatives", "op13_filter_audit"])
def test_against_sql(spark, folder, name):
    """On odd rows, by other means than the operator's."""
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, folder).select(*want.columns)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_language_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = rows_of(corpus_pipeline.language_stage(spark, docs, folder))
    all_ = rows_of(docs)
    assert not kept - all_
    gone = all_ - kept
    assert {d[0] for d in gone} >= {900001, 900002, 900003, 900007, 900009} and (None, None, "en", "s", 0) in gone
    assert kept[(900005, "one two three", None, "s", 13)] == 2 and (None, "no id at all", None, None, None) in kept
    model = language_id.learned(docs)
    want = language_id.identify(docs, model, keep=corpus_pipeline.COLUMNS[1:]).where("lang_pred <> 'und' and recognised >= 0.5")
    assert kept == rows_of(want)


def test_mixed_languages_stay(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    parts = [d.where(f"lang = '{x}' and n_chars > 800").orderBy("doc_id").first().text[:400] for x in ("en", "de", "fr", "es")]
    mixed = spark.createDataFrame([(1, " ".join(parts), None, "s", 1600), (2, "これは日本語の文章です " * 20, None, "s", 1)], DOCUMENTS)
    labelled = d.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).unionByName(mixed)
    kept = corpus_pipeline.language_stage(spark, labelled, SF).where("doc_id in (1, 2) and source = 's'")
    assert [r.doc_id for r in kept.collect()] == [1]


def test_quality_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = rows_of(corpus_pipeline.quality_stage(spark, docs, folder))
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    own = document_counts(docs, keep=corpus_pipeline.COLUMNS[1:])
    want = quality_qda.score(own, quality_qda.fit(own, labels), keep=corpus_pipeline.COLUMNS[1:]).where("score >= 0.3")
    assert kept == rows_of(want) and not kept - rows_of(docs)
    unlabelled = docs.where("doc_id = 900005")
    spark.createDataFrame([], "doc_id long, quality int").write.mode("overwrite").parquet(f"{folder}/none/labels.parquet")
    assert rows_of(corpus_pipeline.quality_stage(spark, unlabelled, f"{folder}/none")) == rows_of(unlabelled)


def test_pii_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.pii_stage(spark, docs, folder)
    assert got.columns == corpus_pipeline.COLUMNS
    rows, before = got.collect(), documents(spark, folder)
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in before)
    after = {r.doc_id: r for r in rows}
    assert after[900008].text == "mail [EMAIL] or call [PHONE]" and after[900008].n_chars == len(after[900008].text)
    assert after[900001].text is None and after[900001].n_chars is None and after[900002].text == ""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for i, text, *_ in before:
        if i is not None and text is not None and not re.search(r"[0-9@]|\S{20}", text):
            assert after[i].text == text
        if i is not None and text is not None:
            assert not email.search(after[i].text)


def test_packing_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(d[0] for d in documents(spark, folder))
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, at, n), (s2, at2, _) in zip(places, places[1:], strict=False):
        assert at2 == (at + n if s2 == s else 0)


def test_stages_on_empty_tables(spark, nothing):
    docs = spark.read.parquet(f"{nothing}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, nothing), name)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
            docs = out
