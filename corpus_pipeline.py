"""From raw documents to packed sequences: language, quality, near duplicates, personal data,
packing. Each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.llm import jaccard_join, language_id, packing, pii, quality_qda
from tablerecon.llm.common import among, cut, id_remainder, ship, stored, table
from tablerecon.llm.docstats import document_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: the least share of letters in words of a script that a learned language is written in
LEAST_RECOGNISED = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in recognised languages, one or several mixed; goes: texts without a
    letter (null and empty ones too), and texts of which under LEAST_RECOGNISED of the letters
    are in a script that any learned language is written in. Learns from the documents' own
    labels. Repeated rows and rows with a null id are judged like others."""
    ship(spark)
    rows = language_id.identify(docs, language_id.learned(docs), keep=COLUMNS[1:])
    return rows.where((F.col("lang_pred") != "und") & (F.col("recognised") >= LEAST_RECOGNISED)).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier takes for good. Null and empty texts are
    scored like others, by statistics of nothing; repeated rows and rows with a null id are
    judged like others (a null id has no label). Without labels of both classes nothing is
    learned, every score is 0.5 and all documents stay."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").where(id_remainder(5) != 0)
    model = quality_qda.fit(document_counts(docs), labels)  # joins counts, not texts
    rows = quality_qda.score(document_counts(docs, keep=COLUMNS[1:]), model, keep=COLUMNS[1:])
    return rows.where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of every group of near duplicates: that with the smallest id,
    null ids last, then the smallest digest of the row. Groups are of rows: a null id groups
    like any other, a repeated row is a copy, and rows that share an id are judged apart by
    their texts. Wordless rows are near nothing, each stands for itself and all stay.

    Where an id is in one row only, ids tell which rows stay, so that texts are not shuffled;
    of the other rows, one of each distinct kind is shuffled.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    digests = [F.xxhash64(F.lit(n), *COLUMNS).alias(f"_h{n}") for n in (1, 2)]
    key = ["_h1", "_h2"]
    rows, first = jaccard_join.first_of_groups(docs.select("*", *digests), key)
    first = cut(first)
    ids = first.select("doc_id").unionByName(rows.where("n_shingles = 0").select("doc_id")).where("doc_id is not null")
    often = cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    if not often.take(1):
        return among(docs, ids)
    odd = among(docs, often).unionByName(docs.where("doc_id is null"))
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = odd.where(worded).groupBy(*digests).agg(F.first(F.struct(*COLUMNS)).alias("row")).join(first.select(*key), key, "left_semi").select("row.*")
    return among(docs, ids.join(often, "doc_id", "left_anti")).unionByName(one).unionByName(odd.where(~worded))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; keeps every row, repeated ones and those with a
    null id or text as well. ``n_chars`` follows the text, null for a null text."""
    found = pii.find(docs, keep=COLUMNS[1:])
    text = pii.redact(F.col("text"), F.concat("base", "added"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: every row, as often as it comes; a null or empty text
    is its end token alone."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]
#: learned models and tokenizers are beyond SQL; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again before the next."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
