"""Helpers that the operators share: reading tables, cutting lineage, sizing shuffles."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows of an Arrow batch, where the session has Spark's default: documents are long
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: sent with the job, once a context, unless the
    workers' path already has it. Batches to workers are made smaller, unless the session has
    a size of its own, for a batch of long texts is held several times over."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tablerecon_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spark-")
    sc.addPyFile(shutil.make_archive(f"{folder}/tablerecon", "zip", root, "tablerecon"))
    sc._tablerecon_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Only a local session that names
    none gets a temporary one; on a cluster other machines could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read again: lost executors recompute
    nothing above it, and loops of joins plan from bare tables."""
    return stored(df, "cut")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def passed_on(docs: DataFrame, keep: list[str]) -> tuple[list, str]:
    """Columns ``keep`` of ``docs`` for a map over batches, and their part of its schema."""
    return [F.col(c) for c in keep], "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


def id_remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``: the split of the learned operators."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def pieces_for(n_bytes: float, at_most: float, least: int = 8) -> int:
    """How many shuffle groups keep one group under ``at_most`` bytes."""
    return max(least, int(n_bytes / at_most) + 1)


#: bytes of one bitmap of 32,768 neighbouring ids
BITMAP_BYTES = 4096


def among(rows: DataFrame, ids: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The rows whose whole-number ``doc_id`` is among those of ``ids``; null ids are not.
    Repeated rows stay as they are, repeated ids count once.

    The ids become bitmaps, a bit each where ids are dense, so that texts need not be shuffled.
    They are broadcast only if all of them take at most ``most_bytes``; else it is a semi-join.
    """
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    bits = cut(ids.groupBy(F.bitmap_bucket_number("doc_id").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("_bits")))
    if bits.count() * BITMAP_BYTES > most_bytes:
        return rows.join(ids, "doc_id", "left_semi")
    place = F.bitmap_bit_position(F.col("doc_id").cast("long"))
    found = rows.withColumns({"_bucket": F.bitmap_bucket_number(F.col("doc_id").cast("long")), "_place": place.cast("int")}).join(F.broadcast(bits), "_bucket")
    byte = "cast(conv(hex(substring(_bits, shiftright(_place, 3) + 1, 1)), 16, 10) as int)"
    return found.where(f"shiftright({byte}, _place & 7) & 1 = 1").select(*rows.columns)
