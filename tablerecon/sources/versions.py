"""Loads that are there in full or not at all, run records that can be replayed, and feeds that
are read by increments."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import _refuse, typed
from .records import _named

VERSIONS = "run_id string, version long, rows long"
MANIFEST = "file string, length long, modified timestamp, batch string"


def _read_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of files, or an empty one where nothing has been written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def load_version(expected: DataFrame, contract, base: str, run_id: str, read_only: bool = False) -> int:
    """The typed rows as a new version under ``base``: written beside the others, counted there,
    and only then named the current one, by a row in a table of versions. A load that is broken
    off leaves the version before; a run that has its version already loads nothing and gives
    its count."""
    _refuse(read_only)
    spark = expected.sparkSession
    known = _read_or(spark, f"{base}/versions", VERSIONS)
    done = known.where(F.col("run_id") == run_id).first()
    if done:
        return done["rows"]
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    rows = typed(expected, contract)
    path = f"{base}/data/{version}-{hashlib.sha256(run_id.encode()).hexdigest()[:16]}"
    rows.write.mode("overwrite").parquet(path)  # what a broken-off try of this run left
    n = spark.read.parquet(path).count()
    if n != expected.count():
        raise RuntimeError(f"{path}: {n} rows are there of the expected ones")
    spark.createDataFrame([(run_id, version, n)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{base}/versions")
    return n


def read_version(spark: SparkSession, base: str, run_id: str | None = None) -> DataFrame | None:
    """The current version under ``base``, or that of a run; None if there is none."""
    known = _read_or(spark, f"{base}/versions", VERSIONS)
    if run_id is not None:
        known = known.where(F.col("run_id") == run_id)
    row = known.orderBy(F.desc("version")).first()
    if row is None:
        return None
    return spark.read.parquet(f"{base}/data/{row['version']}-{hashlib.sha256(row['run_id'].encode()).hexdigest()[:16]}")


def load_jdbc(expected: DataFrame, contract, options: dict[str, str], staging: str, read_only: bool = False) -> int:
    """The typed rows into a JDBC table (``options``: Spark's, with ``dbtable``): written to a
    staging table by all tasks, counted there, then moved within one transaction, so that readers
    see the old rows or the new ones. The target must exist; its rows are replaced."""
    _refuse(read_only)
    spark = expected.sparkSession
    rows = typed(expected, contract)
    target = options["dbtable"]
    rows.write.format("jdbc").options(**{**options, "dbtable": staging}).mode("overwrite").save()
    n = spark.read.format("jdbc").options(**{**options, "dbtable": staging}).load().count()
    if n != expected.count():
        raise RuntimeError(f"{staging}: {n} rows are there of the expected ones")
    columns = ", ".join(f'"{c.name}"' for c in contract.columns)
    jvm = spark.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            properties.setProperty(k, options[k])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            statement.executeUpdate(f"DELETE FROM {target}")
            statement.executeUpdate(f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {staging}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            statement.close()
    finally:
        connection.close()
    return n


def contract_digest(contract) -> str:
    """One text for all that a contract says."""
    said = {"name": contract.name, "version": contract.version, "table": contract.table, "keys": contract.keys, "columns": [vars(c) for c in contract.columns], "source": contract.source, "metadata": contract.metadata}
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()


def record_run(summary: DataFrame, differences: DataFrame | None, contract, path: str, run_id: str, commit: str = "", user: str = "") -> None:
    """A run's summary and differences, under its id with the contract's digest. Recording a run
    again replaces its own records and leaves all others, so a replay changes nothing."""
    named = {"run_id": F.lit(run_id), "commit": F.lit(commit), "user": F.lit(user), "contract_digest": F.lit(contract_digest(contract))}
    for rows, name in ((summary.withColumns(named), "runs"), (differences, "differences")):
        if rows is not None:
            kept = rows.withColumn("run", F.lit(run_id))
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{name}")


def increment(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """``file, length, modified, state``: files under ``path`` that are new, or changed in length
    or time, against the manifest. Empty files are not told."""
    now = spark.read.format("binaryFile").load(path).select(_named("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    seen = _read_or(spark, manifest, MANIFEST).groupBy("file").agg(F.max_by(F.struct("length", "modified"), "modified").alias("seen"))
    state = F.when(F.col("seen").isNull(), "new").when(F.struct("length", "modified") != F.col("seen"), "changed")
    return now.join(seen, "file", "left").withColumn("state", state).where("state is not null").select("file", "length", "modified", "state")


def take(spark: SparkSession, found: DataFrame, manifest: str, batch: str) -> None:
    """Enters files of an increment into the manifest, once they have been dealt with; a batch
    that is entered already is left as it is."""
    known = _read_or(spark, manifest, MANIFEST).where(F.col("batch") == batch).select("file").distinct()
    rows = found.select("file", "length", "modified", F.lit(batch).alias("batch")).join(known, "file", "left_anti")
    rows.coalesce(1).write.mode("append").parquet(manifest)  # a row a file
