"""Targets: reading, describing, loading, and the run's own records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages
from ..functions.values import normalize, strip


@dataclass(frozen=True)
class Split:
    """How a JDBC table is read in parts: by ranges of a numeric or date column."""

    column: str
    lower: object
    upper: object
    parts: int


def read_target(spark: SparkSession, contract, table: str | None = None, path: str | None = None, jdbc: dict | None = None, split: Split | None = None) -> DataFrame:
    """The target's columns in contract order, from a catalog table, files or JDBC (``jdbc``:
    Spark's options; with ``split`` the parts are read at once, else by one task). Columns that
    the target lacks are left out, for the schema check to name."""
    if jdbc is not None:
        reader = spark.read.format("jdbc").options(**jdbc)
        if split is not None:
            reader = reader.option("partitionColumn", split.column).option("lowerBound", str(split.lower)).option("upperBound", str(split.upper)).option("numPartitions", split.parts)
        df = reader.load()
    else:
        df = spark.read.parquet(path) if path else spark.read.table(table or contract.table)
    own = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(own[c.name.lower()]).alias(c.name) for c in contract.columns if c.name.lower() in own])


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """A read-only statement with bound parameters (``:name``) and tables (``{name}``). It runs
    as a subquery, in which Spark's grammar has no commands and no inserts, so anything but a
    query is an error before it does something."""
    return spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)", args=args, **(tables or {}))


def describe(df: DataFrame) -> DataFrame:
    """``position, name, type, nullable`` of every column; schema facts only, nothing is read."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def profile(df: DataFrame) -> DataFrame:
    """``describe`` with ``n_rows`` and ``n_nulls`` of every column; one pass."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count("*").alias("n_rows"), *nulls)
    facts = []
    for i, f in enumerate(df.schema.fields):
        facts.append(F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n_rows"), F.col(f"n{i}").alias("n_nulls")))
    return row.select(F.inline(F.array(*facts)))


def typed(expected: DataFrame, contract) -> DataFrame:
    """The expected table with the contract's types; strings keep their blanks, blank is null,
    unreadable values are null (they have failed a rule before)."""
    out = []
    for c in contract.columns:
        x = F.col(c.name)
        value = F.when(strip(x) != "", x) if c.type == "string" else normalize(x, c).typed.cast(c.sql_type)
        out.append(value.alias(c.name))
    return expected.select(*out)


def _refuse(read_only: bool) -> None:
    if read_only:
        raise PermissionError(messages.READ_ONLY)


def load_expected(expected: DataFrame, contract, path: str, read_only: bool = False) -> int:
    """Overwrites ``path`` with the typed rows and counts them there; a second run leaves the
    same table. A read-only session is refused, as is a path that the rows are read from."""
    _refuse(read_only)
    if any(f.removeprefix("file://").startswith(path.removeprefix("file://").rstrip("/") + "/") for f in expected.inputFiles()):
        raise ValueError(f"the expected rows are read from {path} itself")
    typed(expected, contract).write.mode("overwrite").parquet(path)
    return expected.sparkSession.read.parquet(path).count()


def load_table(expected: DataFrame, contract, read_only: bool = False) -> int:
    """The same into the contract's catalog table, created by its DDL if absent."""
    _refuse(read_only)
    spark = expected.sparkSession
    spark.sql(contract.ddl())
    typed(expected, contract).write.insertInto(contract.table, overwrite=True)
    return spark.read.table(contract.table).count()


def write_summary(summary: DataFrame, path: str) -> None:
    """The one-row summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def append_history(summary: DataFrame, path: str, run_id: str, commit: str = "", user: str = "") -> None:
    """Adds the summary to the run history, with the run's id, commit and user, by day."""
    named = summary.withColumns({"run_id": F.lit(run_id), "commit": F.lit(commit), "user": F.lit(user)})
    named.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").parquet(path)
