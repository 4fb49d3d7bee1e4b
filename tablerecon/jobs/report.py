"""What a run's exceptions say: layers, clusters, aggregates, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import compare


def failure_layers(rows: DataFrame, rule_report: DataFrame, contract, file_checks: DataFrame | None = None, schema_errors: list[str] | None = None) -> DataFrame:
    """Failures by likely layer: file checks are extract, rules are source data, schema errors
    target schema, keys are load, transformed columns transform, other cells load. One pass over
    the comparison."""
    derived = [c.name for c in contract.columns if c.transform]
    one = F.lit(1).cast("long").alias("n")
    parts = rule_report.select(F.lit("source data").alias("layer"), F.col("failing_rows").alias("n"))
    # a row that is missing or extra has no cells: it stands as one without a column
    cells = rows.select(F.inline_outer("diffs"), "kind").where("kind <> 'matched' or column is not null")
    parts = parts.unionByName(cells.select(F.when(F.col("column").isin(derived), "transform").otherwise("load").alias("layer"), one))
    if file_checks is not None:
        parts = parts.unionByName(file_checks.select(F.lit("extract").alias("layer"), one))
    if schema_errors:
        found = [("target schema", len(schema_errors))]
        parts = parts.unionByName(rows.sparkSession.createDataFrame(found, "layer string, n long"))
    return parts.groupBy("layer").agg(F.sum("n").alias("failures"))


def difference_kind():
    e, a = F.col("expected"), F.col("actual")
    return (
        F.when(e.isNull() | a.isNull(), "null-vs-value").when(F.lower(e) == F.lower(a), "case-only")
        .when(F.regexp_replace(e, r"\s", "") == F.regexp_replace(a, r"\s", ""), "whitespace-only")
        .when(e.try_cast("decimal(38,10)").isNotNull() & a.try_cast("decimal(38,10)").isNotNull(), "numeric-delta").otherwise("other")
    )


def mismatch_clusters(rows: DataFrame, contract) -> DataFrame:
    """Differing cells by column and kind, with the smallest key as an example."""
    d = compare.diffs(rows, contract).withColumn("kind", difference_kind())
    return d.groupBy("column", "kind").agg(F.count("*").alias("cells"), F.min(contract.keys[0]).alias("example"))


def batch_aggregates(expected: DataFrame, actual: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Each metric (name -> SQL aggregate) on both sides, as text, and whether they agree."""
    side = lambda df, name: df.agg(*[F.expr(e).cast("string").alias(m) for m, e in metrics.items()]).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])))
    return side(expected, "expected").join(side(actual, "actual"), "metric").withColumn("agrees", F.col("expected").eqNullSafe(F.col("actual")))


def trend(history: DataFrame) -> DataFrame:
    """Each run's mismatches beside those of the run before, per contract and environment."""
    w = Window.partitionBy("contract", "environment").orderBy("timestamp")
    return history.withColumn("before", F.lag("mismatch_count").over(w)).withColumn("change", F.col("mismatch_count") - F.col("before"))
