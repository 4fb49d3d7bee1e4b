"""The whole run with its gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import expected as expected_rows
from ..operators import compare, digests, rules, schema_check
from ..sources import files, io

SUMMARY = (
    "contract string, contract_version string, environment string, target_count long, source_count long, mismatch_count long, "
    "validation_rule_failures long, schema_errors long, final_status string, timestamp string"
)
#: file findings of which a run keeps the messages; ``Run.findings`` counts all
MOST_ERRORS = 100


@dataclass
class Run:
    status: str
    stopped_at: str | None
    summary: DataFrame
    errors: list[str] = field(default_factory=list)
    rows: DataFrame | None = None
    findings: int = 0


class _Gates:
    """What has failed so far; ``closed`` after the first failure, if gates stop the run."""

    def __init__(self, stop: bool):
        self.stop, self.failed = stop, []

    def check(self, name: str, bad: bool) -> None:
        if bad:
            self.failed.append(name)

    @property
    def closed(self) -> bool:
        return bool(self.failed) and self.stop


def _after_load(gates: _Gates, got: dict[str, int], contract, expected: DataFrame, target: DataFrame | None, order: tuple[list[str], list[str]], errors: list[str]) -> DataFrame | None:
    """Schema (with nulls and keys, told from the rows), count and comparison of a target with
    the expected rows. The target is read once for nulls, keys and count, and the comparison
    starts only if they are in order. Sides of as many rows, without a key that comes twice, are
    held against each other by digest first; only if these differ are their rows joined."""
    own = schema_check.schema_errors(target, contract)
    facts = None
    if target is not None and {c.name for c in contract.columns} <= set(target.columns):
        facts = schema_check.live_facts(target, contract).first()
        own += schema_check.data_errors(facts, contract)
    errors += own
    got["schema_errors"] = len(own)
    gates.check("schema", bool(own))
    if gates.closed or facts is None or set(target.columns) != {c.name for c in contract.columns}:
        return None
    got["target_count"] = facts["rows"]
    gates.check("count", facts["rows"] != contract.metadata.get("expected_row_count", got["source_count"]))
    if gates.closed:
        return None
    rows = compare.joined(expected, target, contract, order, counted=True)
    alike = facts["rows"] == got["source_count"] and not facts["duplicate_keys"] and digests.same(expected, target, contract)
    got["mismatch_count"] = 0 if alike else compare.counts(rows).first()["mismatch_count"]
    gates.check("compare", got["mismatch_count"] > 0)
    return rows


def _finish(spark: SparkSession, contract, gates: _Gates, got: dict[str, int], errors: list[str], rows: DataFrame | None, environment: str, timestamp: str, findings: int) -> Run:
    status = "FAIL" if gates.failed else "PASS"
    order = ("target_count", "source_count", "mismatch_count", "validation_rule_failures", "schema_errors")
    values = (contract.name, contract.version, environment, *[int(got[k]) for k in order], status, timestamp)
    return Run(status, gates.failed[0] if gates.failed else None, spark.createDataFrame([values], SUMMARY), errors, rows, findings)


def _nothing() -> dict[str, int]:
    return {"target_count": 0, "source_count": 0, "mismatch_count": 0, "validation_rule_failures": 0, "schema_errors": 0}


def _rules(gates: _Gates, got: dict[str, int], contract, feed: DataFrame) -> None:
    bad = rules.failing_counts(feed, contract)
    got["validation_rule_failures"] = sum(n for _, n in bad.values())
    gates.check("rules", bool(bad))


def _carried(contract, order: list[str]) -> list[str]:
    return [c for c in order if c not in {x.name for x in contract.columns}]


def reconcile(contract, feed: DataFrame, target: DataFrame | None, feed_order: list[str], target_order: list[str], environment: str = "test", timestamp: str = "1970-01-01T00:00:00", file_errors: list[str] | None = None, stop_at_gates: bool = True) -> Run:
    """A feed and a target that are there already: file findings (from the caller), rules,
    schema, count, comparison. The first failing gate stops the run unless told otherwise, and
    the summary is made in any case. Only counts reach the driver."""
    gates, got, errors, rows = _Gates(stop_at_gates), _nothing(), list(file_errors or []), None
    got["source_count"] = feed.count()
    gates.check("files", bool(errors))
    if not gates.closed:
        _rules(gates, got, contract, feed)
    if not gates.closed:
        expected = expected_rows(feed, contract, carry=_carried(contract, feed_order))
        rows = _after_load(gates, got, contract, expected, target, (feed_order, target_order), errors)
    return _finish(feed.sparkSession, contract, gates, got, errors, rows, environment, timestamp, len(errors))


def run(spark: SparkSession, contract, feed_path: str, target_path: str, load: bool = True, read_only: bool = False, environment: str = "test", timestamp: str = "1970-01-01T00:00:00", stop_at_gates: bool = True) -> Run:
    """From feed files to a verdict: header and metadata checks, declared totals, rules, load of the expected
    rows into ``target_path`` (with ``load``; else what is there is checked), schema with nulls
    and keys, count, comparison. The first failing gate stops the run, so nothing is loaded from
    a feed that failed before; the summary is made in any case. The file checks count the feed's
    rows and tell whether records run over lines, which the feed is then read for.

    Rows of one key that occur more than once are taken in file order, target rows by all of
    their columns.
    """
    gates, got, rows = _Gates(stop_at_gates), _nothing(), None
    found = files.check_files(spark, feed_path, contract, MOST_ERRORS)
    errors = list(found.messages)
    gates.check("files", found.n > 0)
    feed = files.with_order(files.read_feed(spark, feed_path, contract, multi_line=found.broken > 0), "__order")
    if contract.metadata.get("control_totals") and not gates.closed:
        errors += [r["message"] for r in files.control_total_errors(feed, contract).collect()]  # a row a total
        gates.check("totals", len(errors) > len(found.messages))
    if not gates.closed:
        got["source_count"] = feed.count() if found.n else found.rows
        _rules(gates, got, contract, feed)
    if not gates.closed:
        expected = expected_rows(feed, contract, carry=["__order"])
        if load:
            io.load_expected(expected.drop("__order"), contract, target_path, read_only)
        target = _read_or_none(spark, contract, target_path)
        order = (["__order"], [c for c in target.columns] if target is not None else [])
        rows = _after_load(gates, got, contract, expected, target, order, errors)
    return _finish(spark, contract, gates, got, errors, rows, environment, timestamp, found.n + len(errors) - len(found.messages))


def _read_or_none(spark: SparkSession, contract, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def stage_of(run_: Run) -> DataFrame:
    """The summary with the gate that stopped the run, if any."""
    return run_.summary.withColumn("stopped_at", F.lit(run_.stopped_at).cast("string"))
