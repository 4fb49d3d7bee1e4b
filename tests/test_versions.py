"""Loads in full or not at all, run records, increments, declared totals."""

import os

import pytest
from pyspark.sql import functions as F

from tablerecon import contract as contracts
from tablerecon.jobs import pipeline
from tablerecon.sources import files, versions

SPEC = {
    "contract_name": "v", "version": "1", "source": {"columns": ["id", "n"]}, "target": {"table": "v"}, "keys": ["id"],
    "columns": [{"name": "id", "source_name": "id", "type": "integer", "nullable": False}, {"name": "n", "source_name": "n", "type": "integer", "nullable": True}],
}
C = contracts.load(SPEC)


def rows(spark, n):
    return spark.range(n).select(F.col("id").cast("string"), (F.col("id") * 2).cast("string").alias("n"))


def test_a_broken_load_leaves_the_old_target(spark, tmp_path):
    base = str(tmp_path / "t")
    assert versions.read_version(spark, base) is None
    assert [versions.load_version(rows(spark, n), C, base, run) for n, run in ((10, "a"), (20, "b"), (99, "a"))] == [10, 20, 10]
    lost = rows(spark, 30).withColumn("n", F.when(F.col("id") == "29", F.raise_error(F.lit("executor lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="executor lost"):
        versions.load_version(lost, C, base, "c")
    assert versions.read_version(spark, base).count() == 20 and versions.read_version(spark, base, "a").count() == 10
    assert versions.load_version(rows(spark, 30), C, base, "c") == 30 and versions.read_version(spark, base).count() == 30
    with pytest.raises(PermissionError):
        versions.load_version(rows(spark, 1), C, base, "d", read_only=True)


def test_jdbc_load_is_one_transaction(spark):
    options = {"url": "jdbc:derby:memory:versions;create=true", "dbtable": "live", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows(spark, 5).select(F.col("id").cast("long"), F.col("n").cast("long")).write.format("jdbc").options(**options).mode("overwrite").save()
    live = lambda: spark.read.format("jdbc").options(**options).load()
    assert [versions.load_jdbc(rows(spark, 40), C, options, "stage") for _ in range(2)] == [40, 40] and live().count() == 40
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(options["url"])
    connection.createStatement().executeUpdate('ALTER TABLE live ADD CONSTRAINT few CHECK ("n" < 100)')
    connection.close()
    with pytest.raises(Exception, match="FEW|constraint"):
        versions.load_jdbc(rows(spark, 60), C, options, "stage")
    assert live().count() == 40  # what was deleted in the transaction is there again


def test_recording_a_run_again_changes_nothing(spark, tmp_path):
    summary = spark.createDataFrame([("v", 3)], "contract string, mismatch_count long")
    found = spark.createDataFrame([("1", "n", "2", "3")], "id string, column string, expected string, actual string")
    for run in ("r1", "r2", "r1"):
        versions.record_run(summary, found, C, str(tmp_path / "h"), run)
    got = spark.read.parquet(str(tmp_path / "h/runs")).orderBy("run_id").collect()
    assert [(r["run_id"], r["mismatch_count"]) for r in got] == [("r1", 3), ("r2", 3)] and len({r["contract_digest"] for r in got}) == 1
    assert spark.read.parquet(str(tmp_path / "h/differences")).count() == 2
    assert versions.contract_digest(contracts.load({**SPEC, "version": "2"})) != versions.contract_digest(C)


def test_increments(spark, tmp_path):
    folder, manifest = tmp_path / "f", str(tmp_path / "m")
    folder.mkdir()
    state = lambda: {r["file"].rsplit("/", 1)[1]: r["state"] for r in versions.increment(spark, str(folder), manifest).collect()}
    (folder / "a.csv").write_text("1\n"), (folder / "b.csv").write_text("1\n")
    assert state() == {"a.csv": "new", "b.csv": "new"}
    for _ in range(2):  # a batch that is entered again adds nothing
        versions.take(spark, versions.increment(spark, str(folder), manifest), manifest, "one")
    assert state() == {} and spark.read.parquet(manifest).count() == 2
    (folder / "a.csv").write_text("1\n2\n"), (folder / "c.csv").write_text("1\n")
    os.utime(folder / "a.csv", (2e9, 2e9))
    assert state() == {"a.csv": "changed", "c.csv": "new"}


def test_control_totals(spark, tmp_path):
    feed = spark.createDataFrame([("1", "0.1"), ("2", "0.20"), ("3", "x"), ("4", None)], "id string, n string")
    of = lambda **t: contracts.load({**SPEC, "metadata": {"control_totals": [{"column": "n", **t}]}})
    told = lambda c: [r["message"] for r in files.control_total_errors(feed, c).collect()]
    assert told(of(sum="0.3", count=2, min="0.1", max="0.2")) == [] == told(C)
    assert told(of(sum="0.30000001", count=3)) == ["control total n sum: expected 0.30000001, got 0.3", "control total n count: expected 3, got 2"]
    path = tmp_path / "x.csv"
    path.write_text("id,n\n1,10\n2,20\n")
    run = lambda total: pipeline.run(spark, contracts.load({**SPEC, "metadata": {"control_totals": [{"column": "n", "sum": total}]}}), str(path), str(tmp_path / "t"))
    assert (run(31).stopped_at, run(31).errors, run(31).findings) == ("totals", ["control total n sum: expected 31, got 30"], 1)
    assert run(30).status == "PASS"


def test_quoted_breaks_pass_the_whole_run(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,n\n1,"1\n"\n2,2\n')
    run = pipeline.run(spark, C, str(path), str(tmp_path / "t"))
    assert (run.status, run.findings, run.summary.first()["source_count"]) == ("PASS", 0, 2)


def test_keys_and_nulls_stop_a_run(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,n\n1,1\n2,2\n")
    for live, message in (("values (1, 1), (2, 2), (2, 2)", "primary key mismatch: expected ['id'], got []"), ("values (1, 1), (null, 2)", "column 'id' nullability mismatch: expected nullable=False, got True")):
        spark.sql(f"select cast(col1 as bigint) id, cast(col2 as bigint) n from {live}").write.mode("overwrite").parquet(str(tmp_path / "t"))
        run = pipeline.run(spark, C, str(tmp_path / "x.csv"), str(tmp_path / "t"), load=False)
        assert run.stopped_at == "schema" and message in run.errors and run.summary.first()["target_count"] == 0
