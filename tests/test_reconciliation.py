"""Golden facts, edge values, plans and invariants of the reconciliation library."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablerecon import contract as contracts
from tablerecon.functions.transforms import expected
from tablerecon.functions.values import normalize, readable
from tablerecon.jobs import demo, pipeline
from tablerecon.operators import compare, rules, schema_check
from tablerecon.sources import files, io

CUSTOMER = {
    "contract_name": "customer", "version": "1.0", "source": {"columns": ["id", "first", "last", "email", "balance", "status"]}, "target": {"table": "customer"}, "keys": ["id"],
    "columns": [
        {"name": "id", "source_name": "id", "type": "integer", "nullable": False, "unique": True}, {"name": "name", "type": "string", "nullable": False, "transform": "{first} {last}"},
        {"name": "email", "type": "string", "nullable": False, "regex": "^x", "transform": "lower({email})"}, {"name": "balance", "source_name": "balance", "type": "decimal", "nullable": False, "range": [0, 1000], "transform": "round({balance}, 2)"},
        {"name": "status", "source_name": "status", "type": "string", "nullable": False, "allowed_values": ["active", "inactive"]},
    ],
}
C = contracts.load(CUSTOMER)
ROWS = [(str(i), f"F{i}", f"L{i}", f"User{i}@Example.COM", f"{i}.0050", "active", i) for i in range(1, 21)]
KIND = "id string, first string, last string, email string, balance string, status string, seq long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def clean(spark):
    feed = spark.createDataFrame(ROWS, KIND)
    return feed, io.typed(expected(feed, C), C)


def test_clean_feed_passes(spark):
    feed, target = clean(spark)
    run = pipeline.reconcile(C, feed, target, ["seq"], ["id"])
    assert run.status == "PASS" and run.summary.first()["mismatch_count"] == 0
    assert rules.report(feed, C, ["seq"]).count() == 0
    assert str(target.where("id = 7").first()["balance"]) == "7.01"


def test_seeded_defects(spark):
    bad = [list(r) for r in ROWS]
    bad[4][3], bad[6][4], bad[8][5], bad[10][0], bad[12][0] = " ", "-50.00", "unknown", "abc", "12"
    got = {r["rule_id"]: (r["failing_rows"], r["samples"]) for r in rules.report(spark.createDataFrame(bad, KIND), C, ["seq"]).collect()}
    assert got == {"transform_input_not_null:email": (1, ["5"]), "range:balance": (1, ["7"]), "allowed_values:status": (1, ["9"]), "type:id": (1, ["abc"]), "unique:id": (2, ["12", "12"])}


def test_missing_row_and_changed_cell(spark):
    feed, target = clean(spark)
    rows = compare.joined(expected(feed, C, ["seq"]), target.where("id <> 5").selectExpr("id", "name", "case when id = 7 then upper(email) else email end as email", "balance", "status"), C, (["seq"], ["id"]))
    assert rows_of(compare.missing(rows, C)) == [("5",)]
    assert rows_of(compare.transform_diffs(rows, C)) == [("7", "email", "user7@example.com", "USER7@EXAMPLE.COM")]


def test_unreadable_is_not_null(spark):
    c = contracts.load({**CUSTOMER, "columns": [CUSTOMER["columns"][0], {"name": "n", "source_name": "balance", "type": "decimal", "nullable": True}]})
    e = spark.createDataFrame([("1", "bad", 1), ("2", "bad", 2), ("3", "bad", 3), ("x", "1", 4), ("", "1", 5)], "id string, n string, seq long")
    a = spark.createDataFrame([("1", None, 1), ("2", "bad", 2), ("3", "worse", 3), ("x", "1.00", 4), (None, "1", 5)], "id string, n string, seq long")
    rows = compare.joined(e, a, c, (["seq"], ["seq"]))
    assert rows_of(compare.diffs(rows, c)) == [("1", "n", "bad", None), ("3", "n", "bad", "worse")]
    assert rows.where("kind <> 'matched'").count() == 0


def test_comparison_exchanges(spark):
    feed, target = clean(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [compare.joined(expected(feed, C, ["seq"]), target, C, (["seq"], ["id"]), counted=x)._jdf.queryExecution().executedPlan().toString() for x in (False, True)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [plan.count("Exchange hashpartitioning") for plan in plans] == [2, 2]


@pytest.mark.parametrize(
    ("kind", "text", "typed", "strict"),
    [
        ("integer", " 12 ", 12, True), ("integer", "+5", 5, True), ("integer", "12.7", 12, False), ("integer", "-12.7", -12, False), ("integer", "abc", None, False), ("integer", "12.0", 12, False),
        ("integer", "12.99999999999", 12, False), ("integer", "1_000", 1000, True), ("integer", "1e3", 1000, False), ("integer", "", None, False), ("integer", "9" * 30, None, True),
        ("decimal", "2.675", "2.68", True), ("decimal", "1.005", "1.01", True), ("decimal", "-0.005", "-0.01", True), ("decimal", "1e3", "1000.00", True), ("decimal", "1" * 23, "1" * 23 + ".00", True), ("decimal", "1" * 30 + ".125", "1" * 30 + ".13", True), ("decimal", "NaN", None, False), ("decimal", "Infinity", None, False), ("date", "2024-1-2", dt.date(2024, 1, 2), True), ("date", "2024-02-30", None, False), ("date", "24-01-02", None, False),
        ("timestamp", "2024-01-02  10:01:00", dt.datetime(2024, 1, 2, 10, 1), True), ("timestamp", "2024-01-02 10:01:00.25", dt.datetime(2024, 1, 2, 10, 1, 0, 250000), False), ("boolean", "TRUE", True, True), ("boolean", "yes", True, False), ("boolean", "maybe", False, False), ("string", "\t x \n", "x", True),
    ],
)
def test_values(spark, kind, text, typed, strict):
    spec = contracts.Column("x", kind, True)
    from pyspark.sql import functions as F

    v = normalize(F.col("x"), spec)
    got = spark.createDataFrame([(text,)], "x string").select(v.typed.alias("t"), readable(F.col("x"), spec).alias("s")).first()
    assert (str(got["t"]) if kind == "decimal" and got["t"] is not None else got["t"]) == typed and bool(got["s"]) == strict


def test_nan_text_is_not_null(spark):
    from pyspark.sql import functions as F

    spec = contracts.Column("x", "decimal", True)
    text, number = (normalize(F.col(c), spec) for c in ("t", "n"))
    got = spark.createDataFrame([("NaN", float("nan"))], "t string, n double").select(text.raw.alias("a"), text.typed.alias("b"), number.raw.alias("c"), number.typed.alias("d")).first()
    assert tuple(got) == ("NaN", None, None, None)


def test_declared_date_format_only(spark):
    from pyspark.sql import functions as F

    spec = contracts.Column("x", "date", True, date_format="%d/%m/%Y")
    text, day = normalize(F.col("t"), spec), normalize(F.col("d"), spec)
    df = spark.createDataFrame([("02/01/2024", dt.date(2024, 1, 2)), ("2024-01-02", None)], "t string, d date")
    assert [tuple(r) for r in df.select(text.typed, text.raw, day.typed).collect()] == [(dt.date(2024, 1, 2), None, dt.date(2024, 1, 2)), (None, "2024-01-02", None)]


def test_range_beyond_one_scale(spark):
    from pyspark.sql import functions as F

    from tablerecon.functions.values import in_range

    cases = {"5": True, "1" + "0" * 22: False, "-1" + "0" * 22: False, "100.0000000001": False, "1e30": False, "9" * 44: False, "abc": None, "NaN": None, "1_0": True}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.ok for r in df.select("x", in_range(F.col("x"), 0, 100).alias("ok")).collect()} == cases
    feed = spark.createDataFrame([(*ROWS[0][:4], "1" + "0" * 22, "active", 1)], KIND)
    assert [r.rule_id for r in rules.report(feed, C, ["seq"]).collect()] == ["range:balance"]


def test_feed_values_are_never_calls(spark):
    feed = spark.createDataFrame([("1", "upper(x)", "a,b", "round(1)", "1", "active", 1)], KIND)
    assert expected(feed, C).first()["name"] == "upper(x) a,b"


@pytest.mark.parametrize("change", [{"keys": ["nope"]}, {"version": ""}, {"columns": [{"name": "a", "type": "money", "nullable": True, "source_name": "id"}]}, {"columns": [{"name": "id", "type": "string", "nullable": True, "transform": "shout({id})"}]}, {"columns": [{"name": "id", "type": "string", "nullable": True, "source_name": "zz"}]}])
def test_bad_contracts(change):
    with pytest.raises(ValueError):
        contracts.load({**CUSTOMER, **change})


def test_files_and_load(spark, tmp_path):
    feed, target = clean(spark)
    (tmp_path / "bad.csv").write_text("id,first,last,email_address,balance,status\n1,a,b,c,2,active\n")
    assert [r["message"] for r in files.header_errors(spark, str(tmp_path / "bad.csv"), C).collect()] == ["header column 4: expected 'email', got 'email_address'"]
    assert files.row_count_check(feed.limit(19), 20).first()["message"] == "row count: expected 20, got 19"
    assert files.row_count_check(feed.limit(0), 20).first()["message"] == "row count: expected 20, got 0"
    assert [io.load_expected(expected(feed, C), C, str(tmp_path / "t")) for _ in range(2)] == [20, 20]
    assert schema_check.schema_errors(spark.read.parquet(str(tmp_path / "t")), C) == []
    assert schema_check.schema_errors(None, C) == ["table customer does not exist"]


FAST = [
    "recon_counts", "mismatch_detail", "column_diffs", "dq_report", "dq_samples", "composite_key_compare", "row_hash_compare", "full_reconciliation", "normalize_edges", "range_edges", "normalize_blank",
    "normalize_timestamp", "transform_round", "transform_strip", "schema_errors", "ragged_errors", "row_count_errors", "feed_files", "encoding_declared", "gate_pass", "gate_schema",
]


@pytest.mark.parametrize("name", FAST)
def test_against_duckdb(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "events"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = demo.QUERIES[name](spark, d).toPandas(), con.sql(demo.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    flat = lambda x: sorted(tuple("~" if pd.isna(v) else str(v) for v in r) for r in x[cols].astype(object).values.tolist())
    assert cols == sorted(want.columns) and flat(got) == flat(want)


HEADER = "id,first,last,email,balance,status"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def shape(df):
    return sorted(((r["check"], r["position"], r["message"]) for r in df.collect()), key=str)


def test_header_checks(spark, tmp_path):
    assert shape(files.header_errors(spark, write(tmp_path / "a.csv", ""), C))[0] == ("header_count", 0, "header column count: expected 6, got 0")
    assert shape(files.header_errors(spark, write(tmp_path / "b.csv", '"id","first","last","email","balance","status"\n1,2,3,4,5,6\n'), C)) == []
    piped = contracts.load({**CUSTOMER, "source": {**CUSTOMER["source"], "delimiter": "|"}})
    assert shape(files.header_errors(spark, write(tmp_path / "c.csv", '"a|b"|first|last|email|balance|status\n'), piped)) == [("header_name", 1, "header column 1: expected 'id', got 'a|b'")]
    two = tmp_path / "two"
    two.mkdir()
    write(two / "x.csv", HEADER + "\n"), write(two / "y.csv", HEADER.replace("last", "surname") + "\n")
    assert [r["file"].rsplit("/", 1)[1] for r in files.header_errors(spark, str(two), C).collect()] == ["y.csv"]


def test_metadata_checks(spark, tmp_path):
    c = contracts.load({**CUSTOMER, "metadata": {"expected_row_count": 3}})
    row = "1,a,b,c,2,active"
    ok = write(tmp_path / "ok.csv", "\n".join([HEADER, row, '2,"a,x",b,c,2,active', row]) + "\n")
    assert shape(files.metadata_errors(spark, ok, c)) == []
    assert shape(files.metadata_errors(spark, write(tmp_path / "empty.csv", ""), c)) == [("empty", 0, "file is empty")]
    assert shape(files.metadata_errors(spark, write(tmp_path / "header.csv", HEADER + "\n"), c)) == [("row_count", 0, "row count: expected 3, got 0")]
    bad = [HEADER, row, "1,2", row, "1,2,3,4,5,6,7", "", *["x"] * 5]
    got = shape(files.metadata_errors(spark, write(tmp_path / "ragged.csv", "\n".join(bad) + "\n"), c))
    assert got == [("ragged", 3, "ragged rows (col count != 6) at lines [3, 5, 6, 7, 8]"), ("row_count", 10, "row count: expected 3, got 10")]
    assert [r["number"] for r in files.ragged_rows(spark, str(tmp_path / "ragged.csv"), c).orderBy("number").collect()] == [3, 5, 6, 7, 8, 9, 10, 11]


def test_ragged_numbers_over_splits(spark, tmp_path):
    lines = [HEADER, *["1,a,b,c,2,active"] * 4000]
    for i in (7, 1500, 3999):
        lines[i] = "x"
    path = write(tmp_path / "long.csv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert [r["number"] for r in files.ragged_rows(spark, path, C).orderBy("number").collect()] == [8, 1501, 4000]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("declared", "written", "text", "bad"), [("utf-8", "utf-8", "é", 0), ("utf-8", "latin-1", "é", 1), ("latin-1", "latin-1", "é", 0), ("ascii", "utf-8", "é", 1), ("ascii", "utf-8", "e", 0), ("cp1252", "utf-8", "\u0441", 1), ("utf-16", "utf-16", "é", 0), ("utf-16", "utf-8", "éab", 1)])
def test_encodings(spark, tmp_path, declared, written, text, bad):
    c = contracts.load({**CUSTOMER, "metadata": {"encoding": declared}})
    got = shape(files.encoding_errors(spark, write(tmp_path / "x.csv", f"a\n{text}\n", written), c))
    assert [(x, y) for x, y, _ in got] == [("encoding", 1)] * bad
    if bad:
        assert shape(files.metadata_errors(spark, str(tmp_path / "x.csv"), c)) == got and got[0][2].startswith(f"file not decodable as {declared}")


def test_queries_only(spark):
    spark.sql("create or replace temp view numbers as select id from range(5)")
    assert io.query(spark, "with x as (select id from numbers) select * from x where id >= :low order by id desc;", low=3).collect() == [(4,), (3,)]
    spark.sql("create table if not exists guarded (x int) using parquet")
    try:
        for sql in ("with x as (select 1) insert into guarded select * from x", "insert into guarded values (1)", "drop table guarded", "select 1; drop table guarded", "create table other (x int)", "truncate table guarded", "select 1) union all (insert into guarded values (1)"):
            with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR|syntax"):
                io.query(spark, sql).collect()
        assert spark.read.table("guarded").count() == 0
    finally:
        spark.sql("drop table guarded")


def test_table_from_ddl(spark):
    feed, _ = clean(spark)
    c = contracts.load({**CUSTOMER, "target": {"table": "ddl_customer"}, "columns": [{**x, "max_length": 201} if x["name"] == "name" else x for x in CUSTOMER["columns"]]})
    assert schema_check.table_or_none(spark, "ddl_customer") is None
    assert schema_check.schema_errors(schema_check.table_or_none(spark, "ddl_customer"), c) == ["table ddl_customer does not exist"]
    try:
        assert [io.load_table(expected(feed, c), c) for _ in range(2)] == [20, 20]
        live = schema_check.table_or_none(spark, "ddl_customer")
        assert schema_check.schema_errors(live, c) == [] and schema_check.declared_key_errors(spark, "ddl_customer", c) == []
        assert [f.dataType for f in c.struct()] == [f.dataType for f in live.schema]
        with pytest.raises(PermissionError, match="read-only"):
            io.load_table(expected(feed, c), c, read_only=True)
        other = contracts.load({**CUSTOMER, "keys": ["id", "email"]})
        assert schema_check.declared_key_errors(spark, "ddl_customer", other) == ["primary key mismatch: expected ['id', 'email'], got ['id']"]
        swapped = live.select("name", "id", "email", "balance")
        got = schema_check.schema_errors(swapped, c)
        assert got[0].startswith("column order/count mismatch: expected ['id', 'name', 'email', 'balance', 'status'], got ['name', 'id'") and got[1:] == ["missing column 'status'"]
        assert [m for m in schema_check.schema_errors(live, c, declared=True) if "nullability" in m][0] == "column 'id' nullability mismatch: expected nullable=False, got True"
    finally:
        spark.sql("drop table if exists ddl_customer")


def test_load_refuses_its_own_source(spark, tmp_path):
    feed, _ = clean(spark)
    feed.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="itself"):
        io.load_expected(expected(spark.read.parquet(str(tmp_path / "t")), C), C, str(tmp_path / "t"))
    with pytest.raises(PermissionError):
        io.load_expected(expected(feed, C), C, str(tmp_path / "u"), read_only=True)


def test_jdbc_target(spark):
    """A real database in this process: read in parts, and compared."""
    from pyspark.sql import functions as F

    feed, target = clean(spark)
    options = {"url": "jdbc:derby:memory:recon;create=true", "dbtable": "customer", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    small = target.where("id <> 3").withColumn("balance", F.col("balance").cast("decimal(18,2)"))  # Derby has no 38 digits
    small.write.format("jdbc").options(**options).mode("overwrite").save()
    live = io.read_target(spark, C, jdbc=options, split=io.Split("id", 1, 20, 4))
    assert live.rdd.getNumPartitions() == 4 and live.columns == [c.name for c in C.columns]
    rows = compare.joined(expected(feed, C, ["seq"]), live, C, (["seq"], ["id"]))
    assert rows_of(compare.missing(rows, C)) == [("3",)] and rows_of(compare.diffs(rows, C)) == []


def test_last_row_of_a_hot_key(spark):
    """A key with most rows: combined before the exchange, all rows counted."""
    from pyspark.sql import functions as F

    c = contracts.load({**CUSTOMER, "columns": [CUSTOMER["columns"][0], {"name": "n", "source_name": "balance", "type": "integer", "nullable": True}]})
    e = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).cast("string").alias("id"), F.col("id").cast("string").alias("n"), F.col("id").alias("seq"))
    a = e.where("id <> 20").select("id", F.when(F.col("id") == "7", "2999").otherwise(F.col("n")).alias("n"), "seq")
    rows = compare.joined(e, a, c, (["seq"], ["seq"]), counted=True)
    assert compare.counts(rows).first().asDict() == {"source_count": 3000, "target_count": 2999, "missing": 1, "extra": 0, "diffs": 0, "mismatch_count": 1}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") >= 2
    plan = compare.joined(e, a, c, (["seq"], ["seq"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and after each exchange


def test_counts_and_rules_read_once(spark, tmp_path):
    """Plans: counts read each side once, and a clean feed is read once for all flags and once
    for its unique column."""
    feed, target = clean(spark)
    feed.write.parquet(str(tmp_path / "f")), target.write.parquet(str(tmp_path / "t"))
    feed, target = spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "t"))
    rows = compare.counts(compare.joined(expected(feed, C, ["seq"]), target, C, (["seq"], ["id"]), counted=True))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    marked = rules.failures(feed, C, ["seq"])._jdf.queryExecution().optimizedPlan().toString()
    assert marked.count("Relation [") == 3  # flags once, the unique column and its repeated values


def test_samples_in_the_pass_that_counts(spark, tmp_path):
    """A report tells every row of the feed once, failing or not; the detail reads each side once
    and cuts lists before the exchange."""
    told = spark.sparkContext.accumulator(0)

    def seen(x):
        told.add(1)
        return x

    plain = contracts.load({**CUSTOMER, "columns": [{k: v for k, v in c.items() if k != "unique"} for c in CUSTOMER["columns"]]})
    bad = [(*r[:4], "-1" if r[6] % 2 else r[4], "unknown" if r[6] > 3 else r[5], r[6]) for r in ROWS]
    feed = spark.createDataFrame(bad, KIND).withColumn("balance", F.udf(seen, "string").asNondeterministic()("balance"))
    got = {r["rule_id"]: (r["failing_rows"], r["samples"]) for r in rules.report(feed, plain, ["seq"]).collect()}
    assert got == {"range:balance": (10, ["1", "3", "5", "7", "9"]), "allowed_values:status": (17, ["4", "5", "6", "7", "8"])}
    assert told.value == len(ROWS)
    _, target = clean(spark)
    target.write.parquet(str(tmp_path / "t")), spark.createDataFrame(bad, KIND).write.parquet(str(tmp_path / "f"))
    feed, target = spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "t"))
    detail = compare.detail(compare.joined(expected(feed, C, ["seq"]), target.where("id > 2"), C, (["seq"], ["id"])), C, 3)
    plan = detail._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "WindowGroupLimit" in plan
    assert rows_of(detail.select("kind", "id", "column")) == [("diff", "10", "status"), ("diff", "11", "balance"), ("diff", "11", "status"), ("missing", "1", None), ("missing", "2", None)]


def run_over(spark, tmp_path, lines, contract=C, live=None, **more):
    feed, target = str(tmp_path / "feed.csv"), str(tmp_path / "target")
    write(tmp_path / "feed.csv", "\n".join(lines) + "\n")
    if live is not None:
        live.write.mode("overwrite").parquet(target)
    return pipeline.run(spark, contract, feed, target, load=live is None, **more)


def test_gates(spark, tmp_path):
    lines = [HEADER, *[",".join(r[:6]) for r in ROWS]]
    counted = contracts.load({**CUSTOMER, "metadata": {"expected_row_count": 20}})
    run = run_over(spark, tmp_path, lines, counted)
    assert (run.status, run.stopped_at, run.errors) == ("PASS", None, [])
    assert run.summary.first()["target_count"] == 20 and spark.read.parquet(str(tmp_path / "target")).count() == 20
    loaded = spark.createDataFrame(spark.read.parquet(str(tmp_path / "target")).collect(), spark.read.parquet(str(tmp_path / "target")).schema)

    short = tmp_path / "short"
    short.mkdir()
    run = run_over(spark, short, lines[:-1], counted)
    assert (run.stopped_at, run.errors) == ("files", ["row count: expected 20, got 19"]) and not (short / "target").exists()
    run = run_over(spark, short, [HEADER.replace("email", "mail"), *lines[1:]], counted)
    assert (run.stopped_at, run.errors) == ("files", ["header column 4: expected 'email', got 'mail'"])
    run = run_over(spark, short, [*lines[:-1], lines[-1].replace("active", "gone")], counted)
    assert run.stopped_at == "rules" and run.summary.first()["validation_rule_failures"] == 1 and not (short / "target").exists()
    run = run_over(spark, short, lines, counted, loaded.drop("status"))
    assert run.stopped_at == "schema" and run.summary.first()["schema_errors"] == 2
    run = run_over(spark, short, lines, counted, loaded.where("id > 1"))
    assert run.stopped_at == "count" and run.summary.first()["target_count"] == 19
    run = run_over(spark, short, lines, counted, loaded.selectExpr("id", "name", "case when id = 7 then upper(email) else email end as email", "balance", "status"))
    assert run.stopped_at == "compare" and run.summary.first()["mismatch_count"] == 1 and run.rows is not None
    run = run_over(spark, short, [*lines[:-1], lines[-1].replace("active", "gone")], counted, loaded.where("id > 1"), stop_at_gates=False)
    assert run.stopped_at == "rules" and run.summary.first()["mismatch_count"] == 2  # the missing row and the changed status


def test_missing_target(spark, tmp_path):
    write(tmp_path / "feed.csv", "\n".join([HEADER, *[",".join(r[:6]) for r in ROWS]]) + "\n")
    run = pipeline.run(spark, C, str(tmp_path / "feed.csv"), str(tmp_path / "nowhere"), load=False)
    assert run.stopped_at == "schema" and run.errors == ["table customer does not exist"]


def test_failure_layers(spark, tmp_path):
    from tablerecon.jobs import report

    feed, target = clean(spark)
    bad = spark.createDataFrame([[*ROWS[0][:4], "-1", "active", 1], *[list(r) for r in ROWS[1:]]], KIND)
    live = target.where("id <> 5").selectExpr("id", "case when id = 7 then 'x' else name end as name", "email", "balance", "case when id = 8 then 'inactive' else status end as status")
    rows = compare.joined(expected(bad, C, ["seq"]), live, C, (["seq"], ["id"]))
    checks = files.header_errors(spark, write(tmp_path / "h.csv", HEADER.replace("email", "mail") + "\n"), C)
    got = report.failure_layers(rows, rules.report(bad, C, ["seq"]), C, checks, ["missing column 'x'"])
    assert dict(map(tuple, got.collect())) == {"extract": 1, "source data": 1, "target schema": 1, "load": 2, "transform": 2}


def test_history(spark, tmp_path):
    feed, target = clean(spark)
    for i in (1, 2):
        run = pipeline.reconcile(C, feed, target, ["seq"], ["id"], timestamp=f"2024-01-0{i}T00:00:00")
        io.append_history(run.summary, str(tmp_path / "h"), f"run-{i}", "abc123", "me")
    got = spark.read.parquet(str(tmp_path / "h")).orderBy("timestamp").collect()
    assert [(r["run_id"], r["commit"], r["user"], str(r["day"])) for r in got] == [("run-1", "abc123", "me", "2024-01-01"), ("run-2", "abc123", "me", "2024-01-02")]
