"""Patterns of differences, each planted in a comparison's rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tablerecon import contract as contracts
from tablerecon.jobs import demo, demo_checks
from tablerecon.operators import compare, patterns

TYPES = {"n": "integer", "d": "decimal", "day": "date", "at": "timestamp", "s": "string", "t": "string", "b": "boolean"}
C = contracts.load({
    "contract_name": "p", "version": "1", "source": {"columns": ["id", *TYPES]}, "target": {"table": "p"}, "keys": ["id"],
    "columns": [{"name": "id", "source_name": "id", "type": "integer", "nullable": False}, *[{"name": k, "source_name": k, "type": v, "nullable": True} for k, v in TYPES.items()]],
})
KIND = "id string, diffs array<struct<column:string,expected:string,actual:string>>"


def found(spark, cells, min_share=0.01):
    rows = spark.createDataFrame([(str(i), [tuple(c) for c in own]) for i, own in enumerate(cells, 100)], KIND)
    return {tuple(r) for r in patterns.mismatch_patterns(rows, C, min_share).collect()}


def test_each_pattern(spark):
    pairs = {
        ("n", "delta", "7"): [("1", "8"), ("20", "27")], ("d", "ratio", "1.19"): [("10.03", "11.94"), ("7.77", "9.25")], ("d", "delta", "-0.5"): [("3.00", "2.50"), ("9.10", "8.60"), ("0.00", "-0.50")],
        ("day", "day and month swapped", None): [("2024-03-05", "2024-05-03"), ("2023-01-12", "2023-12-01")], ("day", "days", "-1"): [("2024-03-01", "2024-02-29"), ("2023-01-01", "2022-12-31")],
        ("at", "zone", "+05:30"): [("2024-03-31 00:10:00", "2024-03-31 05:40:00"), ("2024-01-01 23:00:00.5", "2024-01-02 04:30:00.5")], ("at", "seconds", "-0.25"): [("2024-01-01 00:00:00", "2023-12-31 23:59:59.75"), ("2024-01-01 00:00:01.25", "2024-01-01 00:00:01")],
        ("s", "case", None): [("Ab", "aB"), ("x", "X")], ("s", "blanks", None): [("a b", "ab"), ("c d", "c d")], ("s", "leading zeros lost", None): [("007", "7"), ("0450", "450")],
        ("s", "cut to", "3"): [("abcdef", "abc"), ("xyz1", "xyz")], ("s", "prefix added", "N|-"): [("12", "N|-12"), ("é", "N|-é")], ("s", "suffix added", "€"): [("5", "5€"), ("66", "66€")],
        ("s", "prefix lost", "q/"): [("q/1", "1"), ("q/22", "22")], ("s", "replaced", "F -> G"): [("F", "G"), ("F", "G"), ("F", "G")], ("s", "null for value", None): [("1", None), ("2", None)],
        ("s", "value for null", None): [(None, "1"), (None, "2")], ("b", "replaced", "true -> false"): [("true", "false"), ("true", "false")],
    }
    cells, want, size = [], set(), {}
    for (column, *_), own in pairs.items():
        size[column] = size.get(column, 0) + len(own)
    for (column, pattern, parameter), own in pairs.items():
        want.add((column, pattern, parameter, len(own), size[column], str(100 + len(cells))))
        cells += [[(column, e, a)] for e, a in own]
    assert found(spark, cells) == want


def test_swapped_other_and_ties(spark):
    """Two fields swapped fit "case" as well; a cell alone with its signature is "other"; what
    cannot be read as its type is compared as text."""
    cells = [[("s", "f", "F"), ("t", "F", "f")], [("s", "o", "O"), ("t", "O", "o")], [("n", "1", "3")], [("d", "abc", "ab")], [("d", "xyz", "xy")], []]
    want = {("s", "swapped with", "t", 2, 2, "100"), ("t", "swapped with", "s", 2, 2, "100"), ("n", "other", None, 1, 1, "102"), ("d", "cut to", "2", 2, 2, "103")}
    assert found(spark, cells) == want
    assert found(spark, []) == set() == found(spark, [[]])


def test_heavy_among_random_differences(spark):
    """A pattern of 2 % of the cells among 200,000 with a delta of their own; sums stay whole."""
    x = F.col("id")
    diffs = F.array(F.struct(F.lit("n").alias("column"), (x * 31).cast("string").alias("expected"), F.when(x % 50 == 0, x * 31 + 5).otherwise(x * 31 + 1000 + x * x).cast("string").alias("actual")))
    rows = spark.range(1, 200_001, 1, 8).select(x.cast("string").alias("id"), diffs.alias("diffs"))
    got = {(r["pattern"], r["parameter"]): (r["cells"], r["column_cells"]) for r in patterns.mismatch_patterns(rows, C).collect()}
    assert got == {("delta", "5"): (4000, 200_000), ("other", None): (196_000, 200_000)}


def test_signatures_stay_where_they_are(spark):
    """Cells are not shuffled by signature before the sketch has chosen; a longest cell keeps
    within MOST."""
    rows = spark.createDataFrame([("1", [("s", "00" * 5, "0" * 9)])], KIND)
    assert max(len(r["signs"]) for r in patterns.signed(rows, C).collect()) <= patterns.MOST
    plan = patterns.frequent(patterns.signed(rows, C), 0.01)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "sign#" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0]


def test_from_a_comparison(spark):
    kind = "id string, n string, d string, day string, at string, s string, t string, b string"
    e = spark.createDataFrame([(str(i), str(i), f"{i}.10", "2024-01-05", "2024-01-01 00:00:00", "ab", "cd", "true") for i in range(40)], kind)
    a = e.withColumn("d", F.when(F.col("n") % 2 == 0, F.col("d").cast("decimal(10,2)") * 100).otherwise(F.col("d").cast("decimal(10,2)")).cast("string"))
    rows = compare.joined(e, a, C, (["id"], ["id"]))
    assert {tuple(r) for r in patterns.mismatch_patterns(rows, C).collect()} == {("d", "ratio", "100", 20, 20, "0")}


@pytest.mark.parametrize("name", ["mismatch_patterns", "mismatch_pattern_times"])
def test_queries(spark, name):
    """Planted patterns over the test tables, against SQL that knows where they were planted."""
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("orders", "events"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = demo_checks.QUERIES[name](spark, d)
    cols = ", ".join(f'"{c}"' for c in got.columns)
    assert {tuple(r) for r in got.collect()} == set(con.sql(f"select {cols} from ({demo.ORACLE_SQL[name]})").fetchall())


def test_share_out_of_bounds(spark):
    with pytest.raises(ValueError, match="min_share"):
        patterns.mismatch_patterns(spark.createDataFrame([], KIND), C, 0)
