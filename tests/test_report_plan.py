"""Failures by layer come from one comparison."""

from tablerecon import contract as contracts
from tablerecon.jobs import report
from tablerecon.operators import compare, rules

C = contracts.load({
    "contract_name": "d", "version": "1", "source": {"columns": ["id", "s"]}, "target": {"table": "d"}, "keys": ["id"],
    "columns": [{"name": "id", "source_name": "id", "type": "integer", "nullable": False}, {"name": "s", "source_name": "s", "type": "string", "nullable": True}],
})


def test_one_pass(spark):
    e = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("3", "c", 3)], "id string, s string, seq long")
    a = spark.createDataFrame([("1", "a", 1), ("2", "x", 2), ("9", "y", 3)], "id string, s string, seq long")
    rows = compare.joined(e, a, C, (["seq"], ["seq"]))
    got = report.failure_layers(rows, spark.createDataFrame([], rules.REPORT), C)
    assert [tuple(r) for r in got.collect()] == [("load", 3)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
