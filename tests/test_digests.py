"""Comparison by digests: the same rows as the whole comparison, with little shuffled."""

from collections import Counter

from pyspark.sql import functions as F

from tablerecon import contract as contracts
from tablerecon.operators import compare, digests

C = contracts.load({
    "contract_name": "d", "version": "1", "source": {"columns": ["id", "n", "s"]}, "target": {"table": "d"}, "keys": ["id"],
    "columns": [{"name": "id", "source_name": "id", "type": "integer", "nullable": False}, {"name": "n", "source_name": "n", "type": "decimal", "nullable": True}, {"name": "s", "source_name": "s", "type": "string", "nullable": True}],
})


def rows_of(rows):
    return Counter((r["id"], r["kind"], tuple(map(tuple, r["diffs"]))) for r in rows.where("kind <> 'matched' or size(diffs) > 0").collect())


def test_same_rows_as_the_whole_comparison(spark):
    """Nulls, unreadable text, repeated keys with another last row, keys of one side."""
    base = [(str(i), f"{i}.5", f"s{i}", i) for i in range(200)]
    e = [*base, ("7", "1", "x", 900), (None, "1", "n", 901), ("x", "bad", None, 902), ("50", "50.5", "s50", 903), ("a", "1", "1", 904)]
    a = [*base[:150], ("7", "1", "x", -1), (None, "1", "n", 5), ("x", "bad", "", 6), ("50", "50.50", " s50", 7), ("300", None, None, 8), ("01", "1.50", "s1", 9)]
    kind = "id string, n string, s string, seq long"
    e, a = spark.createDataFrame(e, kind), spark.createDataFrame(a, kind)
    want = rows_of(compare.joined(e, a, C, (["seq"], ["seq"])))
    assert len(want) > 50
    for ranges in (1, 16, 1 << 16):
        assert rows_of(digests.joined(e, a, C, (["seq"], ["seq"]), ranges=ranges)) == want
    assert rows_of(digests.joined(e, a, C, (["seq"], ["seq"]), ["s"])) == rows_of(compare.joined(e, a, C, (["seq"], ["seq"]), ["s"]))
    empty = e.limit(0)
    assert rows_of(digests.joined(e, empty, C, (["seq"], ["seq"]))) == rows_of(compare.joined(e, empty, C, (["seq"], ["seq"])))
    assert not rows_of(digests.joined(empty, empty, C, (["seq"], ["seq"])))


def shuffled(spark, run):
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    total = lambda: sum(s.shuffleWriteBytes() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, none, None)))
    before = total()
    out = run()
    return out, total() - before


def test_equal_rows_are_not_shuffled(spark):
    e = spark.range(0, 200_000, 1, 4).select(F.col("id").cast("string"), F.concat("id", F.lit(".25")).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("s"), F.col("id").alias("seq"))
    a = e.withColumn("n", F.when(F.col("id") == "77777", "0").otherwise(F.col("n")))
    whole, much = shuffled(spark, lambda: rows_of(compare.joined(e, a, C, (["seq"], ["seq"]))))
    found, little = shuffled(spark, lambda: rows_of(digests.joined(e, a, C, (["seq"], ["seq"]), ranges=1024, keys_unique=True)))
    assert found == whole and len(found) == 1
    assert little < much / 50


def test_key_sets(spark):
    kind = "id string, n string, s string"
    e = spark.createDataFrame([("1", "a", None), ("01", "a", None), ("2", "a", None), ("3", "b", None), (None, None, None), ("9", "only", None)], kind)
    a = spark.createDataFrame([("1", "a", None), ("2", "a", None), ("4", "b", None), (None, None, None)], kind)
    got = {r["group"]: tuple(r)[1:] for r in digests.key_sets(e, a, C, ("n", "n")).collect()}
    assert got == {"a": (3, 2, 2, 2, True, 0, 0), "b": (1, 1, 1, 1, False, 1, 1), None: (1, 1, 1, 1, True, 0, 0), "only": (1, 0, 1, 0, False, 1, 0)}


def test_mostly_different_tables_are_compared_at_once(spark):
    """Where most rows are in ranges that differ, rows are not told by digest again: one exchange a
    side beyond the digests', and the same rows."""
    e = spark.range(0, 5000, 1, 4).select(F.col("id").cast("string"), F.concat("id", F.lit(".25")).alias("n"), F.lit("x").alias("s"), F.col("id").alias("seq"))
    a = e.withColumn("n", F.when(F.col("id") % 2 == 0, "0").otherwise(F.col("n"))).where("id <> 7")
    rows = digests.joined(e, a, C, (["seq"], ["seq"]), ranges=64)
    assert rows_of(rows) == rows_of(compare.joined(e, a, C, (["seq"], ["seq"])))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "LeftSemi" not in plan
