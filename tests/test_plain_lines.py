"""Plain lines are told a batch at once, with the same outcome as line by line."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablerecon import contract as contracts
from tablerecon.functions import values
from tablerecon.jobs import pipeline
from tablerecon.operators import compare, digests
from tablerecon.sources import records


def _batches(lines, size):
    return records._Raws(pa.array(lines[i : i + size], pa.binary()) for i in range(0, len(lines), size))


@pytest.mark.parametrize("block", [0, 100])
@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "iso8859-1", "utf-16-le"])
def test_plain_batches_are_told_as_lines_are(block, codec):
    chance, plain = random.Random(block), 0
    pieces = [b"a,b,c"] * 30 + [b"", b"1,2", b"x,y,z,w", "é,ü,1".encode(), b"\xff,1,2", b"a\rb,c", b"a,b,c\r", b'"q,1",2,3', b'"open,1', b'shut",2,3', b'a"b,c', b","]
    for n in range(300):
        many = pieces if n % 3 else pieces[:33]
        lines = [chance.choice(many) for _ in range(chance.randrange(40))]
        got = _batches(lines, chance.choice([1, 3, 8]))
        taken = got.plain
        got.plain = lambda *x, taken=taken: (count := taken(*x)) and (told.append(1), count)[1]
        told = []
        assert records.summary("f", block, got, codec, ",") == records.summary("f", block, iter(lines), codec, ","), lines
        plain += len(told)
    assert (plain > 300) == (codec != "utf-16-le")


SPEC = {
    "contract_name": "p", "version": "1", "source": {"columns": ["id", "n"]}, "target": {"table": "p"}, "keys": ["id"],
    "columns": [{"name": "id", "source_name": "id", "type": "integer", "nullable": False}, {"name": "n", "source_name": "n", "type": "decimal", "nullable": True}],
}


def test_equal_sides_are_not_joined(spark, monkeypatch, tmp_path):
    """A run whose target agrees tells that from digests; one that differs, or whose feed has a key
    twice, joins the rows."""
    joins = []
    counts = compare.counts
    monkeypatch.setattr(compare, "counts", lambda rows: joins.append(1) or counts(rows))
    contract, feed = contracts.load(SPEC), str(tmp_path / "feed.csv")

    def run(lines, live=None):
        (tmp_path / "feed.csv").write_text("id,n\n" + "".join(f"{a},{b}\n" for a, b in lines))
        target = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        if live is not None:
            spark.createDataFrame(live, "id long, n string").withColumn("n", F.col("n").cast(contract.column("n").sql_type)).write.parquet(target)
        joins.clear()
        out = pipeline.run(spark, contract, feed, target, load=live is None)
        return out.stopped_at, out.summary.first()["mismatch_count"], len(joins)

    assert run([(1, "1.50"), (2, ""), (3, "x1")][:2]) == (None, 0, 0)
    assert run([(1, "1.5"), (2, "2")], [(1, "1.50"), (2, "2")]) == (None, 0, 0)
    assert run([(1, "1.5"), (2, "2")], [(1, "1.50"), (2, "3")]) == ("compare", 1, 1)
    assert run([(1, "1.5"), (2, "")], [(1, "1.50"), (2, "0")]) == ("compare", 1, 1)
    assert run([(1, "1.5"), (1, "1.5")], [(1, "1.50"), (2, "2")]) == ("compare", 1, 1)


def test_digests_tell_how_often(spark):
    contract = contracts.load(SPEC)
    df = lambda rows: spark.createDataFrame(rows, "id string, n string")
    assert digests.same(df([("1", "1"), ("02", "2.0")]), df([("2", "2"), ("1", "1.00")]), contract)
    assert not digests.same(df([("1", "1"), ("1", "1"), ("2", "2")]), df([("1", "1"), ("2", "2"), ("2", "2")]), contract)
    assert not digests.same(df([("1", "1")]), df([]), contract)
    assert digests.same(df([]), df([]), contract)


def test_cheap_forms_are_the_whole_ones(spark):
    """Stripping, digits, ranges and dates at the edges of their shorter ways."""
    texts = ["", " ", "a", " a", "a ", "　a\x85", "é", "é ", "~", "!", "\x7f", "a\x1c", "\t!", "a b", "١٢", "1٣"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    got = rows.select("x", values.strip(F.col("x")).alias("s"), F.btrim("x", F.lit(values.WHITE)).alias("want"), values.ascii_digits(F.col("x")).alias("d"), F.translate("x", values._OTHER_DIGITS, values._THEIR_DIGITS).alias("own")).collect()
    assert all(r["s"] == r["want"] and r["d"] == r["own"] for r in got)
    numbers = {"0.1": True, "0.10": True, "0.09999999999999999": False, "0.1000000000000000": True, "0.2": True, "0.20000000000000001": False, "0.15": True, "NaN": None, "1d": None, "0.3": False, "-0.15": False, "+.15": True, "1.5e-1": True}
    got = spark.createDataFrame([(x,) for x in numbers], "x string").select("x", values.in_range(F.col("x"), "0.1", "0.2").alias("in")).collect()
    assert {r["x"]: r["in"] for r in got} == numbers
    spec = contracts.load({**SPEC, "columns": [*SPEC["columns"], {"name": "d", "source_name": "d", "type": "date", "nullable": True}], "source": {"columns": ["id", "n", "d"]}}).column("d")
    dates = {"2024-01-02": "2024-01-02", "2024-1-2": "2024-01-02", "0000-01-01": None, "2024-02-30": None, "+2024-01-02": None, "12024-01-02": None, "2024-01-02T": None}
    got = spark.createDataFrame([(x,) for x in dates], "x string").select("x", values.normalize(F.col("x"), spec).typed.cast("string").alias("d")).collect()
    assert {r["x"]: r["d"] for r in got} == dates
