"""Values at their edges against Python's own reading, under several session zones."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablerecon import contract as contracts
from tablerecon.functions.transforms import compiled, parse
from tablerecon.functions.values import date_pattern, in_range, normalize

TIMES = [
    "2024-01-1T", "2024-01-01", "2024-1-2", "0000-01-01", "0001-01-01", "9999-12-31", "2024-02-30", "2024-01-1 ", "+024-01-01", "2024-03-31 02:30:00", "2024-03-31 03:30:00", "2024-10-27 02:30:00",
    "1893-04-01 00:00:01", "2024-01-02   10:01:00", "2024-01-02 10:01:00.25", "2024-01-02 10:01:60", "2024-01-02 24:00:00", "2024-01-02T10:00:00", "2024-01-02t10:00:00", "2024-01-02 1:2:3",
    "٢٠٢٤-01-02", "2024-01-02 10:01:00.1234567", "", "2024-01-02　 10:01:00",
]
ISO = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f"]


def parsed(text, formats):
    for f in formats:
        try:
            return dt.datetime.strptime(text.strip(), f)
        except ValueError:
            pass
    return None


def shown(x):
    return x and (x.isoformat(" ") if not x.microsecond else x.isoformat(" ").rstrip("0"))


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/St_Johns"])
def test_dates_and_times_in_any_zone(spark, zone):
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", zone)
    df = own.createDataFrame([(t,) for t in TIMES], "x string")
    day, time, other = (normalize(F.col("x"), contracts.Column("x", kind, True, ts_format=f)) for kind, f in (("date", None), ("timestamp", None), ("timestamp", "%Y-%m-%dT%H:%M:%S")))
    for r in df.select("x", *[v.typed.cast("string").alias(n) for n, v in (("day", day), ("time", time), ("other", other))]).collect():
        want = parsed(r.x, ["%Y-%m-%d"])
        assert r.day == (str(want.date()) if want else None), r.x
        assert (r.time, r.other) == (shown(parsed(r.x, ISO)), shown(parsed(r.x, ["%Y-%m-%dT%H:%M:%S", *ISO]))), r.x


def test_times_of_a_zone_are_not_mistaken(spark):
    """A time that a zone leaves out is not the one an hour later."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    spec = contracts.Column("x", "timestamp", True)
    df = own.createDataFrame([("2024-03-31 02:30:00", dt.datetime(2024, 3, 31, 3, 30))], "a string, b timestamp_ntz")
    a, b = normalize(F.col("a"), spec), normalize(F.col("b"), spec)
    assert [str(x) for x in df.select(a.typed, b.typed).first()] == ["2024-03-31 02:30:00", "2024-03-31 03:30:00"]


def test_formats():
    assert date_pattern("%d.%m.%Y")[1] == "$3-$2-$1 0:0:0.0"
    for bad in ("%q", "%Y-%Y", "100%"):
        with pytest.raises(ValueError, match="directive"):
            date_pattern(bad)


NUMBERS = [
    "5", "-1", "0", "-0", "00100", "100.000", "100.0000000001", "100.0000000000000000000001", "1e2", "1e30", "1e22", "1" + "0" * 22, "1" + "0" * 21 + "1", "1e23", "-1e23", "9" * 44, ".5", "-.5", "5.", "1_0",
    "1e-400", "-1e-400", "0e99999", "abc", "", "NaN", "Infinity", "9" * 20, "0.000000000000000000001", "1E+2", "+7", "-1" + "0" * 37, "1" + "0" * 37, "1" + "0" * 37 + ".1",
]
BOUNDS = [(0, 100), (0, 10**22), ("-1e22", "1e37"), (-5, "0.000000000000000000001"), ("1e-30", 10**20), (-(10**37), -1), (0, 0), (0.5, 99.5)]


@pytest.mark.parametrize(("lo", "hi"), BOUNDS)
def test_ranges_are_exact(spark, lo, hi):
    got = spark.createDataFrame([(t,) for t in NUMBERS], "x string").select("x", in_range(F.col("x"), lo, hi).alias("ok")).collect()
    for r in got:
        try:
            x = Decimal(r.x)
            want = Decimal(str(lo)) <= x <= Decimal(str(hi)) if x.is_finite() else None
        except ArithmeticError:
            want = None
        assert r.ok == want, r.x


def test_exponents_beyond_64_bits(spark):
    far = ["1e" + "9" * 30, "1e-" + "9" * 30, "-1e-" + "9" * 30, "-1e" + "9" * 30]
    got = spark.createDataFrame([(t,) for t in far], "x string").select(in_range(F.col("x"), 0, 100)).collect()
    assert [r[0] for r in got] == [False, True, False, False]


def test_bounds_are_numbers():
    column = {"name": "n", "source_name": "n", "type": "decimal", "nullable": True}
    spec = {"contract_name": "c", "version": "1", "source": {"columns": ["n"]}, "target": {"table": "t"}, "keys": ["n"]}
    for bad in ("x", "NaN", None, float("inf")):
        with pytest.raises(ValueError, match="no number"):
            contracts.load({**spec, "columns": [{**column, "range": [0, bad]}]})
    contracts.load({**spec, "columns": [{**column, "range": [-(10**60), "1e400"]}]})


def test_unknown_placeholder(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert df.select(compiled(parse("{a}-{b}", {"a"}), {"a"})).first()[0] == "x-"


def test_digits_of_other_scripts(spark):
    kinds = {"integer": "12", "decimal": "12.00"}
    for kind, want in kinds.items():
        v = normalize(F.col("x"), contracts.Column("x", kind, True))
        assert spark.createDataFrame([("١٢",)], "x string").select(v.typed.cast("string")).first()[0] == want
