"""What the differences of a comparison have in common: a constant delta, a factor, a cut, a
time zone, two fields swapped.

Every differing cell is given all signatures that it fits, such as ``delta 0.5`` and ``ratio 2``.
A frequent-items sketch per column, merged from all tasks, keeps the signatures that may reach
the wanted share of the column's cells; those alone are counted exactly, and each cell goes to
the one that most cells of its column fit. So random differences, each with a delta of its own,
are neither shuffled by signature nor gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: patterns, the more telling first: of two that equally many cells fit, the first is taken
PATTERNS = (
    "swapped with", "null for value", "value for null", "case", "blanks", "leading zeros lost", "day and month swapped", "zone", "seconds", "days", "delta", "ratio",
    "cut to", "prefix added", "suffix added", "prefix lost", "suffix lost", "replaced",
)
#: the most signatures that one cell can have
MOST = 8
#: least share of a column's cells that can be asked for
LEAST_SHARE = 0.001
_NUMBER = "decimal(27,8)"


def _sign(pattern: str, parameter: Column | None = None) -> Column:
    return F.concat(F.lit(f"{PATTERNS.index(pattern):02d}|{pattern}|"), parameter if parameter is not None else F.lit(""))


def _plain(x: Column) -> Column:
    """A decimal's text without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _numbers(e: Column, a: Column, scale: Column) -> list[Column]:
    """Delta, and the factor with the fewest places that gives the actual number once rounded."""
    x, y = e.try_cast(_NUMBER), a.try_cast(_NUMBER)
    half = F.pow(F.lit(10.0), -scale) * 0.5000001
    factors = []
    for places in (0, 2, 4, 6):
        r = F.round(F.try_divide(y.cast("double"), x.cast("double")), places).try_cast("decimal(16,6)")
        near = F.abs(F.try_subtract(F.try_multiply(x, r), y)).cast("double") <= half
        factors.append(F.when(near & (r != 1) & (r != 0), r))
    return [_sign("delta", _plain(F.try_subtract(y, x))), _sign("ratio", _plain(F.coalesce(*factors)))]


def _days(e: Column, a: Column) -> list[Column]:
    x, y = e.try_cast("date"), a.try_cast("date")
    turned = (F.year(x) == F.year(y)) & (F.month(x) == F.day(y)) & (F.day(x) == F.month(y))
    return [F.when(turned, _sign("day and month swapped")), _sign("days", F.date_diff(y, x).cast("string"))]


def _seconds(e: Column, a: Column) -> list[Column]:
    x, y = (t.try_cast("timestamp_ntz") for t in (e, a))
    micros = F.timestamp_diff("MICROSECOND", x, y)
    zone = (F.pmod(micros, F.lit(900_000_000)) == 0) & (F.abs(micros) <= 14 * 3_600_000_000)
    minutes = F.abs(micros / 60_000_000).cast("int")
    shown = F.format_string("%s%02d:%02d", F.when(micros < 0, "-").otherwise("+"), (minutes / 60).cast("int"), minutes % 60)
    return [F.when(zone, _sign("zone", shown)), F.when(~zone, _sign("seconds", _plain((micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(26,6)"))))]


def _texts(e: Column, a: Column) -> list[Column]:
    bare = lambda t: F.regexp_replace(t, r"(?U)\s+", "")
    n, m = F.char_length(e), F.char_length(a)
    zeros = e.startswith("0") & (F.ltrim(e, F.lit("0")) == a)
    return [
        F.when(F.lower(e) == F.lower(a), _sign("case")),
        F.when(bare(e) == bare(a), _sign("blanks")),
        F.when(zeros, _sign("leading zeros lost")),
        F.when(e.startswith(a), _sign("cut to", m.cast("string"))),
        F.when(a.endswith(e), _sign("prefix added", F.substring(a, F.lit(1), m - n))).when(a.startswith(e), _sign("suffix added", F.substring(a, n + 1, m))),
        F.when(e.endswith(a), _sign("prefix lost", F.substring(e, F.lit(1), n - m))).when(e.startswith(a), _sign("suffix lost", F.substring(e, m + 1, n))),
        _sign("replaced", F.concat(e, F.lit(" -> "), a)),
    ]


def signed(rows: DataFrame, contract) -> DataFrame:
    """``key`` (the first one), ``column, signs``: every differing cell with the signatures that
    it fits. Numbers of over 19 digits before the point have none of numbers."""
    kinds: dict[str, list] = {}
    for c in contract.columns:
        kinds.setdefault(c.type, []).append(c)
    named = {kind: [c.name for c in own] for kind, own in kinds.items()}
    scale = F.lit(0)
    for c in kinds.get("decimal", []):
        scale = F.when(F.col("column") == c.name, c.scale).otherwise(scale)
    other = lambda x: F.filter("diffs", lambda y: (y["column"] != x["column"]) & (y["expected"] == x["actual"]) & (y["actual"] == x["expected"]))
    swapped = lambda x: F.array_sort(F.transform(other(x), lambda y: y["column"]))
    cells = F.transform("diffs", lambda x: F.struct(x["column"].alias("column"), x["expected"].alias("e"), x["actual"].alias("a"), F.get(swapped(x), F.lit(0)).alias("other")))
    told = rows.where(F.size("diffs") > 0).select(F.col(contract.keys[0]).alias("key"), F.inline(cells))
    e, a, column = F.col("e"), F.col("a"), F.col("column")
    nulls = F.when(a.isNull(), F.array(_sign("null for value"))).when(e.isNull(), F.array(_sign("value for null")))
    fits = lambda own: F.array_compact(F.array(_sign("swapped with", F.col("other")), *own))
    number = column.isin([*named.get("integer", []), *named.get("decimal", [])]) & e.try_cast(_NUMBER).isNotNull() & a.try_cast(_NUMBER).isNotNull()
    day = column.isin(named.get("date", [])) & e.try_cast("date").isNotNull() & a.try_cast("date").isNotNull()
    time = column.isin(named.get("timestamp", [])) & e.try_cast("timestamp_ntz").isNotNull() & a.try_cast("timestamp_ntz").isNotNull()
    signs = nulls.when(number, fits(_numbers(e, a, scale))).when(day, fits(_days(e, a))).when(time, fits(_seconds(e, a))).otherwise(fits(_texts(e, a)))
    return told.select("key", "column", signs.alias("signs"))


def frequent(cells: DataFrame, min_share: float) -> DataFrame:
    """``column, sign``: at least all signatures that ``min_share`` of a column's cells fit, a
    bounded number of them. The sketch's error is under a quarter of what is asked for."""
    tracked = 1
    while tracked < 14 * MOST / min_share:
        tracked *= 2
    top = F.expr(f"approx_top_k(sign, {int(MOST / min_share)}, {tracked})")
    each = cells.select("column", F.explode("signs").alias("sign"))
    return each.groupBy("column").agg(top.alias("top")).select("column", F.explode(F.col("top.item")).alias("sign"))


def mismatch_patterns(rows: DataFrame, contract, min_share: float = 0.01) -> DataFrame:
    """``column, pattern, parameter, cells, column_cells, example`` (the smallest key) of the
    differing cells of a comparison (``rows``: keys and ``diffs``).

    A pattern counts if ``min_share`` of the column's cells and at least two fit it; a cell that
    fits several goes to the one that most fit, so what is left to the others can be less. Cells
    without one are ``other``. ``rows`` is read four times, so it should be a stored table, such
    as the differences of a run; without differences there are no rows.
    """
    if not LEAST_SHARE <= min_share <= 1:
        raise ValueError(f"min_share must be within {LEAST_SHARE} and 1")
    cells = signed(rows, contract)
    # at most MOST / min_share signatures a column, so each of these tables fits every task
    wanted = F.broadcast(frequent(cells, min_share))
    size = cells.groupBy("column").agg(F.count("*").alias("column_cells"))
    fitting = cells.select("column", F.explode("signs").alias("sign")).join(wanted, ["column", "sign"]).groupBy("column", "sign").agg(F.count("*").alias("fit"))
    enough = fitting.join(F.broadcast(size), "column").where((F.col("fit") >= 2) & (F.col("fit") >= F.col("column_cells") * min_share))
    ranked = enough.groupBy("column").agg(F.array_sort(F.collect_list(F.struct((-F.col("fit")).alias("fit"), "sign"))).alias("ranked"), F.first("column_cells").alias("column_cells"))
    kept = size.select("column", "column_cells").join(F.broadcast(ranked.select("column", F.col("ranked.sign").alias("ranked"))), "column", "left")
    best = F.get(F.array_intersect(F.coalesce("ranked", F.array().cast("array<string>")), "signs"), F.lit(0))
    given = cells.join(F.broadcast(kept), "column").select("key", "column", "column_cells", best.alias("sign"))
    out = given.groupBy("column", "sign").agg(F.count("*").alias("cells"), F.first("column_cells").alias("column_cells"), F.min("key").alias("example"))
    parts = F.split("sign", r"\|", 3)
    return out.select("column", F.coalesce(parts[1], F.lit("other")).alias("pattern"), F.when(parts[2] != "", parts[2]).alias("parameter"), "cells", "column_cells", "example")
