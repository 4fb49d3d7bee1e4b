"""Keyed comparison of an expected and an actual table.

Key parts are never null, so one equality partitioning serves the last-wins step and the full
outer join: one exchange a side. The last-wins step leaves a row a key and task before the
exchange, so a key that holds much of a table does not land in one task. Where counts are asked
for, the step is an aggregate that also counts the rows of each key, so that all counts of a
comparison come from the join itself; else it is a window, which sorts once less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import chosen, normalize

_CELLS = "array<struct<column:string,expected:string,actual:string>>"


def with_keys(df: DataFrame, contract) -> DataFrame:
    """Adds a text part per key column: V: and the value, N: for null, B: and unreadable text."""
    parts = {f"__k{i}": normalize(F.col(k), contract.column(k)).part() for i, k in enumerate(contract.keys)}
    return df.withColumns(parts)


def key_names(contract) -> list[str]:
    return [f"__k{i}" for i in range(len(contract.keys))]


def shown_keys(contract) -> list[Column]:
    """The key columns as text again."""
    return [F.when(F.col(f"__k{i}") != "N:", F.substring(f"__k{i}", 3, 1 << 30)).alias(k) for i, k in enumerate(contract.keys)]


def _last(df: DataFrame, contract, value: Column, order_by: list[str], counted: bool = False) -> DataFrame:
    """Key parts, ``row`` (``value`` of the key's last row in ``order_by``) and, if ``counted``,
    ``rows``, how many the key has. Rows that tie may take each other's places."""
    keys = key_names(contract)
    keyed = with_keys(df, contract).select(*keys, value.alias("row"), F.struct(*order_by).alias("at"))
    if counted:
        return keyed.groupBy(*keys).agg(F.max_by("row", "at").alias("row"), F.count("*").alias("rows"))
    w = Window.partitionBy(*keys).orderBy(F.col("at").desc())
    return keyed.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*keys, "row")


def last_wins(df: DataFrame, contract, order_by: list[str]) -> DataFrame:
    """One row a key, the last in ``order_by``, with its key parts."""
    names = df.columns
    return _last(df, contract, F.struct(*names), order_by).select(*[F.col("row")[c].alias(c) for c in names], *key_names(contract))


def _side(df: DataFrame, contract, columns: list[str], order_by: list[str], name: str, counted: bool) -> DataFrame:
    cells = []
    for c in columns:
        v = normalize(F.col("row")[c], contract.column(c))
        cells.append(F.struct(v.typed.alias("typed"), v.raw.alias("raw"), v.shown().alias("shown")).alias(c))
    rows = _last(df, contract, F.struct(*(columns or key_names(contract)[:1])), order_by, counted)
    n = F.col("rows") if counted else F.lit(1).cast("long")
    return rows.select(*key_names(contract), F.struct(n.alias("rows"), *cells).alias(name))


def joined(expected: DataFrame, actual: DataFrame, contract, order_by: tuple[list[str], list[str]], columns: list[str] | None = None, counted: bool = False) -> DataFrame:
    """``kind`` (missing, extra, matched), the keys as text, and ``diffs``, an array of differing
    cells; if ``counted``, also ``source_rows`` and ``target_rows`` of the key. Keys are not
    compared again; null equals null."""
    names = [c for c in columns or [c.name for c in contract.columns] if c not in contract.keys]
    e, a = (_side(df, contract, names, order, name, counted) for df, order, name in ((expected, order_by[0], "e"), (actual, order_by[1], "a")))
    both = e.join(a, key_names(contract), "full_outer")
    cells = []
    for c in names:
        same = F.col(f"e.{c}.typed").eqNullSafe(F.col(f"a.{c}.typed")) & F.col(f"e.{c}.raw").eqNullSafe(F.col(f"a.{c}.raw"))
        cell = F.struct(F.lit(c).alias("column"), F.col(f"e.{c}.shown").alias("expected"), F.col(f"a.{c}.shown").alias("actual"))
        cells.append((~same, cell))
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("matched")
    none = F.array().cast(_CELLS)
    diffs = F.when(kind == "matched", chosen(cells, _CELLS) if cells else none).otherwise(none)
    rows = [F.coalesce(F.col(f"{side}.rows"), F.lit(0)).alias(name) for side, name in (("e", "source_rows"), ("a", "target_rows"))]
    return both.select(*shown_keys(contract), kind.alias("kind"), diffs.alias("diffs"), *(rows if counted else []))


def missing(rows: DataFrame, contract) -> DataFrame:
    return rows.where("kind = 'missing'").select(*contract.keys)


def extra(rows: DataFrame, contract) -> DataFrame:
    return rows.where("kind = 'extra'").select(*contract.keys)


def diffs(rows: DataFrame, contract) -> DataFrame:
    """One row per differing cell."""
    return rows.where(F.size("diffs") > 0).select(*contract.keys, F.inline("diffs"))


def transform_diffs(rows: DataFrame, contract) -> DataFrame:
    return diffs(rows, contract).where(F.col("column").isin([c.name for c in contract.columns if c.transform]))


def counts(rows: DataFrame) -> DataFrame:
    """One row, in one pass over a join that was ``counted``; source and target counts are of all
    rows, duplicates included."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    tally = rows.agg(
        total(F.col("source_rows")).alias("source_count"),
        total(F.col("target_rows")).alias("target_count"),
        F.count_if(F.col("kind") == "missing").alias("missing"),
        F.count_if(F.col("kind") == "extra").alias("extra"),
        total(F.size("diffs")).alias("diffs"),
    )
    return tally.withColumn("mismatch_count", F.expr("missing + extra + diffs"))


def detail(rows: DataFrame, contract, limit: int = 10) -> DataFrame:
    """The first ``limit`` of each list, by key: one pass over the join, every task keeps its
    first ones of each list before they are exchanged."""
    none = F.array(F.struct(*[F.lit(None).cast("string").alias(x) for x in ("column", "expected", "actual")])).cast(_CELLS)
    kind = F.when(F.col("kind") == "matched", "diff").otherwise(F.col("kind")).alias("kind")
    cells = F.when(F.col("kind") == "matched", F.col("diffs")).otherwise(none)
    each = rows.select(*contract.keys, kind, F.inline(cells))
    w = Window.partitionBy("kind").orderBy(*contract.keys, "column")
    first = each.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
    return first.select(*contract.keys, "column", "expected", "actual", "kind")


def row_hashes(df: DataFrame, contract, order_by: list[str], columns: list[str] | None = None) -> DataFrame:
    """Keys and one digest of the normal forms (of ``columns``, if given), nulls and unreadable
    text marked; every part goes with its length, so that none runs into the next. Digests are
    made before the last-wins step, so only they and the order are shuffled."""
    names = columns or [c.name for c in contract.columns]
    # columns of their own: within a function over an array, a form is told again at every mention
    told = df.withColumns({f"__p{i}": normalize(F.col(c), contract.column(c)).part() for i, c in enumerate(names)})
    parts = [x for i in range(len(names)) for x in (F.length(f"__p{i}").cast("string"), F.lit(","), F.col(f"__p{i}"), F.lit(","))]
    digest = F.sha2(F.concat(*parts), 256)
    return _last(told, contract, digest, order_by).select(*key_names(contract), F.col("row").alias("digest"))


def differing_keys(expected: DataFrame, actual: DataFrame, contract, order_by: tuple[list[str], list[str]]) -> DataFrame:
    """Keys on both sides whose digests differ: only keys and digests are shuffled."""
    e = row_hashes(expected, contract, order_by[0]).withColumnRenamed("digest", "d")
    a = row_hashes(actual, contract, order_by[1])
    return e.join(a, key_names(contract)).where("d <> digest").select(*shown_keys(contract))
