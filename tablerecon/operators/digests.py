"""Comparison by digests: what agrees is not shuffled.

1. Every row falls into a range of keys, by a hash of its key. Both sides are summed up per range
   to an order-free digest of keys and normal forms; partial sums meet in the exchange, a row a
   task and range, and the rows stay where they are.
2. In ranges that differ, and in those where a key comes twice (there the last row counts), rows
   are told by key and digest alone.
3. Cells are looked at for the keys whose digests differ, or that one side lacks.

Where the ranges that differ hold most of the rows, steps 2 and 3 would read and shuffle nearly all
of both sides twice more; then the rows are compared at once instead, with the same result.

Digests have 128 bits, so equal ones are taken for equal tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import normalize
from . import compare

#: ranges of keys
RANGES = 1 << 16
#: the same where it is only asked whether any differs; they keep sums far from overflow
SUMS = 1 << 10
#: differing keys that are sent to every task; more are joined
SENT_KEYS = 1 << 20
_LOW = 0xFFFFFFFF


def summed(rows: DataFrame, by: str, parts: list[Column], *more: Column) -> DataFrame:
    """``by, __n``, the columns ``more`` and an order-free digest of the rows' parts: the sums of
    both halves of two hashes. A sum cannot overflow below 2^31 rows of a group. A hash over
    several parts takes in where each ends, and parts are worked out once for both hashes (within
    a function over an array they would be told again at every mention)."""
    told = rows.withColumns({f"__p{i}": p for i, p in enumerate(parts)})
    own = [f"__p{i}" for i in range(len(parts))]
    hashed = told.withColumns({f"__h{seed}": F.xxhash64(F.lit(seed), *own) for seed in (1, 2)})
    halves = [f(F.col(f"__h{seed}")) for seed in (1, 2) for f in (lambda h: h.bitwiseAND(F.lit(_LOW)), lambda h: F.shiftrightunsigned(h, 32))]
    return hashed.groupBy(by).agg(F.count("*").alias("__n"), *more, *[F.sum(x).alias(f"__d{i}") for i, x in enumerate(halves)])


def _parts(contract, columns: list[str]) -> list[Column]:
    return [normalize(F.col(c), contract.column(c)).part() for c in columns]


def _ranged(df: DataFrame, contract, ranges: int) -> DataFrame:
    keyed = compare.with_keys(df, contract)
    return keyed.withColumn("__range", F.pmod(F.xxhash64(*compare.key_names(contract)), F.lit(ranges)).cast("int"))


def range_digests(df: DataFrame, contract, columns: list[str], ranges: int = RANGES) -> DataFrame:
    """``__range, __n`` and the digest of the keys and normal forms of its rows; one pass, without
    an exchange of rows."""
    return summed(_ranged(df, contract, ranges), "__range", [*map(F.col, compare.key_names(contract)), *_parts(contract, columns)])


def ranges_side_by_side(expected: DataFrame, actual: DataFrame, contract, columns: list[str], ranges: int = RANGES) -> DataFrame:
    """``__range, differs`` and ``rows``, how many it has on both sides; a row a range."""
    e, a = (range_digests(df, contract, columns, ranges) for df in (expected, actual))
    facts = ["__n", *(f"__d{i}" for i in range(4))]
    e = e.select("__range", F.struct(*facts).alias("e"))
    a = a.select("__range", F.struct(*facts).alias("a"))
    n = F.coalesce(F.col("e.__n"), F.lit(0)) + F.coalesce(F.col("a.__n"), F.lit(0))
    return e.join(a, "__range", "full_outer").select("__range", (~F.col("e").eqNullSafe(F.col("a"))).alias("differs"), n.alias("rows"))


def same(expected: DataFrame, actual: DataFrame, contract) -> bool:
    """Whether both sides hold the same keys and normal forms, each row as often; for sides in one
    of which no key comes twice, that is whether a comparison finds nothing. Each side is read
    once, and no rows are exchanged."""
    names = [c.name for c in contract.columns if c.name not in contract.keys]
    return not ranges_side_by_side(expected, actual, contract, names, SUMS).where("differs").take(1)


def _repeating(expected: DataFrame, contract, ranges: int, side_by_side: DataFrame) -> DataFrame:
    """``__range`` of the ranges that agree and in which a key comes twice."""
    agreeing = side_by_side.where("not differs").select("__range")
    names = compare.key_names(contract)
    keys = _ranged(expected, contract, ranges).join(F.broadcast(agreeing), "__range", "left_semi")
    keys = keys.groupBy("__range", F.xxhash64(*names).alias("__key"), F.xxhash64(F.lit(3), *names).alias("__key2"))
    return keys.agg(F.count("*").alias("n")).where("n > 1").select("__range").distinct()


def differing_ranges(expected: DataFrame, actual: DataFrame, contract, columns: list[str], ranges: int = RANGES, keys_unique: bool = False, side_by_side: DataFrame | None = None) -> DataFrame:
    """``__range`` of the ranges that must be looked into. Unless keys are known to be unique,
    ranges in which one comes twice are among them: there both sides may hold the same rows and
    yet end with different ones. Where digests agree it is enough to ask one side."""
    both = ranges_side_by_side(expected, actual, contract, columns, ranges) if side_by_side is None else side_by_side
    out = both.where("differs").select("__range")
    return out if keys_unique else out.unionByName(_repeating(expected, contract, ranges, both))


def joined(
    expected: DataFrame, actual: DataFrame, contract, order_by: tuple[list[str], list[str]], columns: list[str] | None = None, ranges: int = RANGES, keys_unique: bool = False
) -> DataFrame:
    """The rows of ``compare.joined`` that are missing, extra or differ; those that agree are
    left out, and mostly never shuffled. Runs at once as far as the differing keys."""
    names = [c for c in columns or [c.name for c in contract.columns] if c not in contract.keys]
    both = ranges_side_by_side(expected, actual, contract, names, ranges).persist()  # a row a range
    n, differing = both.agg(F.sum("rows"), F.sum(F.when(F.col("differs"), F.col("rows")))).first()
    if 2 * (differing or 0) > (n or 0):
        return compare.joined(expected, actual, contract, order_by, columns).where("kind <> 'matched' or size(diffs) > 0")
    found = differing_ranges(expected, actual, contract, names, ranges, keys_unique, both).persist()
    found.count()
    keys = compare.key_names(contract)

    def within(df: DataFrame) -> DataFrame:
        """The rows of these ranges: their numbers are RANGES at most, so they are sent."""
        return _ranged(df, contract, ranges).join(F.broadcast(found), "__range", "left_semi").drop("__range", *keys)

    e, a = within(expected), within(actual)
    hashes = [compare.row_hashes(df, contract, order, names).withColumnRenamed("digest", name) for df, order, name in ((e, order_by[0], "e"), (a, order_by[1], "a"))]
    differing = hashes[0].join(hashes[1], keys, "full_outer").where(~F.col("e").eqNullSafe(F.col("a"))).select(*keys).persist()
    few = differing.count() <= SENT_KEYS

    def of_keys(df: DataFrame) -> DataFrame:
        own = F.broadcast(differing) if few else differing
        return compare.with_keys(df, contract).join(own, keys, "left_semi").drop(*keys)

    return compare.joined(of_keys(e), of_keys(a), contract, order_by, columns)


def key_sets(expected: DataFrame, actual: DataFrame, contract, group: tuple[str, str]) -> DataFrame:
    """``group, expected_rows, actual_rows, expected_keys, actual_keys`` (estimates by a sketch),
    ``agrees, only_expected, only_actual``: whether both sides have the same keys, per group (a
    SQL expression a side). Groups are first told by digest; keys are held against each other
    only in groups that differ, where repeated keys count once."""

    def side(df: DataFrame, by: str) -> DataFrame:
        return compare.with_keys(df.withColumn("__group", F.expr(by).cast("string")), contract)

    keys = compare.key_names(contract)
    sides = [side(df, by) for df, by in zip((expected, actual), group, strict=True)]
    facts = []
    for df, name in zip(sides, ("e", "a"), strict=True):
        own = summed(df, "__group", [F.col(k) for k in keys], F.approx_count_distinct("__h1").alias("keys")).withColumnRenamed("__n", "rows")
        facts.append(own.select(F.col("__group").alias(f"{name}_group"), F.struct("rows", "keys").alias(name), F.struct("rows", *(f"__d{i}" for i in range(4))).alias(f"{name}_digest")))
    both = facts[0].join(facts[1], F.col("e_group").eqNullSafe(F.col("a_group")), "full_outer")
    named = F.when(F.col("e").isNotNull(), F.col("e_group")).otherwise(F.col("a_group"))
    both = both.select(named.alias("group"), "e", "a", F.col("e_digest").eqNullSafe(F.col("a_digest")).alias("same")).persist()  # a row a group
    differing = both.where(~F.col("same")).select("group")
    marked = []
    for df, name in zip(sides, ("e", "a"), strict=True):
        rows = df.join(differing, F.col("__group").eqNullSafe(F.col("group")), "left_semi")
        marked.append(rows.select(F.coalesce(F.concat(F.lit("="), "__group"), F.lit("")).alias("g"), *keys, F.lit(name == "e").alias("is_e")))
    per = marked[0].unionByName(marked[1]).groupBy("g", *keys).agg(F.max("is_e").alias("e"), F.max(~F.col("is_e")).alias("a"))
    only = per.groupBy("g").agg(F.count_if(~F.col("a")).alias("only_expected"), F.count_if(~F.col("e")).alias("only_actual"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = both.withColumn("g", F.coalesce(F.concat(F.lit("="), "group"), F.lit(""))).join(only, "g", "left")
    counts = [zero(F.col(f"{x}.{f}")).alias(f"{name}_{f}") for f in ("rows", "keys") for x, name in (("e", "expected"), ("a", "actual"))]
    lone = [zero(F.col(c)).alias(c) for c in ("only_expected", "only_actual")]
    agrees = (zero(F.col("only_expected")) + zero(F.col("only_actual")) == 0).alias("agrees")
    return out.select("group", *counts, agrees, *lone)
