"""Data-quality rules over a raw feed: one pass tells all flags, for counts and samples alike; a
unique column costs one pre-aggregated shuffle, and one more reading for samples if it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import inputs_of, parse
from ..functions.values import ascii_digits, in_range, is_empty, java_regex, readable, strip

SAMPLES = 5
REPORT = "rule_id string, column string, failing_rows long, samples array<string>"


def flags(contract, feed_columns: list[str]) -> list[tuple[str, str, Column]]:
    """(rule id, column, failing condition) of every rule but uniqueness. Rules on inputs of
    transforms go by source names, the others by target names."""
    own = set(feed_columns)
    out: list[tuple[str, str, Column]] = []
    inputs = {x for c in contract.columns if c.transform and not c.nullable for x in inputs_of(parse(c.transform, own)) if x in own}
    out += [(f"transform_input_not_null:{x}", x, is_empty(F.col(x))) for x in sorted(inputs)]
    for c in contract.columns:
        if not c.source_name or c.source_name not in own:
            continue
        raw = F.col(c.source_name)
        s, there = strip(raw), ~is_empty(raw)

        def add(rule: str, bad: Column, c=c) -> None:
            out.append((f"{rule}:{c.name}", c.name, F.coalesce(bad, F.lit(False))))

        if not c.nullable:
            add("not_null", is_empty(raw))
        if c.type != "string":
            add("type", there & ~F.coalesce(readable(raw, c), F.lit(False)))
        if c.type in ("integer", "decimal") and c.range:
            add("range", there & ~in_range(ascii_digits(s), *c.range))
        if c.max_length:
            add("max_length", there & (F.char_length(raw) > c.max_length))
        if c.regex:
            add("regex", there & ~s.rlike(java_regex(c.regex)))
        if c.allowed_values:
            add("allowed_values", there & ~s.isin(list(c.allowed_values)))
    return out


def unique_columns(contract, feed_columns: list[str]) -> list[tuple[str, str, str]]:
    """(rule id, column, feed column) of the uniqueness rules."""
    return [(f"unique:{c.name}", c.name, c.source_name) for c in contract.columns if c.unique and c.source_name in feed_columns]


def _repeated(feed: DataFrame, source: str) -> DataFrame:
    """``__v, n``: populated raw values that occur more than once."""
    values = feed.where(~is_empty(F.col(source))).groupBy(F.col(source).alias("__v"))
    return values.agg(F.count("*").alias("n")).where("n > 1")


def _first_column(contract, feed: DataFrame) -> Column:
    return F.col(contract.source_columns[0] if contract.source_columns else feed.columns[0])


def failures(feed: DataFrame, contract, order_by: list[str], only: set[str] | None = None) -> DataFrame | None:
    """``rule_id, column, sample`` and the order columns, one row per failing row and rule (of
    ``only``, if given); None without rules. A sample is the value of the first feed column.
    Flags are told once for all rules of a row."""
    first, order = _first_column(contract, feed).cast("string"), [F.col(c) for c in order_by]
    rules_ = [x for x in flags(contract, feed.columns) if only is None or x[0] in only]
    parts = []
    if rules_:
        told = feed.select(first.alias("sample"), *order, *[bad.alias(f"__b{i}") for i, (_, _, bad) in enumerate(rules_)])
        named = [F.when(F.col(f"__b{i}"), F.struct(F.lit(rule).alias("rule_id"), F.lit(col).alias("column"))) for i, (rule, col, _) in enumerate(rules_)]
        # outer, and filtered after: a filter before would tell all flags again
        rows = told.select("sample", *order_by, F.inline_outer(F.array_compact(F.array(*named))))
        parts.append(rows.where("rule_id is not null"))
    for rule, col, source in unique_columns(contract, feed.columns):
        if only is not None and rule not in only:
            continue
        rows = feed.join(_repeated(feed, source), F.col(source) == F.col("__v"), "left_semi")
        parts.append(rows.select(first.alias("sample"), *order, F.lit(rule).alias("rule_id"), F.lit(col).alias("column")))
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _repeated_counts(feed: DataFrame, contract) -> dict[str, tuple[str, int]]:
    """Rule id -> (column, failing rows) of the uniqueness rules that fail."""
    found: dict[str, tuple[str, int]] = {}
    for rule, col, source in unique_columns(contract, feed.columns):
        n = _repeated(feed, source).agg(F.sum("n")).first()[0]
        if n:
            found[rule] = (col, n)
    return found


def failing_counts(feed: DataFrame, contract) -> dict[str, tuple[str, int]]:
    """Rule id -> (column, failing rows) of the rules that fail: one aggregate over the feed for
    all flags, one per unique column. One row each reaches the driver."""
    found: dict[str, tuple[str, int]] = {}
    rules_ = flags(contract, feed.columns)
    if rules_:
        row = feed.agg(*[F.count_if(bad).alias(f"f{i}") for i, (_, _, bad) in enumerate(rules_)]).first()
        found |= {rule: (col, row[i]) for i, (rule, col, _) in enumerate(rules_) if row[i]}
    return found | _repeated_counts(feed, contract)


def _first_samples(rows: DataFrame, order_by: list[str]) -> DataFrame:
    """Up to SAMPLES rows a rule in row order; every task keeps its first ones before they are
    exchanged."""
    w = Window.partitionBy("rule_id").orderBy(*order_by)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= SAMPLES).select("rule_id", "__n", "sample")


def report(feed: DataFrame, contract, order_by: list[str]) -> DataFrame:
    """``rule_id, column, failing_rows, samples``: failing rules, up to SAMPLES samples each in
    row order. Runs at once: the feed is read once for all flags, its failing rows (samples and
    order alone) are kept while they are counted and samples are chosen; they are told again from
    the feed where an executor that held them is lost. Unique columns are read on their own."""
    found: dict[str, tuple[str, int]] = {}
    parts, names = [], [rule for rule, _, _ in flags(contract, feed.columns)]
    kept = failures(feed, contract, order_by, set(names)).persist() if names else None
    try:
        if kept is not None:
            for r in kept.groupBy("rule_id", "column").agg(F.count("*").alias("n")).collect():  # a row a rule
                found[r["rule_id"]] = (r["column"], r["n"])
            if found:
                parts.append(_first_samples(kept, order_by))
        repeated = _repeated_counts(feed, contract)
        if repeated:
            parts.append(_first_samples(failures(feed, contract, order_by, set(repeated)), order_by))
        samples: dict[str, list[str]] = {}
        for part in parts:
            for r in part.orderBy("rule_id", "__n").collect():  # SAMPLES rows a rule
                samples.setdefault(r["rule_id"], []).append(r["sample"])
    finally:
        if kept is not None:
            kept.unpersist()
    rows = [(rule, col, n, samples.get(rule, [])) for rule, (col, n) in (found | repeated).items()]
    return feed.sparkSession.createDataFrame(rows, REPORT)


def totals(report_: DataFrame) -> DataFrame:
    """Failing rules, and the sum of their failing rows."""
    return report_.agg(F.count("*").alias("failing_rules"), F.coalesce(F.sum("failing_rows"), F.lit(0)).alias("failing_rows"))
