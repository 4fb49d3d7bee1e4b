"""Contract against live table: schema facts on the driver, nulls and keys on the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages
from ..contract import ACCEPTED, KEYS_PROPERTY
from .compare import key_names, with_keys

_FINDING = "struct<check:string,column:string,message:string,rows:bigint>"


def findings(live: DataFrame | None, contract, declared: bool = False) -> list[tuple[str, str | None, str]]:
    """(check, column, message) on a missing table, column order, missing columns and types;
    with ``declared`` also on nullability as the table declares it, which Spark's file tables
    do not (there ``schema_report`` looks at the data)."""
    if live is None:
        return [("exists", None, messages.NO_TABLE.format(table=contract.table))]
    names, out = [c.name for c in contract.columns], []
    if live.columns != names:
        out.append(("order", None, messages.COLUMN_ORDER.format(expected=names, got=live.columns)))
    for c in contract.columns:
        if c.name not in live.columns:
            out.append(("missing", c.name, messages.MISSING_COLUMN.format(column=c.name)))
            continue
        field = live.schema[c.name]
        if not isinstance(field.dataType, ACCEPTED[c.type]):
            out.append(("type", c.name, messages.TYPE_MISMATCH.format(column=c.name, expected=c.type, got=field.dataType.simpleString())))
        if declared and field.nullable != c.nullable:
            out.append(("nullability", c.name, messages.NULLABILITY.format(column=c.name, expected=c.nullable, got=field.nullable)))
    return out


def schema_errors(live: DataFrame | None, contract, declared: bool = False) -> list[str]:
    """The messages of ``findings``."""
    return [message for _, _, message in findings(live, contract, declared)]


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    """A catalog table, or None if there is none of that name."""
    return spark.read.table(name) if spark.catalog.tableExists(name) else None


def declared_key_errors(spark: SparkSession, table: str, contract) -> list[str]:
    """Whether the key that ``Contract.ddl`` left in the table's properties is the contract's."""
    row = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == KEYS_PROPERTY).first()
    got = row["value"].split(",") if row else []
    return [] if got == list(contract.keys) else [messages.PRIMARY_KEY.format(expected=list(contract.keys), got=got)]


def null_counts(live: DataFrame, contract) -> DataFrame:
    """Nulls of every column that the contract forbids them in, one pass."""
    cols = [c.name for c in contract.columns if not c.nullable and c.name in live.columns]
    row = live.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])))


def schema_report(live: DataFrame | None, contract, waiting: DataFrame | None = None) -> DataFrame:
    """``check, column, message, rows``: the findings, each with the rows it concerns, and a
    nullability finding for every column that holds nulls against the contract; one pass. Of a
    table that is missing the rows are those that wait to be loaded."""
    found = findings(live, contract)
    if live is None:
        [(check, _, message)] = found
        count = waiting.agg(F.count("*").alias("rows"))
        return count.select(F.lit(check).alias("check"), F.lit(None).cast("string").alias("column"), F.lit(message).alias("message"), "rows")
    named = [c for c in contract.columns if c.name in live.columns]
    nulls = {c.name: F.count_if(F.col(c.name).isNull()) for c in named if not c.nullable}
    row = live.agg(F.count("*").alias("__n"), *[n.alias(c) for c, n in nulls.items()])
    out = [F.struct(F.lit(check).alias("check"), F.lit(col).cast("string").alias("column"), F.lit(message).alias("message"), F.col("__n").alias("rows")) for check, col, message in found]
    for c in nulls:
        message = messages.NULLABILITY.format(column=c, expected=False, got=True)
        out.append(F.when(F.col(c) > 0, F.struct(F.lit("nullability").alias("check"), F.lit(c).alias("column"), F.lit(message).alias("message"), F.col(c).alias("rows"))))
    return row.select(F.inline(F.array_compact(F.array(*[x.cast(_FINDING) for x in out]))))


def live_facts(live: DataFrame, contract) -> DataFrame:
    """One row: ``rows``, ``nulls`` (a map of the nulls in every column that the contract forbids
    them in), ``null_keys``, ``duplicate_keys`` (keys that occur more than once) and
    ``surplus_rows`` (rows beyond their first). One pass and one pre-aggregated shuffle."""
    null_key = F.lit(False)
    for k in key_names(contract):
        null_key = null_key | (F.col(k) == "N:")
    guarded = [c.name for c in contract.columns if not c.nullable and c.name in live.columns]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"__n{i}") for i, c in enumerate(guarded)]
    per = with_keys(live, contract).groupBy(*key_names(contract)).agg(F.count("*").alias("__rows"), F.count_if(null_key).alias("__null_keys"), *nulls)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    by_column = [x for i, c in enumerate(guarded) for x in (F.lit(c), zero(F.col(f"__n{i}")))]
    return per.agg(
        zero(F.col("__rows")).alias("rows"), (F.create_map(*by_column) if by_column else F.create_map().cast("map<string,bigint>")).alias("nulls"), zero(F.col("__null_keys")).alias("null_keys"),
        F.count_if(F.col("__rows") > 1).alias("duplicate_keys"), zero(F.col("__rows") - 1).alias("surplus_rows"),
    )


def data_errors(facts, contract) -> list[str]:
    """Messages on a row of ``live_facts``: columns with nulls that the contract forbids, and a
    key that is none, for a part of it is null or it occurs more than once."""
    out = [messages.NULLABILITY.format(column=c.name, expected=False, got=True) for c in contract.columns if facts["nulls"].get(c.name)]
    if facts["null_keys"] or facts["duplicate_keys"]:
        out.append(messages.PRIMARY_KEY.format(expected=list(contract.keys), got=[]))
    return out


def key_integrity(live: DataFrame, contract) -> DataFrame:
    """Rows with a null key part, keys that occur more than once, and the rows beyond their
    first; one pre-aggregated shuffle."""
    return live_facts(live, contract).select("null_keys", "duplicate_keys", "surplus_rows")
