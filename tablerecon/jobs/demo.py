"""The library's operations over the order, line item, customer and event tables: a feed with
seeded defects against a drifted target. Feed and target are SQL that Spark and DuckDB share,
so every query has an independent DuckDB version (``demo_sql``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as contracts
from ..functions.transforms import compiled, expected, parse
from ..functions.values import in_range, normalize
from ..operators import compare, rules, schema_check
from ..sources import files, io
from . import demo_sql, pipeline, report

Query = Callable[[SparkSession, str], DataFrame]

FEED_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDERS = {
    "contract_name": "orders",
    "version": "1.0",
    "source": {"type": "csv", "columns": FEED_COLUMNS},
    "target": {"type": "table", "table": "orders_target"},
    "keys": ["order_id"],
    "columns": [
        {"name": "order_id", "source_name": "o_orderkey", "type": "integer", "nullable": False, "unique": True},
        {"name": "customer_id", "source_name": "o_custkey", "type": "integer", "nullable": False},
        {"name": "status", "type": "string", "nullable": False, "transform": "lower({o_orderstatus})"},
        {"name": "status_code", "source_name": "o_orderstatus", "type": "string", "nullable": False, "allowed_values": ["F", "O", "P"], "max_length": 1},
        {"name": "total", "source_name": "o_totalprice", "type": "decimal", "nullable": False, "scale": 2, "range": [0, 1000000], "transform": "round({o_totalprice}, 1)"},
        {"name": "order_date", "source_name": "o_orderdate", "type": "date", "nullable": False},
        {"name": "priority", "source_name": "o_orderpriority", "type": "string", "nullable": False, "max_length": 15, "regex": "[1-4]-[A-Z]"},
        {"name": "label", "type": "string", "nullable": False, "transform": "{o_orderpriority}/{o_orderstatus}"},
    ],
}
#: the same for whole runs: every priority of the table is allowed
RUN = {**ORDERS, "contract_name": "orders_run", "columns": [{**c, "regex": "[0-9]-[A-Z]"} if "regex" in c else c for c in ORDERS["columns"]]}
LINES = {
    "contract_name": "lines",
    "version": "1",
    "source": {"type": "table", "columns": ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]},
    "target": {"type": "table", "table": "lines"},
    "keys": ["order_id", "line"],
    "columns": [
        {"name": "order_id", "source_name": "l_orderkey", "type": "integer", "nullable": False},
        {"name": "line", "source_name": "l_linenumber", "type": "integer", "nullable": False},
        {"name": "quantity", "source_name": "l_quantity", "type": "decimal", "nullable": False},
        {"name": "flag", "source_name": "l_returnflag", "type": "string", "nullable": False},
    ],
}
#: columns of a line item that put those of one key in order
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
CONTRACT = contracts.load(ORDERS)
RUN_CONTRACT = contracts.load(RUN)
LINE_CONTRACT = contracts.load(LINES)
SPARK_DATE = "date_format(o_orderdate, 'yyyy-MM-dd')"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql(spark: SparkSession, d: str, sql: str) -> DataFrame:
    text = sql.replace("{date}", SPARK_DATE).replace("from orders", "from {orders}")
    return spark.sql(text, orders=_t(spark, d, "orders"))


def feed(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, demo_sql.FEED_SQL)


def clean_feed(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, demo_sql.CLEAN_SQL)


def target(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, demo_sql.TARGET_SQL)


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return expected(feed(spark, d), CONTRACT, carry=["seq"])


def _joined(spark: SparkSession, d: str, columns: list[str] | None = None, counted: bool = False) -> DataFrame:
    return compare.joined(_expected(spark, d), target(spark, d), CONTRACT, (["seq"], ["order_id"]), columns, counted)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that the whole cluster can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _write_csv(rows: DataFrame, header: list[str], columns: list[str], path: str) -> str:
    named = rows.select(*[F.col(a).alias(b) for a, b in zip(columns, header, strict=True)])
    writer = named.write.option("header", True).option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _write_parts(rows: DataFrame, columns: list[str], order: list[str], path: str, by: list[str] | None = None, header: bool = True, **options: str) -> str:
    """A feed in parts, in ``order``, with a header before the first row: many tasks write it, and
    each sorts its own share. ``by`` gives a folder, and so a feed, per value."""
    by = by or []
    cells = rows.select(*[F.col(c).cast("string").alias(c) for c in columns], *by, F.struct(*order).alias("__at"))
    if header:
        one = rows.select(*by).distinct() if by else rows.sparkSession.range(1)
        cells = cells.unionByName(one.select(*[F.lit(c).alias(c) for c in columns], *by), allowMissingColumns=True)  # no place: first
    dealt = cells.repartitionByRange(*by, "__at").sortWithinPartitions(*by, "__at")
    writer = dealt.select(*columns, *by).write.options(emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options)
    (writer.partitionBy(*by) if by else writer).csv(path)
    return path


def _in_parts(**source) -> contracts.Contract:
    return contracts.load({**ORDERS, "source": {**ORDERS["source"], "parts": True, **source}})


def _csv(spark: SparkSession, d: str, header: list[str], columns: list[str] = FEED_COLUMNS) -> str:
    """The feed as files, under another header."""
    return _write_csv(feed(spark, d), header, columns, _folder(spark, "feed"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    return rules.report(feed(spark, d), CONTRACT, ["seq"])


# --- sources and targets


def read_feed(spark: SparkSession, d: str) -> DataFrame:
    return files.read_feed(spark, _csv(spark, d, FEED_COLUMNS), CONTRACT)


def read_target(spark: SparkSession, d: str) -> DataFrame:
    """Columns in another order and one too many, as loaded by somebody else."""
    path = _folder(spark, "target")
    rows = target(spark, d)
    rows.select(*reversed(rows.columns), F.lit(1).alias("loaded_by")).write.parquet(path)
    got = io.read_target(spark, CONTRACT, path=path)
    return got.select("order_id", "customer_id", "status", F.col("total").cast("string"), F.col("order_date").cast("string"), "priority", "label")


def target_query(spark: SparkSession, d: str) -> DataFrame:
    return io.query(spark, "select order_id, customer_id from {t} where order_id % 50 = :r", {"t": target(spark, d)}, r=1)


def row_counts(spark: SparkSession, d: str) -> DataFrame:
    side = lambda df, name: df.agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
    return side(feed(spark, d), "source").unionByName(side(target(spark, d), "target"))


def describe_schema(spark: SparkSession, d: str) -> DataFrame:
    return io.profile(target(spark, d))


def load_expected(spark: SparkSession, d: str) -> DataFrame:
    """Loaded twice, which must leave the same table."""
    path = _folder(spark, "target")
    counts = [io.load_expected(_expected(spark, d), CONTRACT, path) for _ in range(2)]
    assert counts[0] == counts[1]
    got = io.read_target(spark, CONTRACT, path=path)
    return got.select(F.col("order_id").cast("string"), F.col("customer_id").cast("string"), "status", F.col("total").cast("string"), F.col("order_date").cast("string"), "priority")


def contract_schema(spark: SparkSession, d: str) -> DataFrame:
    """What was loaded, read under the contract's schema: declared nullability beside the nulls
    that are there."""
    path = _folder(spark, "target")
    io.load_expected(_expected(spark, d), CONTRACT, path)
    declared = spark.createDataFrame([(f.name, f.nullable) for f in CONTRACT.struct()], "name string, nullable boolean")
    return io.profile(spark.read.schema(CONTRACT.struct()).parquet(path)).join(declared, "name").select("name", "type", "nullable", "n_rows", "n_nulls")


def feed_files(spark: SparkSession, d: str) -> DataFrame:
    """A prefix of several feeds in parts, one per order status."""
    path = _folder(spark, "feed")
    _write_parts(feed(spark, d).withColumn("part", F.col("o_orderstatus")), FEED_COLUMNS, ["seq"], path, ["part"])
    part = F.regexp_extract("file", "part=([^/]+)$", 1).alias("part")
    return files.file_counts(spark, path, _in_parts()).select(part, "records", "rows")


# --- file checks


def _shape(rows: DataFrame) -> DataFrame:
    return rows.select("check", "position", "message").distinct()


def header_errors(spark: SparkSession, d: str) -> DataFrame:
    header = [*FEED_COLUMNS[:3], "total_price", *FEED_COLUMNS[4:]]
    return _shape(files.header_errors(spark, _csv(spark, d, header), CONTRACT))


def header_count_errors(spark: SparkSession, d: str) -> DataFrame:
    own = [c for c in FEED_COLUMNS if c != "o_totalprice"]
    return _shape(files.header_errors(spark, _csv(spark, d, own, own), CONTRACT))


def _bytes(spark: SparkSession, d: str, every: int, byte: str) -> str:
    """Customer names in a feed in parts, with a byte in every few of them."""
    path = _folder(spark, "bytes")
    name = F.encode("c_name", "UTF-8")
    broken = F.when(F.col("c_custkey") % every == 0, F.concat(name, F.unhex(F.lit(byte)))).otherwise(name)
    _t(spark, d, "customer").select(broken.cast("string").alias("line")).write.text(path)
    return path


def encoding_errors(spark: SparkSession, d: str) -> DataFrame:
    return _shape(files.encoding_errors(spark, _bytes(spark, d, 29, "FF"), _in_parts()))


def encoding_declared(spark: SparkSession, d: str) -> DataFrame:
    """cp1252 has no character for 0x81; é would be fine."""
    contract = contracts.load({**ORDERS, "source": {**ORDERS["source"], "parts": True}, "metadata": {"encoding": "cp1252"}})
    return _shape(files.encoding_errors(spark, _bytes(spark, d, 23, "E981"), contract))


def _ragged(spark: SparkSession, d: str) -> tuple[str, contracts.Contract]:
    """Lines of the feed in order, in parts, every 53rd of them cut before its last field. Numbers
    run through all parts."""
    path = _folder(spark, "ragged")
    cells = [F.col(c) for c in FEED_COLUMNS]
    line = F.when(F.col("seq") % 53 == 1, F.concat_ws(",", *cells[:5])).otherwise(F.concat_ws(",", *cells))
    feed(spark, d).orderBy("seq").select(line.alias("line")).write.text(path)
    return path, _in_parts(header=False)


def ragged_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.ragged_rows(spark, *_ragged(spark, d)).select("record", "number", "width", "expected")


def ragged_errors(spark: SparkSession, d: str) -> DataFrame:
    return _shape(files.ragged_errors(spark, *_ragged(spark, d)))


def row_count_errors(spark: SparkSession, d: str) -> DataFrame:
    """The feed beside an empty file, under one prefix."""
    path = _folder(spark, "feed")
    _write_csv(feed(spark, d), FEED_COLUMNS, FEED_COLUMNS, f"{path}/a")
    spark.createDataFrame([], "line string").coalesce(1).write.text(f"{path}/b")
    contract = contracts.load({**ORDERS, "metadata": {"expected_row_count": 7}})
    return _shape(files.count_errors(files.file_counts(spark, f"{path}/*", contract), contract))


def row_count_check(spark: SparkSession, d: str) -> DataFrame:
    return files.row_count_check(feed(spark, d), 7)


def control_totals(spark: SparkSession, d: str) -> DataFrame:
    return files.control_totals(_t(spark, d, "events"), "value")


# --- transforms and normal forms


def map_columns(spark: SparkSession, d: str) -> DataFrame:
    return _expected(spark, d).select("order_id", "customer_id", "status_code")


def _transform(text: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Query:
    """A transform over the customers."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = prepare(_t(spark, d, "customer"))
        return df.select(F.col("c_custkey").alias("k"), compiled(parse(text, set(df.columns))).cast("string").alias("value"))

    return run


def _padded(df: DataFrame) -> DataFrame:
    return df.withColumn("padded", F.concat(F.lit("\t  "), "c_mktsegment", F.lit(" \u3000\n")))


def transform_round(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    df = _t(spark, d, "customer").withColumn("b", b).withColumn("big", F.lit("123456789012345678901234567890.125"))
    said = {"value": "round(b, 1)", "hundreds": "round(b, -2)", "large": "round(big, 2)"}
    return df.select(F.col("c_custkey").alias("k"), *[compiled(parse(text, set(df.columns))).alias(name) for name, text in said.items()])


def expected_rows(spark: SparkSession, d: str) -> DataFrame:
    return _expected(spark, d).drop("seq")


def _values(table: str, column: str, key: str, text: Callable[[Column, Column], Column], **spec) -> Query:
    """A normal form over a table's values written in awkward ways."""
    c = contracts.Column(name="x", nullable=True, **spec)

    def run(spark: SparkSession, d: str) -> DataFrame:
        v = normalize(text(F.col(column), F.col(key)), c)
        return _t(spark, d, table).select(F.col(key).cast("long").alias("k"), v.typed.cast("string").alias("value"), v.raw.alias("unreadable"))

    return run


def _integers(c: Column, k: Column) -> Column:
    minus = F.concat(F.lit(" -"), c.cast("string"), F.lit(".99999999999 "))
    return F.when(k % 3 == 0, minus).when(k % 3 == 1, F.concat(F.lit("x"), c.cast("string"))).otherwise(c.cast("string"))


def _dates(c: Column, k: Column) -> Column:
    return F.when(k % 7 == 0, "2024-02-30").otherwise(F.date_format(c, " yyyy-M-d"))


def _times(c: Column, k: Column) -> Column:
    return F.when(k % 5 == 0, "soon").otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _of_list(texts: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))


def normalize_blank(spark: SparkSession, d: str) -> DataFrame:
    """Blanks and nulls are null, the text NaN is not, the NaN of a double is."""
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "   ").when(k % 5 == 1, None).when(k % 5 == 3, "NaN").otherwise(F.col("o_orderpriority"))
    v = normalize(text, contracts.Column(name="x", type="string", nullable=True))
    nan = F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0))
    number = normalize(nan, contracts.Column(name="x", type="decimal", nullable=True))
    is_null = number.typed.isNull() & number.raw.isNull()
    return _t(spark, d, "orders").select(k.alias("k"), v.typed.alias("value"), v.raw.alias("unreadable"), is_null.alias("nan_is_null"))


def normalize_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each order key takes its turn at the edge values of three types."""
    k, parts = F.col("o_orderkey"), []
    for kind, texts in demo_sql.EDGES.items():
        v = normalize(_of_list(texts, k), contracts.Column(name="x", type=kind, nullable=True, date_format="%d.%m.%Y"))
        parts.append(F.struct(F.lit(kind).alias("kind"), v.typed.cast("string").alias("value"), v.raw.alias("unreadable")))
    return _t(spark, d, "orders").select(k.alias("k"), F.inline(F.array(*parts)))


def range_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(k.alias("k"), in_range(_of_list(demo_sql.RANGES, k), 0, 100).alias("passes"))


# --- rules, schema, keys


def _rule(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _report(spark, d).where(F.split("rule_id", ":")[0] == name).select("rule_id", "column", "failing_rows")

    return run


def dq_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("rule_id", "column", "failing_rows")


def dq_samples(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("rule_id", F.to_json("samples").alias("samples"))


def dq_totals(spark: SparkSession, d: str) -> DataFrame:
    return rules.totals(_report(spark, d))


def schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """A live table without one column, with a double for a decimal and with nulls."""
    priority = F.when(F.col("o_orderkey") % 31 != 0, F.col("o_orderpriority"))
    live = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.lower("o_orderstatus").alias("status"), F.col("o_orderstatus").alias("status_code"),
        F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("date").alias("order_date"), priority.alias("priority"),
    )
    return schema_check.schema_report(live, CONTRACT)


def nullability_check(spark: SparkSession, d: str) -> DataFrame:
    return schema_check.null_counts(target(spark, d), CONTRACT)


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, d, "lineitem").withColumn("at", F.struct(*LINE_ORDER))
    quantity = F.col("l_quantity") + F.when(F.col("l_partkey") % 41 == 0, 1).otherwise(0)
    actual = rows.where("l_orderkey % 50 <> 0").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), quantity.cast("decimal(18,2)").alias("quantity"), F.col("l_returnflag").alias("flag"), "at"
    )
    return expected(rows, LINE_CONTRACT, carry=["at"]), actual


def key_integrity(spark: SparkSession, d: str) -> DataFrame:
    return schema_check.key_integrity(_lines(spark, d)[0], LINE_CONTRACT)


def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    return compare.with_keys(_expected(spark, d), CONTRACT).select("seq", F.col("__k0").alias("key"))


# --- comparison


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = compare.last_wins(_lines(spark, d)[0], LINE_CONTRACT, ["at"])
    return rows.select("order_id", "line", F.col("quantity").cast("decimal(18,2)").cast("string").alias("quantity"), "flag")


def missing_in_target(spark: SparkSession, d: str) -> DataFrame:
    return compare.missing(_joined(spark, d), CONTRACT)


def extra_in_target(spark: SparkSession, d: str) -> DataFrame:
    return compare.extra(_joined(spark, d), CONTRACT)


def column_diffs(spark: SparkSession, d: str) -> DataFrame:
    return compare.diffs(_joined(spark, d), CONTRACT)


def column_diffs_subset(spark: SparkSession, d: str) -> DataFrame:
    return compare.diffs(_joined(spark, d, ["total", "priority"]), CONTRACT)


def recon_counts(spark: SparkSession, d: str) -> DataFrame:
    return compare.counts(_joined(spark, d, counted=True))


def transform_diffs(spark: SparkSession, d: str) -> DataFrame:
    return compare.transform_diffs(_joined(spark, d), CONTRACT)


def mismatch_detail(spark: SparkSession, d: str) -> DataFrame:
    return compare.detail(_joined(spark, d), CONTRACT)


def composite_key_compare(spark: SparkSession, d: str) -> DataFrame:
    return compare.counts(compare.joined(*_lines(spark, d), LINE_CONTRACT, (["at"], ["at"]), counted=True))


def row_hash_compare(spark: SparkSession, d: str) -> DataFrame:
    return compare.differing_keys(_expected(spark, d), target(spark, d), CONTRACT, (["seq"], ["order_id"]))


# --- runs and reports


def full_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """All steps although the first ones fail, for the whole picture; the gates have queries of
    their own."""
    return pipeline.reconcile(CONTRACT, feed(spark, d), target(spark, d), ["seq"], ["order_id"], timestamp="2024-01-01T00:00:00", stop_at_gates=False).summary


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "summary")
    summary = full_reconciliation(spark, d)
    io.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


def _gated(spark: SparkSession, rows: DataFrame, header: list[str] = FEED_COLUMNS, live: DataFrame | None = None) -> DataFrame:
    """A whole run over files: with a load, or against ``live`` as it was loaded before."""
    feed_path = _write_csv(rows, header, FEED_COLUMNS, _folder(spark, "feed"))
    target_path = _folder(spark, "target")
    if live is not None:
        live.write.parquet(target_path)
    return pipeline.stage_of(pipeline.run(spark, RUN_CONTRACT, feed_path, target_path, load=live is None))


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    return io.typed(expected(clean_feed(spark, d), RUN_CONTRACT), RUN_CONTRACT)


def gate_pass(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, clean_feed(spark, d))


def gate_files(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, clean_feed(spark, d), ["key", *FEED_COLUMNS[1:]])


def gate_rules(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, feed(spark, d))


def gate_schema(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, clean_feed(spark, d), live=_loaded(spark, d).drop("label"))


def gate_count(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, clean_feed(spark, d), live=_loaded(spark, d).where("order_id % 50 <> 0"))


def gate_compare(spark: SparkSession, d: str) -> DataFrame:
    total = F.when(F.col("order_id") % 41 == 0, F.col("total") + F.lit("0.01").cast("decimal(3,2)")).otherwise(F.col("total"))
    return _gated(spark, clean_feed(spark, d), live=_loaded(spark, d).withColumn("total", total.cast("decimal(38,2)")))


def failure_layers(spark: SparkSession, d: str) -> DataFrame:
    return report.failure_layers(_joined(spark, d), _report(spark, d), CONTRACT)


def mismatch_clusters(spark: SparkSession, d: str) -> DataFrame:
    return report.mismatch_clusters(_joined(spark, d), CONTRACT)


def batch_aggregates(spark: SparkSession, d: str) -> DataFrame:
    metrics = {"rows": "count(*)", "total": "sum(cast(total as decimal(18,2)))", "customers": "count(distinct cast(customer_id as bigint))"}
    return report.batch_aggregates(_expected(spark, d), target(spark, d), metrics)


def run_trend(spark: SparkSession, d: str) -> DataFrame:
    """History: one run per order year; its mismatches are the orders over 200,000."""
    runs = _t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("string").alias("y")).agg(F.count_if(F.col("o_totalprice") > 200000).alias("mismatch_count"))
    summaries = runs.select(F.lit("orders").alias("contract"), F.lit("test").alias("environment"), F.concat("y", F.lit("-01-01T00:00:00")).alias("timestamp"), "mismatch_count", "y")
    path = _folder(spark, "history")
    for i in range(2):  # two batches of runs, as a history grows
        io.append_history(summaries.where(F.col("y").cast("int") % 2 == i).drop("y"), path, "run-")
    history = spark.read.parquet(path).withColumn("run_id", F.concat("run_id", F.substring("timestamp", 1, 4)))
    return report.trend(history).select("contract", "environment", "timestamp", "run_id", "mismatch_count", F.col("before").cast("string"), F.col("change").cast("string"))


_TRANSFORMS: dict[str, Query] = {
    "transform_template": _transform("{c_name} <{c_mktsegment}>"),
    "transform_lower": _transform("lower({c_name})"),
    "transform_upper": _transform("upper({c_mktsegment}-{c_name})"),
    "transform_strip": _transform("strip(padded)", _padded),
    "transform_direct_call": _transform("upper(c_mktsegment)"),
}
_NORMAL_FORMS: dict[str, Query] = {
    "normalize_integer": _values("orders", "o_orderkey", "o_orderkey", _integers, type="integer"),
    "normalize_decimal": _values("orders", "o_totalprice", "o_orderkey", lambda c, k: c.cast("decimal(18,2)").cast("string"), type="decimal", scale=1),
    "normalize_date": _values("orders", "o_orderdate", "o_orderkey", _dates, type="date"),
    "normalize_timestamp": _values("events", "ts", "event_id", _times, type="timestamp"),
    "normalize_boolean": _values("orders", "o_orderkey", "o_orderkey", lambda c, k: _of_list(["TRUE", " t ", "yes", "0", "maybe", ""], k), type="boolean"),
    "normalize_string": _values("customer", "c_name", "c_custkey", lambda c, k: F.concat(F.lit("\t "), c, F.lit(" \n")), type="string"),
}
_NAMED = [
    read_feed, read_target, target_query, row_counts, describe_schema, load_expected, contract_schema, run_summary, feed_files, header_errors, header_count_errors, encoding_errors,
    encoding_declared, ragged_rows, ragged_errors, row_count_errors, row_count_check, control_totals, map_columns, transform_round, expected_rows, normalize_blank, normalize_edges,
    range_edges, dq_report, dq_samples, dq_totals, schema_errors, nullability_check, key_integrity, normalized_keys, last_wins, missing_in_target, extra_in_target, column_diffs,
    column_diffs_subset, recon_counts, transform_diffs, mismatch_detail, composite_key_compare, full_reconciliation, gate_pass, gate_files, gate_rules, gate_schema, gate_count,
    gate_compare, failure_layers, mismatch_clusters, batch_aggregates, row_hash_compare, run_trend,
]
QUERIES: dict[str, Query] = {f.__name__: f for f in _NAMED} | _TRANSFORMS | _NORMAL_FORMS | {f"rule_{x}": _rule(x) for x in demo_sql.RULES}
ORACLE_SQL: dict[str, str] = demo_sql.SQL
