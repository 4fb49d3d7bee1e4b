"""More operations over the test tables: records and encodings of files, edges of values, gates
on nulls and keys, comparison by digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as contracts
from ..functions.transforms import expected
from ..functions.values import in_range, normalize, readable
from ..operators import compare, digests, patterns, schema_check
from ..sources import files, records, versions
from . import demo, demo_sql
from .demo import FEED_COLUMNS, ORDERS, Query

# --- files


def _small_splits(spark: SparkSession) -> SparkSession:
    """A session in which files have several splits."""
    own = spark.newSession()
    for key, value in (("maxPartitionBytes", "16k"), ("openCostInBytes", "1k")):
        own.conf.set(f"spark.sql.files.{key}", value)
    return own


def _quoted(spark: SparkSession, d: str) -> tuple[SparkSession, str, contracts.Contract]:
    """Customers in order, in one file of several splits; every 5th name holds a line break and
    a delimiter within quotes, every 31st record has a field more."""
    path = demo._folder(spark, "quoted")
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.concat(F.lit('"'), "c_name", F.lit('\n""x"", '), "c_mktsegment", F.lit('"'))).otherwise(F.col("c_name"))
    line = F.concat_ws(",", key.cast("string"), name, F.when(key % 31 == 7, "more"))
    demo._t(spark, d, "customer").orderBy(key).coalesce(1).select(line.alias("line")).write.text(path)
    return _small_splits(spark), path, contracts.load({**ORDERS, "source": {"columns": FEED_COLUMNS, "header": False}})


def quoted_records(spark: SparkSession, d: str) -> DataFrame:
    return records.facts(*_quoted(spark, d)).select("records", "lines", "undecodable", "width", "ragged", F.array_join("first_ragged", ",").alias("first_ragged"))


def quoted_ragged(spark: SparkSession, d: str) -> DataFrame:
    return files.ragged_rows(*_quoted(spark, d)).select("number", "width", "expected", "record")


def encoded_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Customers in files of three encodings, with letters beyond ASCII in header and rows."""
    out = None
    for encoding in ("UTF-16LE", "ISO-8859-1", "UTF-8"):
        path = demo._folder(spark, "encoded")
        rows = demo._t(spark, d, "customer").select(F.col("c_custkey").alias("clé"), F.concat(F.lit("née "), "c_name").alias("prénom"))
        rows.coalesce(1).write.option("header", True).option("encoding", encoding).csv(path)
        contract = contracts.load({**ORDERS, "metadata": {"encoding": encoding}})
        found = records.facts(spark, path, contract).select(F.lit(encoding).alias("encoding"), "records", "width", "undecodable", "ragged", F.array_join("header", ",").alias("header"))
        out = found if out is None else out.unionByName(found)
    return out


def header_of_files(spark: SparkSession, d: str) -> DataFrame:
    """A prefix of a file per nation and segment, told in one job."""
    path = demo._folder(spark, "headers")
    rows = demo._t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    rows.repartition(1).write.option("header", True).partitionBy("nation", "segment").csv(path)
    key = {"name": "order_id", "source_name": "c_custkey", "type": "integer", "nullable": False}
    contract = contracts.load({**ORDERS, "source": {"columns": ["c_custkey", "c_fullname"]}, "columns": [key]})
    part = lambda name: F.regexp_extract("file", f"{name}=([^/]+)/", 1).alias(name)
    return files.header_errors(spark, path, contract).select(part("nation"), part("segment"), "check", "position", "message")


# --- values


def date_edges(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in five ways, of which two are of the declared format."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    ways = [iso, F.concat(F.substring(iso, 1, 9), F.lit("T")), F.date_format(day, "yyyy-M-d"), F.concat(iso, F.lit(" 00:00:00")), F.date_format(day, "dd.MM.yyyy")]
    text = F.element_at(F.array(*ways), (k % len(ways) + 1).cast("int"))
    spec = contracts.Column(name="x", type="date", nullable=True)
    rows = demo._t(spark, d, "orders").select(k.alias("k"), text.alias("text"))
    v = normalize(F.col("text"), spec)
    return rows.select("k", v.typed.cast("string").alias("value"), v.raw.alias("unreadable"), readable(F.col("text"), spec).alias("passes"))


def timestamp_zone_edges(spark: SparkSession, d: str) -> DataFrame:
    """Times of the hour that a session's zone leaves out in spring, kept as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    text = F.concat(F.lit("2024-03-31 02:"), F.date_format("ts", "mm:ss"))
    v = normalize(text, contracts.Column(name="x", type="timestamp", nullable=True))
    return demo._t(own, d, "events").select(F.col("event_id").alias("k"), v.typed.cast("string").alias("value"), v.raw.alias("unreadable"))


def range_large_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Order keys times 10^19, written out and with an exponent, and fractions just over the
    upper bound of 10^22."""
    k = F.col("o_orderkey")
    over = F.concat(F.lit("1" + "0" * 22 + "." + "0" * 20), k.cast("string"))
    text = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("0" * 19))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("e19"))).otherwise(over)
    return demo._t(spark, d, "orders").select(k.alias("k"), in_range(text, 0, 10**22).alias("passes"))


def transform_unknown(spark: SparkSession, d: str) -> DataFrame:
    """A placeholder that the feed lacks renders as nothing, where a contract allows it."""
    label = {"name": "label", "type": "string", "nullable": True, "transform": "{o_orderpriority}/{nowhere}/"}
    contract = contracts.load({**ORDERS, "columns": [ORDERS["columns"][0], label]}, unknown_inputs=True)
    return expected(demo.feed(spark, d), contract).select("order_id", "label")


# --- schema and gates


def missing_table(spark: SparkSession, d: str) -> DataFrame:
    """A target that is not there, with the rows that wait for it."""
    return schema_check.schema_report(schema_check.table_or_none(spark, f"absent_{uuid.uuid4().hex}"), demo.CONTRACT, demo._expected(spark, d))


def gate_nulls(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("order_id") % 31 != 0, F.col("label"))
    return demo._gated(spark, demo.clean_feed(spark, d), live=demo._loaded(spark, d).withColumn("label", label))


def gate_keys(spark: SparkSession, d: str) -> DataFrame:
    loaded = demo._loaded(spark, d)
    return demo._gated(spark, demo.clean_feed(spark, d), live=loaded.unionByName(loaded.where("order_id % 29 = 0")))


# --- totals, versions, records of runs


def _totals(spark: SparkSession, d: str, off: int) -> DataFrame:
    """Totals as a sender would declare them, from the table itself; ``off`` by so much."""
    rows = demo.clean_feed(spark, d)
    n, least = rows.agg(F.count("*"), F.min(F.col("o_custkey").cast("long"))).first()
    total = rows.agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)"))).first()[0]
    declared = [{"column": "o_totalprice", "sum": str(total + off), "count": n + off}, {"column": "o_custkey", "min": least}]
    return files.control_total_errors(rows, contracts.load({**ORDERS, "metadata": {"control_totals": declared}}))


def control_totals_met(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d, 0)


def control_totals_missed(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d, 1)


def load_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two runs load, the second is replayed, a third breaks off: the second one's rows stay."""
    base = demo._folder(spark, "versions")
    rows = demo._expected(spark, d)
    versions.load_version(rows.where("seq % 2 = 0"), demo.CONTRACT, base, "first")
    for _ in range(2):
        versions.load_version(rows, demo.CONTRACT, base, "second")
    broken = rows.withColumn("order_id", F.when(F.rand(1) < 2, F.raise_error(F.lit("lost"))).otherwise(F.col("order_id")))
    try:
        versions.load_version(broken, demo.CONTRACT, base, "third")
    except Exception as e:
        if "lost" not in str(e):
            raise
    got = versions.read_version(spark, base)
    return got.select(F.col("order_id").cast("string"), F.col("total").cast("string"), "priority")


def run_audit(spark: SparkSession, d: str) -> DataFrame:
    """Two runs recorded, the first one twice: what each found can be looked up again."""
    path = demo._folder(spark, "audit")
    for run_id, columns in (("r1", ["total"]), ("r2", ["status"]), ("r1", ["total"])):
        rows = demo._joined(spark, d, columns, counted=True).persist()  # summary and differences come from one comparison
        summary = compare.counts(rows).withColumn("contract", F.lit("orders"))
        versions.record_run(summary, compare.diffs(rows, demo.CONTRACT), demo.CONTRACT, path, run_id)
        rows.unpersist()
    runs = spark.read.parquet(f"{path}/runs").select("run_id", "source_count", "missing", "diffs")
    stored = spark.read.parquet(f"{path}/differences").groupBy(F.col("run").alias("run_id")).agg(F.count("*").alias("stored"), F.min("order_id").alias("first_key"))
    return runs.join(stored, "run_id")


def feed_increment(spark: SparkSession, d: str) -> DataFrame:
    """A feed by segment; the second batch brings one more segment and another file of the first."""
    path, manifest = demo._folder(spark, "feed"), demo._folder(spark, "manifest")
    rows = demo._t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("part")).repartition(1)
    rows.where("part <> 'BUILDING'").write.partitionBy("part").csv(path)
    versions.take(spark, versions.increment(spark, path, manifest), manifest, "b1")
    rows.where("part = 'BUILDING' or part = 'MACHINERY' and c_custkey % 2 = 0").write.mode("append").partitionBy("part").csv(path)
    found = versions.increment(spark, path, manifest)
    part = F.regexp_extract("file", "part=([^/]+)/", 1).alias("part")
    return found.select(part, "state")


# --- comparison by digests


def _by_digest(spark: SparkSession, d: str) -> DataFrame:
    return digests.joined(demo._expected(spark, d), demo.target(spark, d), demo.CONTRACT, (["seq"], ["order_id"]))


def digest_column_diffs(spark: SparkSession, d: str) -> DataFrame:
    return compare.diffs(_by_digest(spark, d), demo.CONTRACT)


def digest_missing_and_extra(spark: SparkSession, d: str) -> DataFrame:
    return _by_digest(spark, d).where("kind <> 'matched'").select("order_id", "kind")


def digest_composite_keys(spark: SparkSession, d: str) -> DataFrame:
    """Line items, of which many share a key: the last row of each counts."""
    rows = digests.joined(*demo._lines(spark, d), demo.LINE_CONTRACT, (["at"], ["at"]))
    return compare.diffs(rows, demo.LINE_CONTRACT)


def batch_key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Keys of both sides by day of order; on most days they are the same."""
    clean = expected(demo.clean_feed(spark, d), demo.CONTRACT, carry=["seq"])
    live = demo._loaded(spark, d).where("order_id % 400 <> 7")
    rows = digests.key_sets(clean, live, demo.CONTRACT, ("substring(order_date, 1, 7)", "date_format(order_date, 'yyyy-MM')"))
    return rows.select("group", "expected_rows", "actual_rows", "agrees", "only_expected", "only_actual")


# --- patterns of differences


def _found(spark: SparkSession, rows: DataFrame, contract: contracts.Contract) -> DataFrame:
    """Patterns of the stored differences of a comparison."""
    path = demo._folder(spark, "differences")
    rows.where(F.size("diffs") > 0).write.parquet(path)
    return patterns.mismatch_patterns(spark.read.parquet(path), contract, 0.05)


def mismatch_patterns(spark: SparkSession, d: str) -> DataFrame:
    """A target with a delta, a factor, days off, day and month turned, cuts, lost blanks,
    another case, two columns swapped, a prefix, nulls and differences without a pattern."""
    live = demo._sql(spark, d, demo_sql.PATTERNED_SQL)
    clean = expected(demo.clean_feed(spark, d), demo.RUN_CONTRACT, carry=["seq"])
    return _found(spark, compare.joined(clean, live, demo.RUN_CONTRACT, (["seq"], ["order_id"])), demo.RUN_CONTRACT)


EVENTS = contracts.load({
    "contract_name": "events", "version": "1", "source": {"columns": ["event_id", "ts", "event_type"]}, "target": {"table": "events"}, "keys": ["event_id"],
    "columns": [
        {"name": "event_id", "source_name": "event_id", "type": "integer", "nullable": False}, {"name": "ts", "source_name": "ts", "type": "timestamp", "nullable": True},
        {"name": "event_type", "source_name": "event_type", "type": "string", "nullable": True},
    ],
})


def mismatch_pattern_times(spark: SparkSession, d: str) -> DataFrame:
    """Events whose times were written in another zone, or late, and whose types were recoded."""
    k, rows = F.col("event_id"), demo._t(spark, d, "events").select("event_id", "ts", "event_type")
    moved = F.when(k % 7 == 0, F.expr("ts + interval '5' hour + interval '30' minute")).when(k % 7 == 1, F.expr("ts - interval '5' second")).otherwise(F.col("ts"))
    recoded = F.when(k % 11 == 0, F.concat("event_type", F.lit("_v2"))).when(k % 11 == 1, F.substring("event_type", 1, 2)).otherwise(F.col("event_type"))
    live = rows.withColumn("ts", moved).withColumn("event_type", recoded)
    return _found(spark, compare.joined(rows, live, EVENTS, (["event_id"], ["event_id"])), EVENTS)


_NAMED = [mismatch_patterns, mismatch_pattern_times, control_totals_met, control_totals_missed, load_versions, run_audit, feed_increment, digest_column_diffs, digest_missing_and_extra, digest_composite_keys, batch_key_sets, quoted_records, quoted_ragged, encoded_feeds, header_of_files, date_edges, timestamp_zone_edges, range_large_bounds, transform_unknown, missing_table, gate_nulls, gate_keys]
QUERIES: dict[str, Query] = {f.__name__: f for f in _NAMED}
