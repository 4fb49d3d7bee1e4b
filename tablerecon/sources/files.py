"""Feed files: reading, header, encoding, width and count checks. Checks give rows
``file, check, position, message``; texts are those of ``messages``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import messages
from . import records

BAD = "__bad_record"
CHECKS = "file string, check string, position long, message string"
_CHECK = "array<struct<check:string,position:bigint,message:string>>"


def read_feed(spark: SparkSession, path: str, contract, keep_bad: bool = False, multi_line: bool = False) -> DataFrame:
    """The feed with every column text, under the contract's names; an empty field reads as
    null, which everywhere in this library is the same as blank. A path may be a file, a folder
    or a prefix of any store that Spark reads. With ``multi_line`` (or the contract's) records
    may hold line breaks within quotes; a file is then read by one task. Of a feed in parts
    (``records``) each file is read on its own, so its header and such records are refused."""
    src = contract.source
    if src.get("parts", False) and (src.get("header", True) or multi_line or src.get("multi_line", False)):
        raise ValueError("a feed in parts is read without a header and without records over several lines")
    fields = [T.StructField(c, T.StringType()) for c in contract.source_columns]
    if keep_bad:
        fields.append(T.StructField(BAD, T.StringType()))
    reader = spark.read.schema(T.StructType(fields)).option("header", src.get("header", True)).option("enforceSchema", True)
    reader = reader.option("sep", src.get("delimiter", ",")).option("encoding", src.get("encoding", "utf-8")).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multi_line or src.get("multi_line", False)).option("mode", "PERMISSIVE").option("columnPruning", not keep_bad)
    return reader.option("columnNameOfCorruptRecord", BAD).csv(path)


def with_order(feed: DataFrame, name: str = "seq") -> DataFrame:
    """Adds the rows' order in their files: file, place of the split in it, place in the split."""
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return feed.withColumn(name, order)


def _row(check: str, position, message) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(position).cast("long").alias("position"), F.lit(message).alias("message") if isinstance(message, str) else message.alias("message"))


def _said(text: str, **parts: Column) -> Column:
    """A message with columns in its places."""
    out = [F.lit(x) if i % 2 == 0 else parts[x].cast("string") for i, x in enumerate(re.split(r"\{(\w+)\}", text)) if x]
    return F.concat(*out)


def _header_checks(header: Column, expected: list[str]) -> Column:
    """Findings on a header's fields, as an array."""
    got = F.size(header)
    count = F.when(got != len(expected), _row("header_count", got, _said(messages.HEADER_COUNT, expected=F.lit(len(expected)), got=got)))
    names = []
    for i, want in enumerate(expected, 1):
        field = F.get(header, F.lit(i - 1))
        names.append(F.when((got >= i) & (field != want), _row("header_name", i, _said(messages.HEADER_NAME, i=F.lit(i), expected=F.lit(want), got=field))))
    return F.array_compact(F.array(count, *names)).cast(_CHECK)


def _encoding(contract) -> str:
    name = contract.metadata.get("encoding", contract.source.get("encoding", "utf-8")) if contract else "utf-8"
    return name.lower().replace("_", "-")


def _encoding_check(encoding: str) -> Column:
    n = F.col("undecodable")
    return F.when(n > 0, _row("encoding", n, _said(messages.NOT_DECODABLE, encoding=F.lit(encoding), lines=n)))


def _ragged_check() -> Column:
    named = F.concat(F.lit("["), F.array_join("first_ragged", ", "), F.lit("]"))
    return F.when(F.col("ragged") > 0, _row("ragged", F.get("first_ragged", F.lit(0)), _said(messages.RAGGED, width=F.col("width"), lines=named)))


def _empty_check() -> Column:
    return F.when(F.col("records") == 0, _row("empty", 0, messages.EMPTY_FILE))


def _rows(contract) -> Column:
    header = 1 if contract.source.get("header", True) else 0
    return F.greatest(F.col("records") - header, F.lit(0)).cast("long")


def header_errors(spark: SparkSession, path: str, contract) -> DataFrame:
    """The header's count and names against the contract, per file, in the feed's encoding; a
    file without a record has an empty header. One job for all files (``records.heads``)."""
    found = records.heads(spark, path, contract.source.get("encoding", "utf-8"), contract.source.get("delimiter", ","), records.parts_of(contract))
    return found.select("file", F.inline(_header_checks(F.col("header"), contract.source_columns)))


def encoding_errors(spark: SparkSession, path: str, contract=None) -> DataFrame:
    """Files that hold lines which are not of ``metadata.encoding`` (UTF-8 if none is declared);
    ``position`` is how many."""
    found = records.facts(spark, path, contract)
    return found.select("file", F.inline(F.array_compact(F.array(_encoding_check(_encoding(contract)))).cast(_CHECK)))


def ragged_rows(spark: SparkSession, path: str, contract, facts: DataFrame | None = None) -> DataFrame:
    """``file, number, width, expected, record``: records whose width is not that of the file's
    first record, by their number in the file (header is 1)."""
    return records.ragged_records(spark, path, contract, facts)


def ragged_errors(spark: SparkSession, path: str, contract) -> DataFrame:
    """One row per file with ragged records: ``position`` is the first, the message names the
    first few."""
    return records.facts(spark, path, contract).select("file", F.inline(F.array_compact(F.array(_ragged_check())).cast(_CHECK)))


def file_counts(spark: SparkSession, path: str, contract) -> DataFrame:
    """``file, records, rows``: records of every file under a path or prefix, and those that are
    data. Empty files count as well."""
    return records.facts(spark, path, contract).select("file", "records", _rows(contract).alias("rows"))


def count_errors(counts: DataFrame, contract) -> DataFrame:
    """From ``file_counts``: files without a record, and ``metadata.expected_row_count`` against
    the rows of all files (a feed of headers only has 0). A feed that is empty throughout has
    the first finding alone."""
    empty = counts.select("file", F.inline(F.array_compact(F.array(_empty_check())).cast(_CHECK)))
    expected = contract.metadata.get("expected_row_count")
    if expected is None:
        return empty
    total = counts.agg(F.sum("records").alias("records"), F.sum("rows").alias("got")).where((F.col("records") > 0) & (F.col("got") != expected))
    row = _row("row_count", F.col("got"), _said(messages.ROW_COUNT, expected=F.lit(expected), got=F.col("got")))
    return empty.unionByName(total.select(F.lit(None).cast("string").alias("file"), F.inline(F.array(row).cast(_CHECK))))


@dataclass(frozen=True)
class Findings:
    """What the files of a feed look like: how many findings there are, the first ones' messages,
    and the numbers of data rows and of lines that are not a record of their own."""

    n: int
    messages: list[str]
    rows: int
    broken: int


def check_files(spark: SparkSession, path: str, contract, most: int = 100) -> Findings:
    """Header, encoding, empty files, ragged records and the row count, in one pass over the raw
    lines. Of the findings all are counted and the first ``most``, by file, reach the driver. As
    long as lines do not decode, only that and the header are looked at."""
    with_header = contract.source.get("header", True)
    header = _header_checks(F.coalesce("header", F.array().cast("array<string>")), contract.source_columns) if with_header else F.array().cast(_CHECK)
    facts = records.facts(spark, path, contract)
    if with_header and records.codec_name(contract.source.get("encoding", "utf-8")) != records.encoding_of(contract):
        # the header is read in the encoding that the feed is read in
        named = records.heads(spark, path, contract.source.get("encoding", "utf-8"), contract.source.get("delimiter", ","), records.parts_of(contract))
        facts = facts.drop("header").join(named.select("file", "header"), "file")
    bad = F.array_compact(F.array(_encoding_check(_encoding(contract)))).cast(_CHECK)
    rest = F.array_compact(F.array(_empty_check(), _ragged_check())).cast(_CHECK)
    per = facts.select("file", "records", _rows(contract).alias("rows"), (F.col("lines") - F.col("records")).alias("broken"), header.alias("header"), bad.alias("bad"), rest.alias("rest"))
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(f"n_{c}")
    kept = lambda c: F.when(F.size(c) > 0, F.struct("file", F.transform(c, lambda x: x["message"]).alias("m")))
    first = lambda c: F.slice(F.array_sort(F.collect_list(kept(c))), 1, most).alias(c)  # noqa: E731  a file with findings each
    row = per.agg(F.sum("records").alias("records"), F.sum("rows").alias("rows"), F.sum("broken").alias("broken"), *[f(c) for c in ("header", "bad", "rest") for f in (size, first)]).first()
    checks = ["header", "bad"] if row["n_bad"] else ["header", "rest"]
    found = [m for c in checks for x in row[c] for m in x["m"]]
    n, expected = sum(row[f"n_{c}"] for c in checks), contract.metadata.get("expected_row_count")
    rows = row["rows"] or 0
    if not row["n_bad"] and expected is not None and row["records"] and rows != expected:
        n, found = n + 1, [*found[: most - 1], messages.ROW_COUNT.format(expected=expected, got=rows)]
    return Findings(n, found[:most], rows, row["broken"] or 0)


def metadata_errors(spark: SparkSession, path: str, contract) -> DataFrame:
    """Encoding (alone, if it fails), then empty files, ragged records and the row count. The
    raw lines are read once; what is kept of them is a row a file."""
    facts = records.facts(spark, path, contract).persist()
    bad = facts.select("file", F.inline(F.array_compact(F.array(_encoding_check(_encoding(contract)))).cast(_CHECK)))
    if bad.take(1):
        return bad
    counts = facts.select("file", "records", _rows(contract).alias("rows"))
    return count_errors(counts, contract).unionByName(facts.select("file", F.inline(F.array_compact(F.array(_ragged_check())).cast(_CHECK))))


def row_count_check(feed: DataFrame, expected: int | None) -> DataFrame:
    """The rows of a feed that is read already, and a message if they are not as many as
    declared (none: no check)."""
    n = feed.agg(F.count("*").alias("n"))
    head = messages.ROW_COUNT.format(expected=expected, got="")
    return n.select("n", F.when(F.lit(expected) != F.col("n"), F.concat(F.lit(head), F.col("n"))).alias("message"))


def control_totals(df: DataFrame, column: str) -> DataFrame:
    """Count, sum, least and greatest of a numeric column, exact to two places."""
    x = F.col(column).try_cast("decimal(18,2)")
    return df.agg(F.count(x).alias("n"), F.sum(x).cast("string").alias("total"), F.min(x).cast("string").alias("least"), F.max(x).cast("string").alias("greatest"))


def control_total_errors(feed: DataFrame, contract) -> DataFrame:
    """``column, measure, expected, got, message``: declared totals (``metadata.control_totals``,
    a list of ``column`` and any of ``sum, count, min, max``) that the feed does not meet. Sums
    are exact decimals; text that is no number takes no part. All totals come from one pass."""
    declared = [(t["column"], m, t[m]) for t in contract.metadata.get("control_totals", []) for m in ("sum", "count", "min", "max") if m in t]
    if not declared:
        return feed.sparkSession.createDataFrame([], "column string, measure string, expected string, got string, message string")
    number = lambda c: F.col(c).try_cast("decimal(38,10)")
    told = {"sum": lambda c: F.coalesce(F.sum(number(c)), F.lit(0)), "count": lambda c: F.count(number(c)), "min": lambda c: F.min(number(c)), "max": lambda c: F.max(number(c))}
    row = feed.agg(*[told[m](c).cast("decimal(38,10)").alias(f"t{i}") for i, (c, m, _) in enumerate(declared)])
    plain = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    found = []
    for i, (c, m, want) in enumerate(declared):
        expected, got = F.lit(str(want)).cast("decimal(38,10)"), F.col(f"t{i}")
        shown, said = plain(expected), F.coalesce(plain(got), F.lit("none"))
        message = _said(messages.CONTROL_TOTAL, column=F.lit(c), measure=F.lit(m), expected=shown, got=said)
        found.append(F.when(~expected.eqNullSafe(got), F.struct(F.lit(c).alias("column"), F.lit(m).alias("measure"), shown.alias("expected"), said.alias("got"), message.alias("message"))))
    return row.select(F.inline(F.array_compact(F.array(*found))))
