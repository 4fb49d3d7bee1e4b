"""Feeds in parts: files of a folder that are told as one."""

import pytest
from pyspark.sql import functions as F

from tablerecon import contract as contracts
from tablerecon.jobs import demo
from tablerecon.sources import files, records

ROWS = ["a,b", "1,x", '2,"y', 'z"', "3", "4,w", "", "5,u,v"]  # a record over two lines, widths 1, 0 and 3


def _contract(**source):
    columns = [{"name": c, "source_name": c, "type": "string", "nullable": True} for c in "ab"]
    return contracts.load({**demo.ORDERS, "source": {"columns": ["a", "b"], **source}, "columns": columns, "keys": ["a"]})


def _write(folder, parts, encoding="utf-8"):
    folder.mkdir()
    for i, lines in enumerate(parts):
        (folder / f"part-{i:05d}").write_bytes("".join(x + "\n" for x in lines).encode(encoding))
    return str(folder)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le"])
@pytest.mark.parametrize("cuts", [[2, 5], [1, 1, 3, 8], [0, 3, 4, 6]])
def test_parts_like_one_file(spark, tmp_path, encoding, cuts):
    ends = [0, *cuts, len(ROWS)]
    whole = _write(tmp_path / "whole", [ROWS], encoding)
    cut = _write(tmp_path / "cut", [ROWS[a:b] for a, b in zip(ends, ends[1:], strict=False)], encoding)
    names = ["records", "lines", "undecodable", "header", "width", "ragged", "first_ragged"]
    one, parts = _contract(encoding=encoding), _contract(encoding=encoding, parts=True)
    want = records.facts(spark, whole, one).select(names).collect()
    got = records.facts(spark, cut, parts)
    assert got.select(names).collect() == want and len(want) == 1
    assert [r["file"].rstrip("/").endswith("/cut") for r in got.collect()] == [True]
    bad = lambda path, c: [tuple(r) for r in files.ragged_rows(spark, path, c).orderBy("number").select("number", "width", "expected", "record").collect()]
    assert bad(cut, parts) == bad(whole, one) == [(4, 1, 2, "3"), (6, 0, 2, ""), (7, 3, 2, "5,u,v")]
    assert files.header_errors(spark, cut, parts).count() == 0
    found = files.check_files(spark, cut, parts)
    assert (found.n, found.rows) == (1, 6)


def test_parts_refused(spark, tmp_path):
    path = _write(tmp_path / "f", [["a,b"], ["1,2"]])
    with pytest.raises(ValueError, match="order of bytes"):
        records.facts(spark, path, _contract(parts=True, encoding="utf-16"))
    with pytest.raises(ValueError, match="without a header"):
        files.read_feed(spark, path, _contract(parts=True))
    assert files.read_feed(spark, path, _contract(parts=True, header=False)).count() == 2


def test_parts_by_many_tasks(spark, tmp_path):
    """No task writes all of a feed: several files a folder, in order, one header."""
    own = spark.newSession()
    for k, v in {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}.items():
        own.conf.set(k, v)
    rows = own.range(0, 4000, 1, 4).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("a"), F.lit("x" * 40).alias("b"), (F.col("id") % 2).cast("string").alias("part"))
    path = demo._write_parts(rows.orderBy(F.rand(1)), ["a", "b"], ["seq"], str(tmp_path / "feed"), ["part"])
    for part in (0, 1):
        own_files = sorted((tmp_path / "feed" / f"part={part}").glob("part-*"))
        lines = [x for f in own_files for x in f.read_text().splitlines()]
        assert len(own_files) > 3 and lines[0] == "a,b"
        assert [int(x.split(",")[0]) for x in lines[1:]] == list(range(part, 4000, 2))
        assert max(len(f.read_text().splitlines()) for f in own_files) < 1000
    assert {(r["records"], r["rows"]) for r in files.file_counts(own, path, _contract(parts=True)).collect()} == {(2001, 2000)}
