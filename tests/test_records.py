"""Records of files against a plain reader: quoted line breaks, encodings, many splits."""

import csv
import random
import re

import pytest

from tablerecon import contract as contracts
from tablerecon.sources import files, records

COLUMNS = ["id", "name", "note"]
SPEC = {
    "contract_name": "r", "version": "1", "source": {"columns": COLUMNS}, "target": {"table": "r"}, "keys": ["id"],
    "columns": [{"name": c, "source_name": c, "type": "string", "nullable": True} for c in COLUMNS],
}


def of(**metadata):
    source = {k: metadata.pop(k) for k in ("delimiter", "header", "encoding_read") if k in metadata}
    if "encoding_read" in source:
        source["encoding"] = source.pop("encoding_read")
    return contracts.load({**SPEC, "source": {"columns": COLUMNS, **source}, "metadata": metadata})


@pytest.fixture
def small_splits(spark):
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, "150b")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def plain(text, delimiter=","):
    """Lines in order to the csv reader; the lines of every record."""
    lines = re.split(r"\r\n|\n|\r", text)
    if lines[-1] == "":
        lines.pop()
    taken = []
    out = []
    for row in csv.reader((taken.append(x) or x for x in lines), delimiter=delimiter):
        out.append((row, "\n".join(taken)))
        taken.clear()
    return out, len(lines)


def random_text(rng, n):
    pieces = ["a", "b c", ",", ",", ",", '"', '"', '""', "\n", "\n", "\r\n", '"x,y"', '"p\nq"', "é", ",,\n", "5\" pipe", "\n\n"]
    return "".join(rng.choice(pieces) for _ in range(n))


@pytest.mark.parametrize("seed", range(2))
def test_facts_over_many_splits(spark, tmp_path, small_splits, seed):
    rng, want = random.Random(seed), {}
    folder = tmp_path / "f"
    folder.mkdir()
    for i in range(8):
        text = random_text(rng, rng.choice([0, 1, 60, 300]))
        (folder / f"{i}.csv").write_bytes(text.encode())
        want[f"{i}.csv"] = plain(text) if text else ([], 0)
    c = of()
    found = records.facts(spark, str(folder), c)
    got = {r["file"].rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(got) == set(want) and max(len(r["splits"]) for r in got.values()) > 2
    odd = {}
    for name, (rows, n_lines) in want.items():
        widths = [len(row) for row, _ in rows]
        bad = [i for i, w in enumerate(widths, 1) if w != widths[0]]
        r = got[name]
        assert (r["records"], r["lines"], r["width"], r["ragged"], r["first_ragged"]) == (len(rows), n_lines, widths[0] if rows else 0, len(bad), bad[:5]), name
        assert r["header"] is None or len(r["splits"]) and r["header"] == rows[0][0]
        odd |= {(name, i): (widths[i - 1], widths[0], rows[i - 1][1]) for i in bad}
    detail = {(r["file"].rsplit("/", 1)[1], r["number"]): (r["width"], r["expected"], r["record"]) for r in records.ragged_records(spark, str(folder), c).collect()}
    assert detail == odd
    heads = {r["file"].rsplit("/", 1)[1]: r["header"] for r in records.heads(spark, str(folder), "utf-8", ",").collect()}
    assert heads == {name: rows[0][0] if rows else [] for name, (rows, _) in want.items()}


WORDS = ["prénom", "Größe", "x"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1", "cp1252", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-be", "gbk"])
def test_encodings(spark, tmp_path, small_splits, encoding):
    """Header, width, count and numbers in every encoding; characters whose bytes look like line
    feeds, and quoted breaks."""
    name = "名字" if encoding == "gbk" else "prénom"
    wide = encoding.startswith("utf")
    far = "ਅĀ一" if wide else "x"
    rows = [f"{i},{far * 3},{far}" for i in range(60)]
    rows[7] = "7,two"
    rows[20] = f'20,"a{far}\r\n{far}b","x,y"'
    rows[33] = "33,a,b,c"
    text = f"id,{name},note\n" + "\n".join(rows) + "\n"
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode(encoding))
    columns = ["id", name, "note"]
    spec = {**SPEC, "source": {"columns": columns, "encoding": encoding}, "metadata": {"encoding": encoding, "expected_row_count": 60}, "columns": [{"name": c, "source_name": c, "type": "string", "nullable": True} for c in columns], "keys": ["id"]}
    c = contracts.load(spec)
    assert files.header_errors(spark, str(path), c).collect() == []
    r = records.facts(spark, str(path), c).first()
    assert (r["records"], r["width"], r["undecodable"], r["ragged"], r["first_ragged"], r["header"]) == (61, 3, 0, 2, [9, 35], columns)
    assert files.check_files(spark, str(path), c) == files.Findings(1, ["ragged rows (col count != 3) at lines [9, 35]"], 60, 1)
    assert {(x["number"], x["record"]) for x in files.ragged_rows(spark, str(path), c).collect()} == {(9, "7,two"), (35, "33,a,b,c")}


def test_big_endian_without_mark_is_told_by_the_declaration(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("id,name,note\n1,a,b\n".encode("utf-16-be"))
    assert records.facts(spark, str(path), of(encoding="utf-16-be")).first()["records"] == 2
    (tmp_path / "y.csv").write_bytes(b"\xfe\xff" + "id,name,note\n1,a,b\n".encode("utf-16-be"))
    r = records.facts(spark, str(tmp_path / "y.csv"), of(encoding="utf-16")).first()
    assert (r["records"], r["header"]) == (2, COLUMNS)


def test_undecodable_lines_are_counted(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b"id,name,note\n1,\xff,b\n2,\xfe,b\n3,c,d\n")
    assert files.check_files(spark, str(path), of()) == files.Findings(1, ["file not decodable as utf-8: 2 lines"], 3, 0)
    path.write_bytes("id,name,note\n1,é,b\n".encode("utf-16") + b"\x00")
    assert files.check_files(spark, str(path), of(encoding="utf-16", encoding_read="utf-16")).messages == ["file not decodable as utf-16: 1 lines"]


def test_records_agree_with_the_reader(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,name,note\n1,"two\nlines",b\n2,"a ""q"" c",d\n')
    c = contracts.load({**SPEC, "source": {"columns": COLUMNS, "multi_line": True}, "metadata": {"expected_row_count": 2}})
    assert files.check_files(spark, str(path), c) == files.Findings(0, [], 2, 1)
    assert [tuple(r) for r in files.read_feed(spark, str(path), c).collect()] == [("1", "two\nlines", "b"), ("2", 'a "q" c', "d")]


def test_findings_are_counted_beyond_those_kept(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    for i in range(300):
        (folder / f"{i:03}.csv").write_text("id,nom,note\n1,a,b\n")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert files.header_errors(spark, str(folder), of()).count() == 300
    after = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert len(set(after) - set(before)) < 5  # not one a file
    found = files.check_files(spark, str(folder), of(expected_row_count=1), most=7)
    assert (found.n, len(found.messages), found.rows) == (301, 7, 300)


def test_large_files_heads_are_read_in_part(spark, tmp_path):
    """Files larger than a split, and small ones beside them."""
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, "200k" if "max" in k else "1k")
    try:
        folder = tmp_path / "f"
        folder.mkdir()
        for i in range(3):
            (folder / f"big{i}.csv").write_text(f'h{i},"quo\nted",c\n' + "1,2,3\n" * 150_000)
            (folder / f"small{i}.csv").write_text(f"s{i},b\r\n1,2\r\n")
        got = {r["file"].rsplit("/", 1)[1]: r["header"] for r in records.heads(spark, str(folder), "utf-8", ",").collect()}
        assert got == {f"big{i}.csv": [f"h{i}", "quoted", "c"] for i in range(3)} | {f"small{i}.csv": [f"s{i}", "b"] for i in range(3)}
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k)
