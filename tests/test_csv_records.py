"""Quoted line breaks in files that are split: against the csv module, whatever the size of a block."""

import csv
import io
import random

import pytest

from gleanframe.sources import records, tables


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records, headers and line ends fall on every kind of border."""
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def drawn_table(rng, rows, names):
    cells = ["", "a", "b c", "x,y", 'say "hi"', "two\nlines", "\n", 'q"', '",\n"', "é漢", "three\n\nlines,\nall", " 7 "]
    return [names, *[[rng.choice(cells) + str(i if j == 0 else "") for j in range(len(names))] for i in range(rows)]]


def as_csv(rows, line_end="\n", quote=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=line_end, quoting=quote).writerows(rows)
    return out.getvalue()


def read(spark, path):
    df = tables.scan_csv(spark, str(path), multi_line=True)
    return df.columns, sorted(tuple(v or "" for v in r) for r in df.collect())


@pytest.mark.parametrize("size", [7, 40, 1000, 1 << 20])
@pytest.mark.parametrize("quote", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_equals_the_csv_module(spark, small_blocks, tmp_path, size, quote):
    rng = random.Random(size)
    rows = drawn_table(rng, 24 if size < 1000 else 200, ["id", "a\nname", "b", 'c,"d"'])
    (tmp_path / "t.csv").write_bytes(as_csv(rows, quote=quote).encode())
    small_blocks(size)
    names, got = read(spark, tmp_path / "t.csv")
    assert names == rows[0] and got == sorted(map(tuple, rows[1:]))


def test_many_files_with_their_own_headers(spark, small_blocks, tmp_path):
    rng = random.Random(3)
    a, b = drawn_table(rng, 16, ["k", "v\nx", "w"]), drawn_table(rng, 12, ["w", "k"])
    (tmp_path / "a.csv").write_bytes(b"\n  \n" + as_csv(a).encode())
    (tmp_path / "b.csv").write_bytes(as_csv(b, "\r\n").encode())
    (tmp_path / "c.csv").write_bytes(b"w,k\r\n1,2,3\r\n4,5\r\n6\r\n")
    small_blocks(33)
    df = tables.scan_csv(spark, str(tmp_path), multi_line=True).select("k", "v\nx", "w")
    got = sorted(tuple(v or "" for v in r) for r in df.collect())
    want = [tuple(r) for r in a[1:]] + [(k, "", w) for w, k in b[1:]] + [("5", "", "4"), ("", "", "6")]
    assert got == sorted(want)


def test_blank_first_line_and_headers_that_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\nk,v\n1,2\n")
    (tmp_path / "b.csv").write_text("  \n\nv,k,z\n3,4,5\n6,7,8,9\n")
    (tmp_path / "c.csv").write_text("k,v\n10,11,12\n13\n")
    got = {tuple(r) for r in tables.scan_csv(spark, str(tmp_path)).select("k", "v", "z").collect()}
    assert got == {("1", "2", None), ("4", "3", "5"), ("13", None, None)}


def test_stray_and_unclosed_quotes(spark, small_blocks, tmp_path):
    (tmp_path / "t.csv").write_text('k,v\n1,5" pipe\n2,"a\nb"\n3,7" and 8"\n4,"never\nclosed,\n5,x\n')
    for size in (6, 1 << 20):
        small_blocks(size)
        _, got = read(spark, tmp_path / "t.csv")
        assert got[:3] == [("1", '5" pipe'), ("2", "a\nb"), ("3", '7" and 8"')] and got[3][0] == "4" and len(got) == 4


def test_odd_files(spark, small_blocks, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert tables.scan_csv(spark, str(tmp_path / "empty.csv"), multi_line=True).count() == 0
    (tmp_path / "head.csv").write_text('"a\nb",c')
    names, got = read(spark, tmp_path / "head.csv")
    assert names == ["a\nb", "c"] and got == []
    (tmp_path / "long.csv").write_text('k,v\n1,"' + "line\n" * 900 + '"\n2,x\n')
    small_blocks(400)
    _, got = read(spark, tmp_path / "long.csv")
    assert got == [("1", "line\n" * 900), ("2", "x")]
    plain = tables.scan_csv(spark, str(tmp_path / "long.csv"), multi_line=True, header=False, columns=["p", "q"])
    assert plain.count() == 3


def test_large_files_are_read_by_many_tasks(spark, small_blocks, tmp_path):
    (tmp_path / "t.csv").write_text('k,v\n' + '1,"a\nb"\n' * 20_000)
    small_blocks(20_000)
    blocks = records.block_states(spark, str(tmp_path / "t.csv"), ",")
    assert blocks.count() >= 8 and blocks.where("open").count() > 0
    assert tables.scan_csv(spark, str(tmp_path / "t.csv"), multi_line=True).rdd.getNumPartitions() >= 8
