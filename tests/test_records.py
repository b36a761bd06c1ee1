"""Records of delimited files, cut at any byte."""

import csv
import io
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.sinks.files import write_csv
from quillspark.sources.records import csv_cells, csv_records, csv_rows


@pytest.fixture
def cut_at(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def cut(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield cut
    for name, value in before.items():
        spark.conf.set(name, value)


def by_file(df, value="cells"):
    found = {}
    for r in df.orderBy("path", "block", "record").collect():
        found.setdefault(r["path"].rpartition("/")[2], []).append(r[value])
    return found


def read_plainly(text, **how):
    return [r for r in csv.reader(io.StringIO(text, newline=""), **how) if r]


def write(folder, texts):
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)


@pytest.mark.parametrize("n", [5, 64, 1 << 20])
def test_records_of_files_cut_anywhere(spark, tmp_path, cut_at, n):
    rng = random.Random(5)
    kinds = ["", "a", "b c", 'say "x"', '"', '""', ",", "\n", "\r\n", 'l1\nl2,"q"\n\n"', "é,\u4e2d\n", "\n\n\n", 'x"y', " "]
    texts = {}
    for k, end in enumerate(("\n", "\r\n", "\n")):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if k == 2 else csv.QUOTE_MINIMAL).writerows([[f"row {i}", *(rng.choice(kinds) for _ in range(rng.randrange(1, 5)))] for i in range(n if n < 60 else 60)])
        texts[f"f{k}.csv"] = out.getvalue()
    texts["blank.csv"] = '\ufeff\n\na,b\n\r\n\n1,"2\n\n3"'
    texts["stray.csv"] = 'a"b,c\n"d"e"f,g\nh,i"\n"j\nk"l,"m""\n"\nn\n'
    texts["inside.csv"] = '"' + "x\n" * 40 + '",y\nz,"' + '""\n' * 40 + '"\n'
    texts["empty.csv"] = ""
    write(tmp_path, texts)
    cut_at(n)
    found = by_file(csv_records(spark, str(tmp_path)))
    want = {name: read_plainly(text.removeprefix("\ufeff")) for name, text in texts.items()}
    assert found == {name: rows for name, rows in want.items() if rows}


def test_an_open_quote_and_other_delimiters(spark, tmp_path, cut_at):
    write(tmp_path, {"open.csv": 'a;b\nc;"d\ne;""f', "tabs.csv": "x;1\n"})
    cut_at(4)
    assert by_file(csv_records(spark, str(tmp_path), ";")) == {"open.csv": [["a", "b"], ["c", 'd\ne;"f']], "tabs.csv": [["x", "1"]]}
    for bad in ("", '"', "\n", "::"):
        with pytest.raises(ValueError):
            csv_records(spark, str(tmp_path), bad)
    rows = spark.createDataFrame([('"a""",b', "|"), ("a|\"|\"|'", "|"), ("", ""), (None, "")], "r string, d string")
    assert [r[0] for r in rows.select(csv_cells(F.col("r"))).collect()] == [['a"', "b"], ["a|\"|\"|'"], [""], None]
    assert rows.select(csv_cells(F.col("r"), "|")).collect()[1][0] == ["a", "|", "'"]


def test_rows_take_the_width_of_their_file(spark, tmp_path, cut_at):
    write(tmp_path, {"a.csv": "\nx,y,z\n1\n1,2,3,4\n,,\n", "b.csv": 'k\n"1\n2",3\n', "c.csv": "alone\n"})
    cut_at(3)
    df = csv_rows(spark, str(tmp_path))
    assert by_file(df) == {"a.csv": [["1", "", ""], ["1", "2", "3"], ["", "", ""]], "b.csv": [["1\n2"]]}
    assert by_file(df, "header") == {"a.csv": [["x", "y", "z"]] * 3, "b.csv": [["k"]]}


def test_long_records_and_plan(spark, tmp_path, cut_at):
    """A field of many lines and quotes, longer than its range by far, needs no deep recursion; all is done by expressions."""
    long = 'q "" " , \n' * 60_000
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["id", "text"], ["1", long], ["2", '"' * 200_001], ["3", "x" * 300_000]])
    write(tmp_path, {"long.csv": out.getvalue()})
    cut_at(50_000)
    df = csv_rows(spark, str(tmp_path))
    assert by_file(df) == {"long.csv": [["1", long], ["2", '"' * 200_001], ["3", "x" * 300_000]]}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_written_rows_are_read_again(spark, tmp_path, cut_at):
    rows = [(k, v, None if k % 3 else k) for k, v in enumerate(['a"b', "", None, '"\n"', ",\r\n,", '""', "\n"] * 9)]
    write_csv(spark.createDataFrame(rows, 'id int, `te"x.t` string, n int').repartition(5), str(tmp_path / "out"))
    cut_at(16)
    found = csv_rows(spark, str(tmp_path / "out")).collect()
    assert {tuple(r["header"]) for r in found} == {("id", 'te"x.t', "n")}
    assert sorted(tuple(r["cells"]) for r in found) == sorted((str(a), b or "", "" if c is None else str(c)) for a, b, c in rows)


@pytest.mark.parametrize("bits", [0, 2])
def test_lines_are_dealt_by_runs_within_a_range(spark, tmp_path, monkeypatch, bits):
    """A range is not one group of a shuffle; its records are numbered through all the same."""
    from quillspark.sources import records

    lines = 'a\nb,"x\n\ny""\n",c\n\n"z\n1\n2\n3\n4\n5\n6\n7",q\n' * 20
    write(tmp_path, {"r.csv": lines, "open.csv": lines + '"never\nclosed\n'})
    whole = by_file(csv_records(spark, str(tmp_path)))
    assert whole["r.csv"] == read_plainly(lines)
    monkeypatch.setattr(records, "_RUN", bits)
    found = csv_records(spark, str(tmp_path))
    assert by_file(found) == whole
    numbers = [r["record"] for r in found.filter("path LIKE '%/r.csv'").orderBy("record").collect()]
    assert len(set(numbers)) == len(whole["r.csv"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(path#\d+, block#\d+L, run#\d+L, ", plan)
