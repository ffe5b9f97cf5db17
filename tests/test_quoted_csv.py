"""Quoted CSV over many splits against Python's csv reader."""

import csv
import io
import random

import pytest

from tabsight.sources.ingest import read_table
from tabsight.sources.quoted_csv import LineState, read_quoted_csv

R = random.Random(8)


def field():
    kind = R.random()
    if kind < 0.25:
        return "".join(R.choice('ab,"\n') for _ in range(R.randint(1, 9)))
    if kind < 0.3:
        return "line\r\nbreak\n\n\"quoted\", é日 " * R.randint(1, 12)
    if kind < 0.36:
        return ""
    return "".join(R.choice("abc é1") for _ in range(R.randint(1, 12)))


def write(path, rows, eol="\n", tail=""):
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator=eol).writerows(rows)
        f.write(tail)


def plain(path):
    with open(path, encoding="utf-8", newline="") as f:
        return [r for r in csv.reader(f) if r]


def read(spark, path):
    return [tuple(r) for r in read_quoted_csv(spark, str(path)).collect()]


@pytest.fixture
def splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200b", "spark.sql.files.openCostInBytes": "1b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [200, 70, 5000])
def test_equals_the_plain_reader_whatever_the_splits(spark, splits, tmp_path, size, eol):
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
    folder = tmp_path / "t"
    folder.mkdir()
    want = []
    for k in range(3):
        rows = [["id", "a b", "x,\n\"y\""]] + [[f"{k}-{i}", field(), field()] for i in range(60)]
        write(folder / f"p{k}.csv", rows, eol)
        want += [tuple(v or None for v in r) for r in plain(folder / f"p{k}.csv")[1:]]
    df = read_quoted_csv(spark, str(folder))
    assert df.columns == ["id", "a b", "x,\n\"y\""]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)


def test_a_field_longer_than_many_splits(spark, splits, tmp_path):
    rows = [["id", "t"], ["1", "x\n" * 3000 + '"'], ["2", "y"], ["3", "z\n,\n" * 900], ["4", ""]]
    write(tmp_path / "a.csv", rows)
    assert sorted(read(spark, tmp_path / "a.csv")) == sorted((a, b or None) for a, b in rows[1:])


def test_quotes_within_unquoted_fields_are_signs(spark, splits, tmp_path):
    rows = "id,t,u\n" + "".join(f'{i},5" disk,"a\n{i}"\n{i}b,"x",7"\n' for i in range(40))
    (tmp_path / "a.csv").write_text(rows)
    want = [tuple(r) for r in list(csv.reader(io.StringIO(rows)))[1:]]
    assert sorted(read(spark, tmp_path / "a.csv")) == sorted(want)


def test_line_states_equal_the_reader():
    state = LineState(",", '"')
    for _ in range(3000):
        text = "".join(R.choice('a,"') for _ in range(R.randint(0, 9)))
        for inside in (False, True):
            # inside: the line continues a field that an earlier line opened
            rows = list(csv.reader(io.StringIO(('"' if inside else "") + text + "\nEND\n", newline="")))
            assert state.after(text, inside) == (rows[-1] != ["END"]), (text, inside)


def test_blank_lines_missing_and_surplus_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\nid,,id\n1,"a\nb",c\n\n2\n3,x,y,z\n')
    df = read_quoted_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "_c1", "id_2"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == [("1", "a\nb", "c"), ("2", None, None), ("3", "x", "y")]


def test_files_without_line_breaks_are_scanned_by_spark_alone(spark, tmp_path):
    write(tmp_path / "a.csv", [["id", "t"], ["1", 'a,"b"'], ["2", "NA"], ["3", " s "]])
    df = read_quoted_csv(spark, str(tmp_path / "a.csv"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" in plan and "MapInArrow" not in plan
    assert sorted(tuple(r) for r in df.collect()) == [("1", 'a,"b"'), ("2", "NA"), ("3", " s ")]
    assert sorted(tuple(r) for r in read_table(spark, str(tmp_path / "a.csv"), "csv").collect())[1] == ("2", None)


def test_errors(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,t\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="ends inside"):
        read_quoted_csv(spark, str(tmp_path / "open.csv"))
    (tmp_path / "blank.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="names the columns"):
        read_quoted_csv(spark, str(tmp_path / "blank.csv"))
    with pytest.raises(ValueError, match="one sign"):
        read_quoted_csv(spark, str(tmp_path), sep=";;")


def test_only_fragments_are_shuffled(spark, splits, tmp_path):
    write(tmp_path / "a.csv", [["id", "t"]] + [[str(i), f"l{i}\nm"] for i in range(200)])
    plan = read_quoted_csv(spark, str(tmp_path / "a.csv"))._jdf.queryExecution().executedPlan().toString()
    whole, parts = plan.split("Union", 1)[1].split("HashAggregate", 1)[0], plan
    assert "MapInArrow" in whole and "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning(value" not in parts
