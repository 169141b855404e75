"""CSV records across file splits against Spark's one-task reader and Python's csv module."""
import csv
import io
import os
import random

import pytest

from casebook.sources import csv_splits as S
from casebook.sources import ingest as I


def odd_file(seed, n=400, eol="\n"):
    rnd = random.Random(seed)

    def field():
        kind = rnd.randrange(7)
        if kind == 0:
            return '"' + rnd.choice(['a,b', 'line\nbreak', 'two\n\nbreaks', 'say ""hi""', '""', ',\n,', 'x\n"",y']) + '"'
        if kind == 1:
            return rnd.choice(['5" pipe', 'a"b"c', 'é漢', '', ' lead', "it's"])
        return str(rnd.randrange(10 ** rnd.randint(1, 8)))

    rows = [",".join([str(i), field(), field()]) for i in range(n)]
    return "Id,X,Y" + eol + eol.join(rows) + rnd.choice(["", eol])


@pytest.mark.parametrize("line,start,end", [
    ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b",c', True, False), ('"a","b"', False, False),
    ('5" x,1', False, False), ('a,"b ""c', False, True), ('c"" d",e', True, False), ('x","y', True, True),
    ('""', False, False), ('"', False, True), ('"', True, False), ("", True, True), ('"a"b,"c', False, True),
    ('""', True, True), (',"', False, True), ('","', True, True), ('a"', False, False)])
def test_state_after_a_line(line, start, end):
    assert S.ends_inside(line, start) == end


@pytest.fixture()
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


@pytest.mark.parametrize("seed,size,eol", [(1, 97, "\n"), (2, 1000, "\n"), (3, 41, "\n"), (4, 300, "\r\n"), (5, 10 ** 6, "\n")])
def test_same_rows_whatever_the_splits(spark, small_splits, seed, size, eol):
    root = I.scratch_dir(spark, "csv-splits").replace("file:", "")
    os.makedirs(root)
    texts = {f"{root}/f{i}.csv": odd_file(10 * seed + i, 120 + 60 * i, eol) for i in range(3)}
    for path, text in texts.items():
        with open(path, "w", newline="") as f:
            f.write(text)
    columns = ["Id", "X", "Y"]
    plain = (spark.read.schema("Id string, X string, Y string").option("header", True).option("multiLine", True)
             .option("quote", '"').option("escape", '"').csv(list(texts)))
    want = sorted(map(str, map(tuple, plain.collect())))
    small_splits(size)
    if size < 10 ** 6:
        assert spark.read.text(list(texts)).rdd.getNumPartitions() > 1
    read = I.read_csv_tolerant(spark, list(texts), columns, keep_source=True)
    got = read.collect()
    fix = lambda x: x.replace("\r\n", "\n") if isinstance(x, str) else x
    assert sorted(str(tuple(fix(x) for x in (r.Id, r.X, r.Y))) for r in got) == want
    for path, text in texts.items():          # file order, and every record once
        own = sorted((r._row, r.Id) for r in got if r._src.endswith(os.path.basename(path)))
        ids = [row[0] for row in csv.reader(io.StringIO(text, newline="")) if row][1:]
        assert [i for _, i in own] == ids and len({r for r, _ in own}) == len(own)


def test_a_record_over_many_splits_and_an_open_quote(spark, small_splits):
    root = I.scratch_dir(spark, "csv-long").replace("file:", "")
    os.makedirs(root)
    long = "\n".join(f"line {i}" for i in range(200))
    with open(f"{root}/a.csv", "w") as f:
        f.write(f'Id,X\n1,"{long}"\n2,b\n3,"never closed\n4,d\n')
    small_splits(64)
    rows = {r.Id: r.X for r in I.read_csv_tolerant(spark, [f"{root}/a.csv"], ["Id", "X"]).collect()}
    assert rows["1"] == long and rows["2"] == "b" and set(rows) == {"1", "2", "3"}
    assert rows["3"].startswith("never closed")


def test_empty_and_blank_files(spark):
    root = I.scratch_dir(spark, "csv-empty").replace("file:", "")
    os.makedirs(root)
    for name, text in (("a", ""), ("b", "Id,X"), ("c", "Id,X\n\n\n1,2\n\n")):
        with open(f"{root}/{name}.csv", "w") as f:
            f.write(text)
    rows = I.read_csv_tolerant(spark, [f"{root}/{n}.csv" for n in "abc"], ["Id", "X"]).collect()
    assert [tuple(r) for r in rows] == [("1", "2")]


def test_lines_carry_a_file_number_and_only_quoted_lines_are_looked_at(spark, tmp_path):
    from casebook.sources import csv_splits as C
    (tmp_path / "a b+c.csv").write_text('h,i\n1,2\n3,"x\ny"\n')
    (tmp_path / "d.csv").write_text("h,i\n5,6\n")
    paths = [str(tmp_path / "a b+c.csv"), str(tmp_path / "d.csv")]
    lines = C.lines_of(spark, paths)
    assert "decode" not in lines._jdf.queryExecution().analyzed().toString().lower()
    states = C.start_states(lines).collect()
    assert sorted(s.path.rsplit("/", 1)[1] for s in states) == ["a b+c.csv", "d.csv"]
    assert len({s.file for s in states}) == 2 and not any(s.inside for s in states)
    got = sorted((r.path.rsplit("/", 1)[1], r.row, r.value) for r in C.records(spark, paths).collect())
    assert got == [("a b+c.csv", 0, "h,i"), ("a b+c.csv", 1, "1,2"), ("a b+c.csv", 2, '3,"x\ny"'),
                   ("d.csv", 0, "h,i"), ("d.csv", 1, "5,6")]
