import os

from pyspark.sql import functions as F

from keystride.operators import merge
from keystride.sources import lines

SAMPLE = [
    "", "  ", "query,count", '"a ""x"", b",5', " foo ,7", "bar,x", ",9", '"",3', "foo,8", "a,-4", "b,+5",
    "c,9223372036854775808", '"  pad  ",2', "no comma", "x,y,3",
]


def write(path, name, content):
    os.makedirs(path, exist_ok=True)
    (path / name).write_text("\n".join(content) + "\n", encoding="utf-8")


def test_tolerant_parse(spark, tmp_path, values):
    write(tmp_path / "in", "a.csv", SAMPLE)
    got = values(lines.read_query_counts(spark, str(tmp_path / "in")), "query", "count")
    assert got == sorted([
        ('a "x", b', 5), ("foo", 7), ("foo", 8), ("a", -4), ("b", 5), ("  pad  ", 2), ("x,y", 3),
    ])


def test_rejects_are_kept(spark, tmp_path):
    write(tmp_path / "in", "a.csv", SAMPLE)
    read = lines.drop_header(lines.drop_blank(lines.read_lines(spark, str(tmp_path / "in"))))
    left = {r.line for r in lines.rejected(lines.parse(read)).collect()}
    assert left == {"bar,x", ",9", '"",3', "c,9223372036854775808", "no comma"}


def test_only_the_first_line_of_a_file_is_a_header(spark, tmp_path, values):
    write(tmp_path / "in", "a.csv", ["", "Query,Count", "query,5", "x,1"])
    write(tmp_path / "in", "b.csv", ["y,2", "query,6"])
    got = values(lines.read_query_counts(spark, str(tmp_path / "in")), "query", "count")
    assert got == [("query", 5), ("query", 6), ("x", 1), ("y", 2)]


def test_missing_file_is_an_empty_table(spark, tmp_path):
    read = lines.read_query_counts(spark, str(tmp_path / "none"))
    assert read.isEmpty() and {"query", "count"} <= set(read.columns)


def test_last_line_wins_across_files(spark, tmp_path, values):
    write(tmp_path / "in", "a.csv", ["foo,7", "bar,1", "foo,8"])
    write(tmp_path / "in", "b.csv", ["bar,2"])
    read = lines.read_query_counts(spark, str(tmp_path / "in"))
    got = values(merge.last_line_wins(read, lines.LINE_ORDER), "query", "count")
    assert got == [("bar", 2), ("foo", 8)]


def test_last_line_wins_by_a_number_that_may_be_missing(spark, values):
    rows = [("a", 1, 10), ("a", 3, None), ("a", None, 30), ("b", None, 5), ("c", 2, 7), ("c", 1, 8), (None, 4, 1)]
    found = merge.last_line_wins(spark.createDataFrame(rows, "query string, line_no long, count long"), ["line_no"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [("a", 3, None), ("b", None, 5), ("c", 2, 7), (None, 4, 1)], key=repr)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_written_files_read_back(spark, tmp_path, values):
    rows = [('q"uote', 1), ("com,ma", 2), (' lead "and" , tail', 3), ("plain", -4), ("bé", 5), ('"both"', 6)]
    corpus = spark.createDataFrame(rows, "query string, count long").repartition(3)
    lines.write_query_counts(corpus, str(tmp_path / "out"))
    back = lines.read_query_counts(spark, str(tmp_path / "out"))
    assert values(back, F.trim("query"), "count") == sorted((q.strip(), c) for q, c in rows)
