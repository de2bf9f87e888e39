from __future__ import annotations

import random

import pytest

from tidemark.sources import records, seasons


def written_files(folder, seed, encoding="utf-8", end="\n"):
    """Two files with line breaks, quotes and blanks wherever a CSV may have them."""
    rng = random.Random(seed)

    def field(i):
        return rng.choice([
            f"x{i}", "", '5" pipe', f'"q, ""in"" {i}"', f'"line{end}break {i}{end}{end} and ""quote""{end}"',
            '"closed"after', '""', f"é{i}", f'"""{end},"', f'",{end}""{end}"',
        ])

    for f in range(2):
        lines = ["a, b ,c,d"]
        for i in range(300):
            lines.append(",".join(field(i) for _ in range(rng.choice([4, 4, 4, 3, 5, 1]))))
            if rng.random() < 0.05:
                lines.append("")
        (folder / f"part-{f}.csv").write_bytes((end.join(lines) + (end if f else "")).encode(encoding))


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture
def split_size(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {k: spark.conf.get(k) for k in keys}

    def use(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], "1")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", ["64m", "4k", "350b"])
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_equals_a_reader_of_whole_files(spark, tmp_path, split_size, size, encoding):
    """However the files are cut, up to more than fifty pieces each."""
    written_files(tmp_path, 3, encoding)
    charset = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}[encoding]
    whole = rows_of(spark.read.options(header=True, escape='"', multiLine=True, encoding=charset).csv(str(tmp_path)))
    split_size(size)
    if size == "350b":
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    assert rows_of(records.read_csv(spark, str(tmp_path), charset, "_p").drop("_p")) == whole


def test_records_longer_than_a_split(spark, tmp_path, split_size):
    body = 'a,b\n1,"' + "\n".join(f"line {i}" for i in range(400)) + '"\n2,x\n"3\n",' + "y" * 3000 + "\n4,z"
    (tmp_path / "f.csv").write_text(body)
    split_size("500b")
    got = {r.a: r.b for r in records.read_csv(spark, str(tmp_path), "UTF-8", "_p").collect()}
    assert got == {"1": "\n".join(f"line {i}" for i in range(400)), "2": "x", "3\n": "y" * 3000, "4": "z"}


def test_carriage_returns(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n2,z\r\n')
    assert rows_of(records.read_csv(spark, str(tmp_path), "UTF-8", "_p").drop("_p")) == [("1", "x\r\ny"), ("2", "z")]


def test_places_follow_the_file(spark, tmp_path, split_size):
    (tmp_path / "f.csv").write_text("a\n" + "".join(f'"{i}\n"\n' for i in range(300)))
    split_size("300b")
    found = records.read_csv(spark, str(tmp_path), "UTF-8", "_p").orderBy("_p")
    assert [int(r.a) for r in found.collect()] == list(range(300))


def test_open_quotes_are_told_from_the_start_of_a_field(spark):
    cases = {'a,"b': True, 'a,"b"': False, '5" pipe,2" rod': False, '5" pipe,"x': True, '"a""': True, '"a"""': False, "": False, '""': False}
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r.line: r.open for r in rows.select("line", records.ends_open(rows.line).alias("open")).collect()} == cases


def test_only_seasons_that_need_it_are_put_together(spark, tmp_path):
    for season, text in (("s1", 'a,b\n"x\n",1\n'), ("s2", 'a,b\n"x ""q""",1\n5" pipe,2\n')):
        (tmp_path / season).mkdir()
        (tmp_path / season / "f.csv").write_text(text)
    found = seasons.detect_formats(spark, str(tmp_path), ["s1", "s2"], "f.csv")
    assert {r.season: r.multi_line for r in found.collect()} == {"s1": True, "s2": False}


def test_header_only_and_empty(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n")
    assert rows_of(records.read_csv(spark, str(tmp_path), "UTF-8", "_p")) == []
