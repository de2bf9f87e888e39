from __future__ import annotations

from tidemark import session


def test_released_tables_are_gone(spark, tmp_path, monkeypatch):
    folder = session.shared_folder(spark, "x")
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3
    session.release(spark)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    session.release(spark)


def test_workers_find_the_package(spark):
    session.tune(spark)
    session.tune(spark)
    paths = spark.sparkContext.environment["PYTHONPATH"].split(":")
    assert len(paths) == len(set(paths))
