"""File sinks: where files land, and the mark of a whole folder."""

import pytest

from voxloom.sources import sinks


def test_a_path_without_scheme_is_where_spark_reads(spark, tmp_path):
    files = spark.createDataFrame([("a.txt", bytearray(b"one")), ("sub/b.txt", bytearray(b"two"))], sinks.FILES)
    folder = str(tmp_path / "out")
    sinks.write_files(files, folder)
    assert (tmp_path / "out" / "a.txt").read_bytes() == b"one" and (tmp_path / "out" / "sub" / "b.txt").read_bytes() == b"two"
    assert sinks.is_whole(spark, folder) and sinks.is_whole(spark, f"file://{folder}")
    assert {r.name for r in sinks.list_files(spark, folder).collect()} == {"a.txt"}


def test_a_failed_write_leaves_no_mark(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    sinks.write_files(spark.createDataFrame([("a.txt", bytearray(b"one"))], sinks.FILES), folder)
    broken = spark.createDataFrame([("b.txt", 1), ("c.txt", 0)], "name string, k int").selectExpr("name", "IF(k = 0, raise_error('no'), CAST(name AS binary)) AS content")
    with pytest.raises(Exception, match="no"):
        sinks.write_files(broken, folder)
    assert not sinks.is_whole(spark, folder)
