import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casefile.functions.columns import base_name, extension, file_label, nonempty, parse_file_size


def test_nonempty_string_and_binary(spark):
    df = spark.createDataFrame([("a", b"x"), ("", b""), (None, None)], "s string, b binary")
    got = df.select(nonempty("s").alias("s"), nonempty("b").alias("b")).collect()
    assert [(r.s, r.b) for r in got] == [(True, True), (False, False), (False, False)]


def test_base_name_and_extension(spark):
    df = spark.createDataFrame([("a/b/c.TXT",), ("file:/x/y",), ("noext",), ("dir.d/file",), (None,)], "p string")
    got = df.select(base_name("p").alias("b"), extension("p").alias("e")).collect()
    assert [(r.b, r.e) for r in got] == [("c.TXT", "txt"), ("y", None), ("noext", None), ("file", None),
                                         (None, None)]


def test_label_null_path_renders_null(spark):
    df = spark.createDataFrame([("e3", "p/a"), ("e4", None)], "id string, file_path string")
    assert [r.l for r in df.select(file_label().alias("l")).collect()] == ["e3_p/a", "e4_null"]


def test_file_size_parse(spark):
    df = spark.createDataFrame([(None,), ("",), ("12",)], "s string")
    assert [r.n for r in df.select(parse_file_size("s").alias("n")).collect()] == [0, 0, 12]
    bad = spark.createDataFrame([("x",)], "s string")
    with pytest.raises((PySparkException, Exception)):
        bad.select(parse_file_size(F.col("s"))).collect()
