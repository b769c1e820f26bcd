from pyspark.sql import functions as F

from sitequarry.functions.binding import let
from sitequarry.functions.text import first_sentences, hash_content, js_trim, line_key, normalize_whitespace, utf16_length, word_count


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_white_space_is_that_of_the_web(spark):
    assert _one(spark, normalize_whitespace, "﻿ a  b\n\tc ") == "a b c"
    assert _one(spark, js_trim, " x 　") == "x"
    assert _one(spark, normalize_whitespace, None) is None


def test_lengths_are_utf16_units(spark):
    assert _one(spark, utf16_length, "a😀é") == 4


def test_words(spark):
    assert _one(spark, word_count, "  two words ") == 2
    assert _one(spark, word_count, " ") == 0
    assert _one(spark, word_count, None) == 0


def test_leading_sentences(spark):
    lead = lambda t, n=180: spark.createDataFrame([(t,)], "t string").select(first_sentences(F.col("t"), n)).first()[0]
    assert lead("Short text.") == "Short text."
    long = "A" * 70 + ". " + "b" * 200
    assert lead(long) == "A" * 70 + "…"
    assert lead("x. " + "b" * 300) == ("x. " + "b" * 177) + "…"
    assert lead("😀" * 200, 10) == "😀" * 5 + "…"


def test_hashes(spark):
    row = spark.createDataFrame([("a", "b", None)], "x string, y string, z string")
    a, b, c = row.select(hash_content(F.col("x"), F.col("y")), hash_content(F.col("y"), F.col("x")), hash_content(F.col("x"), F.col("z"))).first()
    assert len(a) == 16 and a != b and c == row.select(hash_content(F.col("x"), F.lit(""))).first()[0]


def test_line_keys(spark):
    assert _one(spark, line_key, " © 2024  ACME—Ünï ² ") == "acme ünï ²"
    assert _one(spark, line_key, "2024 -- 1") == ""


def test_let_binds_once(spark):
    got = spark.range(1).select(let(F.array(F.rand()), lambda v: F.get(v, F.lit(0)) == F.get(v, F.lit(0)))).first()[0]
    assert got is True
