"""Fixed examples of the text and time functions."""

import pytest
from pyspark.sql import functions as F

from speechtables.functions import exact, text, times


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Hello... World...", "Hello World"),
        ("What ?", "What?"),
        ("Wow !", "Wow!"),
        ("Hello .", "Hello."),
        ("Hello ,", "Hello,"),
        ("Hello :", "Hello:"),
        ("Hello ;", "Hello;"),
        ("  Hello World  ", "Hello World."),
        ("i think i am", "I think I am."),
        ("ça va i", "Ça va I."),
        ("ié i", "Ié I."),
    ],
)
def test_format_punct(spark, given, wanted):
    assert one(spark, text.format_punct, given) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("", True),
        ("   ", True),
        ("...", True),
        (" . . .  ", True),
        ("Hello, world!", False),
        ("  Hello world  ", False),
        ("Hello. World.", False),
        ("  Hello.  World.  ", False),
        (" . ", True),
    ],
)
def test_is_empty_string(spark, given, wanted):
    assert one(spark, text.is_empty_string, given) is wanted


@pytest.mark.parametrize(
    "seconds, target, number, written",
    [
        (1.0, "ms", 1000.0, None),
        (1.0, "s", 1.0, None),
        (1.0, "hms", None, "00:00:01.000"),
        (3600.0, "hms", None, "01:00:00.000"),
        (3661.0, "hms", None, "01:01:01.000"),
        (360000.5, "hms", None, "100:00:00.500"),
    ],
)
def test_convert_timestamp(spark, seconds, target, number, written):
    row = one(spark, lambda c: times.convert_timestamp(c, F.lit(target)), seconds, "double")
    assert (row["number"], row["text"], row["error"]) == (number, written, None)


def test_convert_timestamp_rejects_other_targets(spark):
    row = one(spark, lambda c: times.convert_timestamp(c, F.lit("days")), 1000.0, "double")
    assert row["number"] is None and row["text"] is None and "days" in row["error"]


def test_format_timestamp(spark):
    assert one(spark, times.format_timestamp, 61.0005, "double") == "01:01.001"
    assert one(spark, lambda c: times.format_timestamp(c, True, ","), 3661.5, "double") == "01:01:01,500"
    assert one(spark, times.format_timestamp, -1.0, "double") is None


def test_binary_round(spark):
    values = [2.675, 1.005, 0.125, 9.5]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(exact.binary_round(F.col("x"), 2).alias("y")).collect()
    assert sorted(r["y"] for r in rows) == sorted(round(v, 2) for v in values)
