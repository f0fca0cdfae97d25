import pytest
from pyspark.sql import functions as F

from racelake import functions as fn


def values(spark, texts, expression, dtype="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


DURATIONS = {
    "0 days 00:01:27.512000": 87512.0,
    "1 day 00:00:01": 86401000.0,
    "12 days 01:02:03.5": 1040523500.0,
    "00:01:30": 90000.0,
    "  00:01:30  ": 90000.0,
    "2  days\t00:00:01": 172801000.0,
    "1234.5": 1234.5,
    "77": 77.0,
    None: None,
    "": None,
    "   ": None,
    "NaT": None,
    "None": None,
    "-1 days +23:59:59": None,
    "1:02:03": None,
    "00:01": None,
    "-5": None,
    "1e5": None,
    "1d": None,
    "00:01:30.": None,
    "x 00:01:30": None,
    "1 days": None,
}


def test_duration(spark, ansi):
    assert values(spark, DURATIONS, fn.duration_ms) == list(DURATIONS.values())


TOKENS = {"1": "1", "1;2": "12", "4;6": "46", "12": "", "": "", None: "", "2;1;5": "125", ";1": "1", "11;21": ""}


def test_tokens(spark):
    for token in "12456":
        got = values(spark, TOKENS, lambda c, t=token: fn.has_token(c, t))
        assert got == [token in found for found in TOKENS.values()]
    assert values(spark, ["12", "2", None], lambda c: fn.has_token(c, "1", None)) == [True, False, False]


def test_numbers(spark, ansi):
    texts = ["5", "5.0", " 7 ", "R", "", None, "nan", "None", "99999999999"]
    assert values(spark, texts, fn.to_int) == [5, 5, 7, None, None, None, None, None, None]
    assert values(spark, texts, fn.to_double)[:7] == [5.0, 5.0, 7.0, None, None, None, None]
    assert values(spark, [1.9, float("nan"), None], fn.to_int, "double") == [1, None, None]
    assert values(spark, [1.5, float("nan"), None], fn.to_double, "double") == [1.5, None, None]


def test_other_casts(spark, ansi):
    assert values(spark, ["True", "false", "None", "", None], fn.to_bool) == [True, False, None, None, None]
    assert [str(v) for v in values(spark, ["2021-03-28", "unknown", None], fn.to_date)] == ["2021-03-28", "None", "None"]
    assert [str(v) for v in values(spark, ["2021-03-28 15:00:00", "x"], fn.to_time)] == ["2021-03-28 15:00:00", "None"]
    assert values(spark, ["SOFT", "nan", "NaT", "<NA>", "None", None], fn.known_text) == ["SOFT", *[None] * 5]
    assert values(spark, ["nan", "UNKNOWN", "HARD", None], lambda c: fn.null_when(c, "nan", "UNKNOWN")) == [None, None, "HARD", None]


def test_flags(spark):
    assert values(spark, [10, 11, None], lambda c: fn.at_most(c, 10), "int") == [1, 0, 0]
    assert values(spark, ["Finished", "+1 Lap", None], lambda c: fn.differs(c, "Finished")) == [0, 1, 0]
    assert values(spark, ["Finished", "+1 Lap"], lambda c: fn.differs(c, "Finished", "+1 Lap")) == [0, 0]
    assert values(spark, [3, None], lambda c: fn.gain(F.lit(5), c), "int") == [2, None]
    assert values(spark, [True, False, None], fn.as_flag, "boolean") == [1, 0, 0]


def test_names(spark):
    assert fn.tidy("  Lap-Time / Best ") == "lap_time___best"
    assert values(spark, [" Great Britain ", "Emilia-Romagna/2", None], fn.slug) == ["great_britain", "emilia_romagna_2", None]
