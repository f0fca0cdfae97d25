import datetime

import pytest
from pyspark.sql import functions as F

from racelake.operators import columns, encode, metrics, relations
from racelake.operators.split import time_split, time_split_by_date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Columns


def test_names_are_normalised_and_clashes_reported(spark):
    df = spark.createDataFrame([(1, 2)], "`Lap Time` int, `Track/Status` int")
    assert columns.normalize_names(df).columns == ["lap_time", "track_status"]
    with pytest.raises(ValueError, match="lap_time"):
        columns.normalize_names(spark.createDataFrame([(1, 2)], "`Lap Time` int, `lap-time` int"))


def test_renames(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert columns.rename_present(df, {"a": "x", "zz": "y"}).columns == ["x", "b", "c"]
    assert columns.rename_present(df, {"a": "b"}).columns == ["a", "b", "c"]
    assert columns.prefix_except(df, "driver_", ["b"]).columns == ["driver_a", "b", "driver_c"]
    assert columns.prefix_only(df, "t_", ["a", "c"]).columns == ["t_a", "b", "t_c"]


def test_fill_flags_and_presence(spark):
    df = spark.createDataFrame([(None, None, None, True), (1.5, 2, "x", None)], "a double, b long, c string, d boolean")
    flagged = columns.presence_flags(df, {"has_a": "a"})
    filled = columns.fill(flagged, {"a": 10, "b": 0, "c": "?", "d": False, "absent": 1})
    assert rows(filled) == [(1.5, 2, "x", False, 1), (10.0, 0, "?", True, 0)]
    assert filled.dtypes[:2] == [("a", "double"), ("b", "bigint")]
    assert rows(columns.flags_to_int(df.select("d"), ["d"])) == [(1,), (None,)]


def test_first_present_and_stamp(spark):
    df = spark.createDataFrame([(1,)], "b int")
    assert df.select(columns.first_present(df, "a", "b")).first()[0] == 1
    with pytest.raises(ValueError):
        columns.first_present(df, "a")
    assert columns.stamp(df, season=2019, source="x").first().asDict() == {"b": 1, "season": 2019, "source": "x"}


# Relations


def test_left_enrich_repeats_or_not(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 20), (1, 10), (3, 30), (None, 40)], "k int, w int")
    assert rows(relations.left_enrich(left, right, ["k"])) == [(1, "a", 10), (1, "a", 20), (2, "b", None), (None, "c", None)]
    assert rows(relations.left_enrich(left, right, ["k"], unique=True)) == [(1, "a", 10), (2, "b", None), (None, "c", None)]


def test_one_per_key_is_repeatable(spark):
    data = [(1, 5, "x"), (1, 5, "b"), (1, None, "z"), (None, 1, "n"), (None, 2, "m")]
    df = spark.createDataFrame(data, "k int, o int, v string")
    for part in (df, df.orderBy(F.desc("v")).repartition(3)):
        assert rows(relations.one_per_key(part, ["k"], ["o"])) == [(1, 5, "b"), (None, 1, "n")]


def test_unions_and_distinct(spark):
    one = spark.createDataFrame([(1, "x"), (1, "x")], "a int, b string")
    two = spark.createDataFrame([(2,)], "a int")
    assert rows(relations.union_by_name([one, two])) == [(1, "x"), (1, "x"), (2, None)]
    assert rows(relations.union_by_position([one, one])) == [(1, "x")] * 4
    assert rows(relations.distinct_rows(one)) == [(1, "x")]


def test_null_counts(spark):
    df = spark.createDataFrame([(None, 1), (None, None), ("x", 2)], "`a.b` string, c int")
    assert rows(relations.null_counts(df)) == [(2, 1)]
    assert rows(relations.null_counts(df.limit(0))) == [(None, None)]


def test_describe_and_quick_stats(spark):
    df = spark.createDataFrame([(1, "b"), (3, "a"), (None, None)], "n int, s string")
    assert rows(relations.describe(df)) == [("n", 2, 2.0, 2.0**0.5, "1", "3"), ("s", 2, None, None, "a", "b")]
    assert rows(relations.quick_stats(df, "n")) == [(2.0, 1, 3)]
    assert rows(relations.distinct_values(df, "s")) == [("a",), ("b",), (None,)]


def test_profile_lists_nested_fields(spark):
    df = spark.createDataFrame(
        [([(1, "x"), (2, "y")], ("k",)), (None, (None,))], "r array<struct<a:int,b:string>>, s struct<c:string>"
    )
    got = {r.path: r for r in relations.profile(df).collect()}
    assert set(got) == {"r", "r.a", "r.b", "s", "s.c"}
    assert (got["r"].rows, got["r"].nulls, got["r"].min_size, got["r"].sum_size) == (2, 1, 2, 2)
    assert (got["s.c"].nulls, got["s.c"].sample, got["r.a"].nulls) == (1, "k", None)


def test_preview_and_sort(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 3)
    assert [r.id for r in relations.preview(df, 3, ["g", "id"]).collect()] == [0, 3, 6]
    assert [r.id for r in relations.global_sort(df, ["g", "id"]).collect()] == [0, 3, 6, 9, 1, 4, 7, 2, 5, 8]


# Split


@pytest.mark.parametrize(("n", "train"), [(0, 0), (1, 0), (4, 3), (5, 4), (10, 8)])
def test_time_split(spark, n, train):
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([(day + datetime.timedelta(n - i), i) for i in range(n)], "date date, i int")
    split = time_split(df, ["date"])
    first = [r.i for r in split.filter("is_train").collect()]
    assert sorted(first) == list(range(n - train, n)) and split.count() == n


def test_split_has_no_single_partition_over_rows(spark):
    plan = time_split(spark.range(100), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rownumber" not in plan.lower()


# Encoding


def test_dummies(spark):
    df = spark.createDataFrame([(1, "b", 7), (2, "a", None), (3, None, 8)], "i int, s string, n int")
    everything = encode.dummies(df, ["s", "n"])
    assert everything.columns == ["i", "s_a", "s_b", "n_7", "n_8"]
    assert rows(everything) == [(1, 0, 1, 1, 0), (2, 1, 0, 0, 0), (3, 0, 0, 0, 1)]
    assert encode.dummies(df, ["s"], drop_first=True).columns == ["i", "n", "s_b"]
    assert encode.dummies(df, ["s"], known={"s": ["a", "z"]}).columns == ["i", "n", "s_a", "s_z"]


def test_one_hot(spark):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "s string")
    other = spark.createDataFrame([("a",), ("zz",), (None,)], "s string")
    model = Pipeline(stages=encode.one_hot_stages(["s"])).fit(df)
    vectors = {r.s: r.s_vector.toArray().tolist() for r in model.transform(other).collect()}
    assert sum(vectors["a"]) == 1 and vectors["zz"] == [0, 0, 0] and vectors[None] == [0, 0, 0]
    dropped = Pipeline(stages=encode.one_hot_stages(["s"], drop_first=True)).fit(df).transform(df)
    by_value = {r.s: sum(r.s_vector.toArray()) for r in dropped.collect()}
    assert by_value == {"a": 0, "b": 1, "c": 1}


# Metrics

PAIRS = [(1, 1)] * 5 + [(1, 0)] * 3 + [(0, 1)] * 2 + [(0, 0)] * 10


def test_binary_metrics(spark):
    got = metrics.binary_metrics(spark.createDataFrame(PAIRS, "label int, prediction int")).first()
    assert (got.accuracy, got.precision, got.recall) == (0.75, 5 / 7, 5 / 8)
    assert got.f1 == pytest.approx(2 * 5 / (7 + 8))
    none = metrics.binary_metrics(spark.createDataFrame([(0, 0)], "label int, prediction int")).first()
    assert tuple(none) == (1.0, 0.0, 0.0, 0.0)


def test_report_and_confusion(spark):
    df = spark.createDataFrame(PAIRS, "label int, prediction int")
    report = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert (report["0"].precision, report["0"].recall, report["0"].support) == (10 / 13, 10 / 12, 12)
    assert (report["accuracy"].f1, report["accuracy"].precision, report["macro avg"].support) == (0.75, None, 20)
    assert report["weighted avg"].recall == pytest.approx(0.75)
    assert rows(metrics.confusion_matrix(df)) == [(0, 10, 2), (1, 3, 5)]
    assert rows(metrics.confusion_matrix(df.filter("label = 1"))) == [(0, 0, 0), (1, 3, 5)]
    many = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 2), (1, 2)], "label int, prediction int")
    assert rows(metrics.confusion_matrix(many)) == [(0, 1, 0, 0), (1, 0, 1, 1), (2, 0, 1, 1)]


@pytest.mark.parametrize(
    "days, fraction, train",
    [
        ([1, 1, 2, 2, 3, 3, 4, 4, 5, 5], 0.8, 8),
        ([1, 1, 2, 2, 3, 3, 4, 5, 5, 5], 0.8, 7),
        ([1] * 9 + [2], 0.8, 0),
        ([None, None, 1, 2, 2], 0.8, 3),
        ([None] * 9 + [1], 0.8, 0),
        ([1, 2, 3], 1.0, 3),
        ([], 0.8, 0),
    ],
)
def test_split_between_days(spark, days, fraction, train):
    day = F.make_date(F.lit(2024), F.lit(1), F.col("d"))
    # Times of one day stay together.
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d int").select("i", "d", day.cast("timestamp").alias("t"))
    timed = rows.withColumn("t", F.col("t") + F.make_dt_interval(hours=F.col("i")))
    got = time_split_by_date(timed, "t", fraction).collect()
    assert sum(r.is_train for r in got) == train
    assert all(r.is_train is not None for r in got) and len(got) == len(days)
    known = [(r.d or 0, r.is_train) for r in got]
    assert all(a[1] >= b[1] for a in known for b in known if a[0] < b[0])


def test_split_between_days_moves_no_row(spark):
    rows = spark.range(100).select("id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    plan = time_split_by_date(rows, "day")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Join" not in plan
