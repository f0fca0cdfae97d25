"""Both forms of the ordered-group operators against brute force in Python."""

import random

import pytest
from pyspark.sql import functions as F

from racelake.operators.ordered import (
    Past,
    add_next_known,
    add_past,
    add_row_number,
    add_running_sum,
    add_table_position,
)

PAST = [
    Past("mean3", "v", 3),
    Past("sum5", "v", 5, "sum"),
    Past("prev", "v", 1, "value"),
    Past("prev2", "v", 2, "value"),
]


def rows(seed, hot=120, groups=6):
    """One group with most of the rows, small groups around it, a null group, null values."""
    rng = random.Random(seed)
    out = []
    for g in ["m", *"adgjpz"[:groups], None]:
        for t in range(hot if g == "m" else rng.randint(1, 9)):
            out.append((g, t, None if rng.random() < 0.5 else float(rng.randint(1, 50))))
    rng.shuffle(out)
    return out


def grouped(data):
    groups = {}
    for g, t, v in sorted(data, key=lambda r: r[1]):
        groups.setdefault(g, []).append((t, v))
    return groups


def expect_past(data):
    out = {}
    for g, seq in grouped(data).items():
        for i, (t, _) in enumerate(seq):
            last3 = [v for _, v in seq[max(0, i - 3) : i] if v is not None]
            last5 = [v for _, v in seq[max(0, i - 5) : i] if v is not None]
            out[g, t] = (
                sum(last3) / len(last3) if last3 else None,
                sum(last5) if last5 else None,
                seq[i - 1][1] if i >= 1 else None,
                seq[i - 2][1] if i >= 2 else None,
            )
    return out


def expect_next(data):
    out = {}
    for g, seq in grouped(data).items():
        for i, (t, _) in enumerate(seq):
            out[g, t] = next((v for _, v in seq[i:] if v is not None), None)
    return out


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_past(spark, split, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "g string, t int, v double")
    got = add_past(df, ["g"], ["t"], PAST, split=split)
    assert got.columns == ["g", "t", "v", "mean3", "sum5", "prev", "prev2"]
    assert {(r.g, r.t): (r.mean3, r.sum5, r.prev, r.prev2) for r in got.collect()} == expect_past(data)
    assert got.count() == len(data)


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("seed", [3, 4])
def test_next_known(spark, split, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "g string, t int, v double")
    got = add_next_known(df, ["g"], ["t"], "v", "next", split=split).collect()
    assert {(r.g, r.t): r.next for r in got} == expect_next(data)
    assert len(got) == len(data)
    again = add_next_known(df, ["g"], ["t"], "v", split=split)
    twice = add_next_known(again, ["g"], ["t"], "v", split=split)
    assert sorted(map(str, again.collect())) == sorted(map(str, twice.collect()))


def test_next_known_across_many_empty_blocks(spark):
    data = [("a", t, 7.0 if t == 399 else None) for t in range(400)] + [("b", t, None) for t in range(50)]
    df = spark.createDataFrame(data, "g string, t int, v double")
    got = add_next_known(df, ["g"], ["t"], "v", split=True).collect()
    assert all(r.v == (7.0 if r.g == "a" else None) for r in got) and len(got) == 450


@pytest.mark.parametrize("split", [False, True])
def test_row_number(spark, split):
    data = rows(5)
    df = spark.createDataFrame(data, "g string, t int, v double")
    got = add_row_number(df, ["g"], ["t"], "n", split=split)
    expected = {(g, t): i + 1 for g, seq in grouped(data).items() for i, (t, _) in enumerate(seq)}
    assert {(r.g, r.t): r.n for r in got.collect()} == expected
    assert dict(got.dtypes)["n"] == "bigint"


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_table_position(spark, n):
    df = spark.range(n).select((n - F.col("id")).alias("k"), F.lit("x").alias("pad"))
    got = sorted(add_table_position(df, ["k"], "at", "total").collect())
    assert [(r.k, r.at, r.total) for r in got] == [(i + 1, i, n) for i in range(n)]
    assert [r.at for r in sorted(add_row_number(df, [], ["k"], "at").collect())] == list(range(1, n + 1))


def test_whole_row_copies_keep_their_number(spark):
    df = spark.createDataFrame([(1,)] * 300 + [(2,)] * 5, "k int")
    got = sorted(r.at for r in add_table_position(df, ["k"], "at", "total").collect())
    assert got == list(range(305))
    numbers = sorted(r.n for r in add_row_number(df, ["k"], ["k"], "n", split=True).filter("k = 1").collect())
    assert numbers == list(range(1, 301))


def test_change_of_a_row_never_reaches_earlier_rows(spark):
    data = [("a", t, float(t)) for t in range(20)]
    changed = [("a", t, 999.0 if t == 10 else v) for _, t, v in data]
    one, two = (
        {r.t: r[3:] for r in add_past(spark.createDataFrame(d, "g string, t int, v double"), ["g"], ["t"], PAST).collect()}
        for d in (data, changed)
    )
    assert all(one[t] == two[t] for t in range(11)) and one[11] != two[11]


def test_nothing_is_measured_before_the_action(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("g"), F.col("id").alias("t"), F.rand(1).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "building a plain window")
    add_past(df, ["g"], ["t"], PAST)
    assert not tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setJobGroup("", "")


def test_small_groups_cost_one_exchange(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("g"), F.col("id").alias("t"), F.rand(1).alias("v"))
    plan = add_past(df, ["g"], ["t"], PAST)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1


@pytest.mark.parametrize("split", [False, True])
def test_running_sum(spark, split):
    rows = [(g, i, None if g == "n" or i % 5 == 0 else i) for g in ("a", "b", "n", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, t int, v int").repartition(3)
    got = {(r.g, r.t): (r.s, r.c) for r in add_running_sum(df.withColumn("one", F.lit(1)), ["g"], ["t"], {"v": "s", "one": "c"}, split).collect()}
    for g, t, _ in rows:
        so_far = [v for h, i, v in rows if h == g and i <= t and v is not None]
        assert got[g, t] == (sum(so_far) if so_far else None, t + 1)
