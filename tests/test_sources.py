import json

import pytest
from pyspark.sql import functions as F

from racelake.schemas import conform, schema
from racelake.sources import calendar, documents, scratch, tables

RESULT = {
    "Driver": {"driverId": "max", "code": "VER", "givenName": "Max", "familyName": "V", "nationality": "NL"},
    "Constructor": {"constructorId": "rb", "name": "RB"},
    "grid": "1", "position": "2", "points": "18", "laps": "57", "status": "Finished",
}


def race(number, results):
    circuit = {"circuitId": "c", "circuitName": "C"}
    return {"season": "2021", "round": str(number), "raceName": "R", "date": "2021-03-28", "Circuit": circuit, "Results": results}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents(spark, tmp_path):
    first = {"Races": [race(1, [RESULT, RESULT]), race(2, []), {**race(3, None), "Results": None}]}
    (tmp_path / "results_2021.json").write_text(json.dumps(first, indent=2))
    (tmp_path / "results_2022.json").write_text(json.dumps({"Races": [race(4, [RESULT])]}, indent=2))
    (tmp_path / "results_2023.json").write_text(json.dumps({"Races": []}))
    flat = documents.flatten_results(documents.read_documents(spark, str(tmp_path)))
    assert len(flat.columns) == 18
    assert sorted(r["round"] for r in flat.collect()) == ["1", "1", "4"]
    one = flat.filter("round = '4'").first()
    assert (one.raceName, one.circuitId, one.driverId, one.code, one.name, one.points) == ("R", "c", "max", "VER", "RB", "18")
    only = documents.read_documents(spark, [str(tmp_path / "results_2022.json")])
    assert documents.flatten_results(only).count() == 1


def test_pages_keep_split_races(spark, tmp_path):
    for i, races in enumerate([[race(1, [RESULT] * 2), race(2, [RESULT])], [race(2, [RESULT] * 3)]]):
        page = {"MRData": {"total": "6", "RaceTable": {"Races": races}}}
        (tmp_path / f"page_{i}.json").write_text(json.dumps(page, indent=1))
    pages = documents.read_pages(spark, str(tmp_path))
    assert pages.select(F.explode("Races")).count() == 3
    assert sorted(r["round"] for r in documents.flatten_results(pages).collect()) == ["1", "1", "2", "2", "2", "2"]


@pytest.mark.parametrize("split", [False, True])
def test_nesting_bounds_each_document(spark, tmp_path, split):
    one = documents.flatten_results(spark.createDataFrame([([race(1, [RESULT])],)], documents.SEASON_DOCUMENT))
    many = one.withColumn("laps", F.explode(F.sequence(F.lit(1), F.lit(25)))).withColumn("n", F.col("laps"))
    many = many.withColumn("laps", F.col("laps").cast("string"))
    nested = documents.nest_results(many, ["n"], page_rows=10, split=split)
    assert sorted(r[0] for r in nested.select(F.size(F.col("Races")[0]["Results"])).collect()) == [5, 10, 10]
    documents.write_documents(nested, str(tmp_path / "d"))
    back = documents.flatten_results(documents.read_documents(spark, str(tmp_path / "d"), multi_line=False))
    assert rows(back) == rows(many.drop("n"))


def test_calendar(spark, tmp_path):
    path = tmp_path / "races.json"
    path.write_text(json.dumps({"2019": ["Australia", "Great Britain"], "2020": []}, indent=2))
    races = calendar.read_calendar(spark, str(path))
    assert rows(races) == [(2019, 0, "Australia"), (2019, 1, "Great Britain")]
    assert [r.race for r in calendar.races_of(races, 2019).collect()] == ["Australia", "Great Britain"]
    assert calendar.races_of(races, 2018).count() == 0
    with pytest.raises(FileNotFoundError):
        calendar.read_calendar(spark, str(tmp_path / "none.json"))
    laps = spark.createDataFrame([(2019, "great_britain"), (2019, "spain"), (2020, "australia")], "season int, race string")
    assert rows(calendar.in_calendar(laps, races)) == [(2019, "great_britain")]


@pytest.mark.parametrize("split", [False, True])
def test_calendar_is_built_in_event_order(spark, split):
    events = [(2019, 2, "Spanish Grand Prix", "Spain"), (2019, 1, "Pre-Season Test", "Spain"), (2019, 3, None, "Italy"),
              (2019, 4, "British Grand Prix", "Great Britain"), (2020, 1, "Austrian Grand Prix", "Austria")]
    df = spark.createDataFrame(events, "season int, event_order int, event_name string, country string")
    built = calendar.build_calendar(df, split=split)
    assert rows(built) == [(2019, 0, "Spain"), (2019, 1, "Great Britain"), (2020, 0, "Austria")]


def test_optional_and_required_reads(spark, tmp_path):
    absent, shape = str(tmp_path / "absent"), schema(a="int", b="string")
    empty = tables.read_optional(spark, absent, shape)
    assert empty.schema == shape and empty.count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_required(spark, absent)
    with pytest.raises(ValueError, match="absent"):
        tables.read_all(spark, [absent])
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part.parquet").write_text("not a table")
    with pytest.raises(Exception, match="(?i)footer|parquet"):
        tables.read_optional(spark, str(broken), shape)
    assert tables.read_optional(spark, str(broken), shape, skip_unreadable=True).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert tables.read_optional(spark, str(tmp_path / "t"), shape).columns == ["id"]
    spark.range(2).withColumn("x", F.lit("x")).write.parquet(str(tmp_path / "u"))
    assert rows(tables.read_all(spark, [str(tmp_path / p) for p in ("t", "absent", "u")])) == [
        (0, "x"), (0, None), (1, "x"), (1, None), (2, None)]
    assert tables.read_table(spark, str(tmp_path / "t"), schema(id="int", more="string")).columns == ["id", "more"]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_partition_replacement(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2019, "a"), (2, 2019, "b"), (3, 2020, "a")], "v int, season int, race string")
    tables.write_table(df, path, ["season", "race"], fmt)
    tables.write_table(df.filter("race = 'b'").withColumn("v", F.lit(9)), path, ["season", "race"], fmt, touched_only=True)
    back = tables.read_table(spark, path, fmt=fmt)
    assert rows(back.select("v", "season", "race")) == [(1, 2019, "a"), (3, 2020, "a"), (9, 2019, "b")]
    plan = back.filter("season = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    tables.write_table(df.limit(1), path, ["season", "race"], fmt)
    assert tables.read_table(spark, path, fmt=fmt).count() == 1


def test_conform(spark):
    df = spark.createDataFrame([("5.0", "nan", "kept"), ("x", "v", None)], "a string, b string, other string")
    shape = schema(b="string", a="int", c="double")
    assert conform(df, shape).dtypes == [("b", "string"), ("a", "int"), ("c", "double"), ("other", "string")]
    assert rows(conform(df, shape, keep_others=False)) == [("v", None, None), (None, 5, None)]


def test_scratch_is_shared(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch.shared_dir(spark) == folder and scratch.new_path(spark, "x") != scratch.new_path(spark, "x")
    fixed = scratch.stable(spark.range(5).withColumn("r", F.rand()))
    assert rows(fixed) == rows(fixed)


def test_season_documents_by_line(spark, tmp_path):
    """A season is one document of many lines, of which none holds more than a race."""
    names = ["season", "round", "raceName", "date", *documents.CIRCUIT.names, *documents.DRIVER.names,
             *documents.CONSTRUCTOR.names, "grid", "position", "points", "laps", "status"]
    rows = [
        (*[season, str(r), f"race \n{r}", None if r == 2 else f"2000-01-{d:02}", f"c{r}", "C"], *[None if n == 4 else f"{k},{n}]}}" for k in range(12)], n)
        for season in ("1999", "2000", None)
        for r in range(12)
        for d in (1, 2)
        for n in range(7)
    ]
    flat = spark.createDataFrame(rows, ", ".join([*[f"{n} string" for n in names], "n int"]))
    path = str(tmp_path / "seasons")
    documents.write_season_documents(documents.season_documents(flat, ["n"]), path)
    # The races of a round without dates are one.
    races = flat.select("season", "round", "date").distinct().count()
    assert spark.read.text(path).count() == races + 2 * 3
    whole = documents.read_documents(spark, path)
    assert whole.count() == 3
    first = whole.filter("Races[0].season = '1999'").first().Races
    assert [int(r.round) for r in first] == sorted(int(r.round) for r in first)
    assert [r.Driver.driverId for r in first[0].Results if r.Driver and r.Driver.driverId] == [f"0,{n}]}}" for n in range(7) if n != 4]
    expected = sorted(flat.drop("n").collect(), key=str)
    for read in (whole, documents.read_season_documents(spark, path)):
        assert sorted(documents.flatten_results(read).select(*names).collect(), key=str) == expected
