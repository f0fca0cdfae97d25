"""JSON of any shape: walking, profiling, and what a declared shape has no place for."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racelake.plans.lake import Lake, run_season_results
from racelake.sources import documents, variants


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def test_profile_of_unlike_documents(spark):
    docs = texts(
        spark,
        '{"a":[1,{"b":null}],"c":"xyz"}',
        '{"a":{"b":true},"c":1.5,"odd key.1":"","q\\"t":0}',
        "[[],[7]]",
        "12",
        "null",
        "{oops",
        " ",
        None,
    )
    got = {(r.level, r.path, r.type): (r.n, r.min_size, r.max_size) for r in variants.profile_keys(docs, "text").collect()}
    assert got == {
        (0, "$", "object"): (2, 2, 4),
        (0, "$", "array"): (1, 2, 2),
        (0, "$", "number"): (1, None, None),
        (0, "$", "null"): (1, None, None),
        (0, "$", "broken"): (1, None, None),
        (1, "$.a", "array"): (1, 2, 2),
        (1, "$.a", "object"): (1, 1, 1),
        (1, "$.c", "string"): (1, 3, 3),
        (1, "$.c", "number"): (1, None, None),
        (1, '$."odd key.1"', "string"): (1, 0, 0),
        (1, '$."q\\"t"', "number"): (1, None, None),
        (1, "$[]", "array"): (2, 0, 1),
        (2, "$[][]", "number"): (1, None, None),
        (2, "$.a[]", "number"): (1, None, None),
        (2, "$.a[]", "object"): (1, 1, 1),
        (2, "$.a.b", "boolean"): (1, None, None),
        (3, "$.a[].b", "null"): (1, None, None),
    }


def test_profile_stops_at_its_levels(spark):
    got = variants.profile_keys(texts(spark, '{"a":{"b":{"c":1}}}'), "text", levels=1)
    assert sorted((r.path, r.type) for r in got.collect()) == [("$", "object"), ("$.a", "object")]
    assert variants.profile_keys(texts(spark).limit(0), "text").count() == 0


def test_profile_takes_one_exchange_and_no_python(spark):
    plan = variants.profile_keys(texts(spark, "{}"), "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    # What is combined before it are numbers, so no row is sorted.
    assert "SortAggregate" not in plan


def test_strays_keep_their_whole_value(spark):
    shape = T.StructType(
        [T.StructField("n", T.StringType()), T.StructField("list", T.ArrayType(T.StructType([T.StructField("x", T.StringType())])))]
    )
    rows = texts(spark, '{"n":[1],"list":[{"x":1,"y":{"z":[2]}},3,null]}', '{"list":{"x":1}}', '{"n":null,"list":null}', "[1]")
    got = variants.strays(rows.withColumn("v", variants.parsed(F.col("text"))), "v", [], shape)
    assert sorted((r.reason, r.place, r.j) for r in got.select("reason", "place", F.to_json("value").alias("j")).collect()) == [
        ("mismatched", "$", "[1]"),
        ("mismatched", "$.list", '{"x":1}'),
        ("mismatched", "$.list[1]", "3"),
        ("mismatched", "$.n", "[1]"),
        ("undeclared", "$.list[0].y", '{"z":[2]}'),
    ]


@pytest.fixture()
def folder(tmp_path):
    result = {"Driver": {"driverId": "max", "code": "VER"}, "position": "1", "FastestLap": {"lap": 3}}
    season = {"Races": [{"season": "2021", "round": 4, "Results": [result, {"position": {"a": 1}}]}], "url": "u"}
    (tmp_path / "good.json").write_text(json.dumps(season, indent=2))
    (tmp_path / "broken.json").write_text('{"Races": [')
    (tmp_path / "blank.json").write_text("\n")
    return str(tmp_path)


def test_rescue_routes_what_does_not_fit(spark, folder):
    read, quarantine = documents.read_rescued(spark, folder)
    flat = documents.flatten_results(read).select("season", "round", "code", "position").collect()
    assert sorted((tuple(r)[:3] for r in flat), key=str) == [("2021", "4", "VER"), ("2021", "4", None)]
    got = [(r.file.rsplit("/", 1)[-1], r.reason, r.place, r.j, r.text) for r in quarantine.select("*", F.to_json("value").alias("j")).collect()]
    assert sorted(got, key=str) == [
        ("broken.json", "broken", "$", None, '{"Races": ['),
        ("good.json", "mismatched", "$.Races[0].Results[1].position", '{"a":1}', None),
        ("good.json", "undeclared", "$.Races[0].Results[0].FastestLap", '{"lap":3}', None),
        ("good.json", "undeclared", "$.url", '"u"', None),
    ]


def test_quarantine_in_a_lake(spark, folder, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    run_season_results(lake, folder, quarantine=True)
    assert lake.read("gold", "season_dataset").count() == 2
    stored = spark.read.parquet(lake.path("bronze", "season_results_quarantine"))
    assert stored.schema["value"].dataType == T.VariantType() and stored.count() == 4


# Pages -----------------------------------------------------------------------------------------------------------


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "season string, offset long, size long, total long")


@pytest.mark.parametrize("split", [False, True])
def test_page_audit(spark, split):
    found = documents.audit_pages(
        pages(
            spark,
            ("a", 0, 30, 100), ("a", 30, 30, 100), ("a", 30, 30, 100), ("a", 90, 20, 100),
            ("b", 10, 30, 60), ("b", 20, 10, 60), ("b", 40, 0, 60), ("b", 40, 20, 50),
            ("c", 0, 5, None), (None, 0, 5, 5), ("d", 30, 5, 20),
        ),
        split,
    )
    assert sorted(map(tuple, found.collect())) == [
        ("a", "beyond", 100, 109, 1),
        ("a", "doubled", 30, 59, 2),
        ("a", "missing", 60, 89, 0),
        ("b", "missing", 0, 9, 0),
        ("b", "overlap", 20, 29, 2),
        ("b", "totals", 50, 59, 2),
        ("c", "beyond", 0, 4, 1),
        ("d", "beyond", 30, 34, 1),
        ("d", "missing", 0, 19, 0),
    ]
    assert documents.audit_pages(pages(spark), split).count() == 0


def test_results_of_doubled_pages_count_once(spark, tmp_path):
    def page(offset, positions):
        races = [{"season": "1", "round": str(p), "Results": [{"position": p}, {"position": p + "x"}]} for p in positions]
        return {"MRData": {"total": "8", "offset": str(offset), "RaceTable": {"season": "1", "Races": races}}}

    held = [page(0, ["1", "2"]), page(0, ["1", "2"]), page(2, ["2", "3"]), {"MRData": {"total": "0"}}]
    (tmp_path / "pages.json").write_text("\n".join(json.dumps(p) for p in held))
    placed = documents.read_placed_pages(spark, str(tmp_path), multi_line=False)
    assert sorted((r.offset, r.size, r.total) for r in placed.collect()) == [(0, 0, 0), (0, 4, 8), (0, 4, 8), (2, 4, 8)]
    got = documents.unique_results(placed)
    assert sorted((r.season_place, r.position) for r in got.collect()) == [(0, "1"), (1, "1x"), (2, "2"), (3, "2x"), (4, "3"), (5, "3x")]
