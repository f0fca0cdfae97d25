import datetime

import pytest
from pyspark.sql import functions as F

from racelake.plans import results, training


@pytest.fixture(scope="module")
def history(spark):
    """Forty races of ten drivers: low numbers finish in front, some results are unknown."""
    data = [
        (2021, r, datetime.date(2021, 1, 1) + datetime.timedelta(r), f"circuit_{r % 4}", f"d{d}", f"D{d}", f"t{d % 5}",
         d + 1, None if (r + d) % 17 == 0 else d * 2 + 1 + r % 2, float(20 - d), "Finished")
        for r in range(40)
        for d in range(10)
    ]
    names = "season int, round int, date date, circuit_id string, driver_id string, code string, constructor_id string, " \
            "grid int, position int, points double, status string"  # fmt: skip
    return spark.createDataFrame(data, names)


@pytest.fixture(scope="module")
def stats(history):
    return results.driver_stats(history), results.constructor_stats(history)


@pytest.fixture(scope="module")
def dataset(history, stats):
    return results.season_dataset(results.race_features(history), *stats)


@pytest.mark.parametrize("estimator", [lambda: training.random_forest(trees=10, depth=4), lambda: training.logistic_regression(100, 0.01)])
def test_train_save_score(spark, tmp_path, history, stats, dataset, estimator):
    trained = training.train(dataset, estimator())
    got = trained.metrics.first()
    assert got.accuracy > 0.8 and trained.predictions.count() == 80
    assert trained.report.count() == 5
    assert sum(r.predicted_0 + r.predicted_1 for r in trained.confusion.collect()) == 80
    assert trained.predictions.agg(F.min("round")).first()[0] == 32

    path = str(tmp_path / "model")
    training.save_model(trained.model, path)
    requests = history.filter("round = 39").select(*results.MODEL_INPUT, "code").union(
        history.limit(1).selectExpr("season", "round", "grid", "circuit_id", "driver_id", "constructor_id", "'none'")
    )
    scored = training.score(training.load_model(path), requests, *stats)
    assert scored.count() == 11
    known = scored.filter("reason is null")
    assert known.count() == 10
    assert {(r.prediction, r.label) for r in known.collect()} <= {(1, "Top 10"), (0, "Not Top 10")}
    rejected = scored.filter("reason is not null").first()
    assert (rejected.prediction, rejected.label, rejected.reason) == (None, None, "No driver data found")
    assert known.filter("driver_id = 'd0'").first().label == "Top 10"

    log = str(tmp_path / "log")
    for run in ("one", "two"):
        training.log_metrics(trained.metrics, run, log)
    logged = spark.read.parquet(log)
    assert logged.count() == 8 and logged.columns == ["run", "metric", "value"]




def test_models_share_split_and_encoder(dataset, monkeypatch):
    """Rows are split and their slots found once, and each model is the one that it is alone."""
    split, fit, calls = training.time_split, training.SparseEncoder._fit, []
    monkeypatch.setattr(training, "time_split", lambda *a: calls.append("split") or split(*a))
    monkeypatch.setattr(training.SparseEncoder, "_fit", lambda self, rows: calls.append("fit") or fit(self, rows))
    models = [training.random_forest(trees=3, depth=3), training.logistic_regression(20, 0.01)]
    both = training.train_each(dataset, models)
    assert sorted(calls) == ["fit", "split"]

    def found(trained):
        return sorted(trained.predictions.select("date", "driver_id", "prediction").collect())

    for model, together in zip(models, both, strict=True):
        assert found(together) == found(training.train(dataset, model)) and together.report.count() == 5


def test_prepare(dataset):
    prepared = training.prepare_training(dataset.withColumn("finished_top_10", F.when(F.col("round") > 0, F.col("finished_top_10"))))
    assert prepared.columns == ["date", *results.FEATURES, "finished_top_10"] and prepared.count() == 390
    ready = training.model_ready(prepared.withColumn("grid", F.lit(None).cast("int")))
    assert ready.filter("grid = 0.0").count() == 390


def test_assembled_numbers_stay_narrow(spark, tmp_path, monkeypatch):
    """Of the assembled vector only the numbers are spread out, whatever the number of keys."""
    from racelake.catalog import queries

    widths = []
    spread = queries.vector_to_array
    monkeypatch.setattr(queries, "vector_to_array", lambda c: widths.append(c) or spread(c))
    spark.range(300).selectExpr(
        "id AS o_orderkey", "id % 150 AS o_custkey", "date_add(DATE'1995-01-01', cast(id AS int)) AS o_orderdate",
        "'F' AS o_orderstatus", "cast(id AS double) * 1000 AS o_totalprice",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(150).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "cast(id % 5 AS int) AS c_nationkey").write.parquet(
        str(tmp_path / "customer.parquet")
    )
    got = queries.assembled_features(spark, str(tmp_path))
    assert widths == ["tail"] and got.columns == ["result_id", *training.NUMERIC]
    rows = {r.result_id: r for r in got.collect()}
    assert 1 in rows and 23 not in rows
    assert all(r.grid == r.result_id * 7 % 20 + 1 and r.driver_num_races == 2 and r.season >= 1995 for r in rows.values())


def test_forest_takes_wide_sparse_rows(spark, tmp_path):
    """A million slots: a forest over spread-out rows would hold a gigabyte for each hundred of them."""
    from pyspark.ml.linalg import SparseVector, Vectors

    from racelake.operators.forest import SparseForest, SparseForestModel

    wide = 1_000_000
    rows = [
        (i, int(i % 7 == 3 or i % 20 > 15), SparseVector(wide, {i * 100: 1.0, 900_000 + i % 7: 1.0, wide - 2: float(i % 20), wide - 1: -1.0 * i}))
        for i in range(4000)
    ]
    df = spark.createDataFrame(rows, ["id", "y", "v"]).repartition(4)
    model = SparseForest("y", "v", trees=1, depth=5, seed=1, memory_mb=64, features="auto").fit(df)
    got = model.transform(df)
    assert got.filter("prediction <> y").count() == 0
    path = str(tmp_path / "forest")
    model.write().save(path)
    again = SparseForestModel.load(path).transform(df).select("id", "rawPrediction", "probability", "prediction").collect()
    assert sorted(again) == sorted(got.select("id", "rawPrediction", "probability", "prediction").collect())

    # Dense vectors, several trees: the first feature decides, one of the others has a single value that isn't zero.
    dense = spark.createDataFrame(
        [(i, int(i % 10 > 4), Vectors.dense([float(i % 10), 3.0 * (i % 2), 0.0, float(i % 3)])) for i in range(500)], ["id", "y", "v"]
    )
    first = SparseForest("y", "v", trees=5, depth=2, seed=1, memory_mb=64, features="all").fit(dense)
    assert first.transform(dense).filter("prediction <> y").count() == 0
    assert list(first.nodes.feature[:5]) == [0] * 5
    # Each tree sees other rows, as many as there are on average, and a node's counts are its children's.
    roots = first.nodes.counts[:5].sum(axis=1)
    assert len(set(roots)) > 1 and 440 < roots.mean() < 560
    nodes = first.nodes
    inner = nodes.left >= 0
    assert (nodes.counts[inner] == nodes.counts[nodes.left[inner]] + nodes.counts[nodes.left[inner] + 1]).all()
    same = SparseForest("y", "v", trees=5, depth=2, seed=1, memory_mb=1, features="all").fit(dense).nodes
    assert (same.counts == nodes.counts).all()
    few = SparseForest("y", "v", trees=20, depth=1, seed=1, memory_mb=64, features="sqrt").fit(dense)
    assert set(few.nodes.feature[:20]) > {0}
    with pytest.raises(ValueError, match="labelled"):
        SparseForest("y", "v", 1, 1, 1, 64, "all").fit(dense.withColumn("y", F.lit(2)))


def test_features_name_no_slots(spark, tmp_path, dataset):
    """Vectors are those of Spark's stages, but no key is named in a column's metadata: with many keys, the names were many
    times their size on the driver, and every part of the rows sent a gradient as wide as all keys."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from racelake.operators.encode import SparseEncoderModel, one_hot_stages

    rows = training.model_ready(training.prepare_training(dataset)).withColumn(
        "circuit_id", F.when(F.col("round") % 5 != 0, F.col("circuit_id"))
    )
    known, new = rows.filter("round < 30 and driver_id <> 'd3'"), rows.withColumn("grid", F.col("grid") - 1)
    vectors = [f"{c}_vector" for c in training.CATEGORICAL]
    plain = Pipeline(stages=[*one_hot_stages(training.CATEGORICAL), VectorAssembler(inputCols=[*vectors, *training.NUMERIC], outputCol="features")])
    wanted = [r.features for r in plain.fit(known).transform(new).collect()]
    encoder = Pipeline(stages=training.build_model(training.logistic_regression()).getStages()[:-1]).fit(known)
    got = encoder.transform(new)
    assert got.schema["features"].metadata == {} and got.columns == [*new.columns, "features"]
    rows_got = [r.features for r in got.collect()]
    assert rows_got == wanted and [type(v) for v in rows_got] == [type(v) for v in wanted]
    path = str(tmp_path / "encoder")
    encoder.stages[0].write().save(path)
    assert [r.features for r in SparseEncoderModel.load(path).transform(new).collect()] == wanted

    seen = []
    estimator = training.logistic_regression(5)
    estimator.inner = type("Spy", (), {"fit": lambda self, df: seen.append(df.rdd.getNumPartitions())})()
    estimator.fit(encoder.transform(known.repartition(40)))
    assert 1 <= seen[0] <= spark.sparkContext.defaultParallelism


def test_encoder_keeps_keys_off_the_driver(spark, tmp_path, monkeypatch):
    """Slots are those of Spark's stages, also with ties, nulls, numbers as keys and a text without any value; keys are
    counted, ordered and looked up as tables, and the driver gets one row for each text."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    from racelake.operators.encode import SparseEncoder, SparseEncoderModel, one_hot_stages

    texts = ["a", "b", "c"]
    made = spark.range(300).selectExpr(
        "concat('k', id % 37) AS a", "cast(id % 5 AS int) AS b", "if(id % 4 = 0, null, concat('é', id * id % 11)) AS c",
        "cast(id AS double) AS n", "cast(null AS string) AS none",
    )
    known, rows = made.filter("n < 200"), made.withColumn("a", F.when(F.col("n") % 7 != 0, F.col("a")))
    plain = Pipeline(stages=[*one_hot_stages(texts), VectorAssembler(inputCols=[*[f"{c}_vector" for c in texts], "n"], outputCol="v")])
    wanted = {r.n: r.v for r in plain.fit(known).transform(rows).collect()}

    def gathered(*_):
        raise AssertionError("keys come to the driver")

    monkeypatch.setattr(StringIndexer, "_fit", gathered)
    model = SparseEncoder(texts, ["n"], "v").fit(known)
    assert model.sizes == [37, 5, 6]
    assert {r.n: r.v for r in model.transform(rows).collect()} == wanted
    model.write().save(str(tmp_path / "encoder"))
    again = SparseEncoderModel.load(str(tmp_path / "encoder")).transform(rows)
    assert {r.n: r.v for r in again.collect()} == wanted and again.columns == [*rows.columns, "v"]
    empty = SparseEncoder(["none"], ["n"], "v").fit(known)
    assert empty.sizes == [0] and {len(r.v) for r in empty.transform(rows).collect()} == {1}


def test_forest_levels_read_short_rows(spark, monkeypatch):
    """A level reads each row's slots and bins as bytes, and counts of nodes are not summed again below the roots."""
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.linalg import SparseVector

    from racelake.operators import forest

    seen = []
    histograms = forest.SparseForest._histograms

    def spy(self, rows, coding, nodes, subsets, begin):
        sums = histograms(self, rows, coding, nodes, subsets, begin)
        seen.append((dict(rows.dtypes), begin, sums.filter(F.col("feature") < 0).count()))
        return sums

    monkeypatch.setattr(forest.SparseForest, "_histograms", spy)
    data = [(int(i % 4 > 1), SparseVector(9, {i % 4: 1.0, 8: float(i % 10)})) for i in range(200)]
    model = forest.SparseForest("y", "v", trees=3, depth=3, seed=1, memory_mb=64, features="all").fit(spark.createDataFrame(data, ["y", "v"]))
    assert {k: v for k, v in seen[0][0].items() if k not in ("row", "label")} == {"keys": "binary", "bins": "binary"}
    assert seen[0][2] == 3 and len(seen) > 1 and all(n == 0 for _, begin, n in seen if begin)
    inner = np.flatnonzero(model.nodes.left >= 0)
    assert (model.nodes.counts[inner] == model.nodes.counts[model.nodes.left[inner]] + model.nodes.counts[model.nodes.left[inner] + 1]).all()

    keys = np.array([[5, -1, 7], [6, -1, -1]], dtype=np.int32)
    bins = np.array([[1, 2], [3, 4], [5, 6]], dtype=np.uint8)
    packed = pa.record_batch(list(forest._packed(keys, bins)), names=["keys", "bins"])
    for part, k, b in ((packed, keys, bins), (packed.slice(1), keys[:1, 1:], bins[1:]), (packed.slice(0, 0), keys[:1, :0], bins[:0, :0])):
        got = forest._unpacked(part.column("keys"), part.column("bins"))
        assert got[0].tolist() == k.tolist() and got[1].tolist() == b.tolist()
