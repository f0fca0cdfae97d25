"""The top-10 classifier: prepare, split by time, fit, evaluate, save, score, log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelake.functions import to_time
from racelake.operators.columns import stamp
from racelake.operators.encode import SparseEncoder
from racelake.operators.forest import SparseForest
from racelake.operators.metrics import binary_metrics, class_report, confusion_matrix
from racelake.operators.relations import union_by_name
from racelake.operators.split import time_split, time_split_by_date
from racelake.plans.results import FEATURES, look_up_features
from racelake.sources.scratch import stable
from racelake.sources.tables import write_table

# Target, text features, order of time, labels.
TARGET = "finished_top_10"
CATEGORICAL = ["circuit_id", "driver_id", "constructor_id"]
NUMERIC = [c for c in FEATURES if c not in CATEGORICAL]
TIME_ORDER = ["date", "round", "driver_id"]
LABELS = {1: "Top 10", 0: "Not Top 10"}


def prepare_training(dataset: DataFrame, order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """Features and target, and the columns that order them in time; rows without a target are dropped."""
    dated = dataset.withColumn("date", to_time(F.col("date")))
    extra = [c for c in order if c not in FEATURES]
    return dated.select(*extra, *FEATURES, TARGET).dropna(subset=[TARGET])


def random_forest(
    trees: int = 100, depth: int = 10, seed: int = 42, memory_mb: int = 2048, features: str = "auto"
) -> Estimator:
    """A forest that takes the assembled vectors as sparse as they are: a level of all trees is one pass over the rows,
    whatever the number of keys. A task leads as many rows at once as fit in `memory_mb`."""
    return SparseForest(TARGET, "features", trees, depth, seed, memory_mb, features)


def logistic_regression(iterations: int = 1000, regularisation: float = 0.0) -> Estimator:
    """Spark's own, over stored vectors in as many parts as there are cores: a part has a gradient as long as a vector is
    wide, and every step sends those of all parts."""
    return FewGradients(LogisticRegression(labelCol=TARGET, featuresCol="features", maxIter=iterations, regParam=regularisation))


class FewGradients(Estimator):
    def __init__(self, inner: LogisticRegression):
        super().__init__()
        self.inner = inner

    def _fit(self, dataset: DataFrame) -> Model:
        rows = stable(dataset.select(F.col(TARGET).cast("double").alias(TARGET), "features"))
        return self.inner.fit(rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, 1)))


def build_model(estimator: Estimator, encoder: Estimator | Model | None = None) -> Pipeline:
    """Text features one-hot, numbers as they are, then the estimator. `encoder` may be one that is fitted already."""
    return Pipeline(stages=[encoder or SparseEncoder(CATEGORICAL, NUMERIC, "features"), estimator])


def model_ready(df: DataFrame, missing: float = 0.0) -> DataFrame:
    """Numbers as doubles and without nulls, which the estimators cannot take; no row is dropped."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in NUMERIC})


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    report: DataFrame
    confusion: DataFrame


def train(
    dataset: DataFrame,
    estimator: Estimator,
    order: Sequence[str] = TIME_ORDER,
    fraction: float = 0.8,
    whole_days: bool = False,
) -> Trained:
    """Fits on the first part of the time-ordered rows and evaluates on the rest. `whole_days` cuts between two days
    (of the first column in `order`), so that no race is on both sides and no row is sorted."""
    return train_each(dataset, [estimator], order, fraction, whole_days)[0]


def train_each(
    dataset: DataFrame,
    estimators: Sequence[Estimator],
    order: Sequence[str] = TIME_ORDER,
    fraction: float = 0.8,
    whole_days: bool = False,
) -> list[Trained]:
    """`train` for several estimators on the same rows, which are split and get their slots once for all of them."""
    prepared = prepare_training(dataset, order)
    split = time_split_by_date(prepared, order[0], fraction) if whole_days else time_split(prepared, order, fraction)
    rows = model_ready(split)
    known, rest = rows.filter("is_train"), rows.filter("not is_train")
    encoder = SparseEncoder(CATEGORICAL, NUMERIC, "features").fit(known)
    return [_judged(build_model(estimator, encoder).fit(known), rest) for estimator in estimators]


def _judged(model: PipelineModel, rest: DataFrame) -> Trained:
    predictions = model.transform(rest)
    # Three tables are counted from what is stored: held-out rows are predicted once for all of them.
    judged = stable(predictions.select(F.col(TARGET).alias("label"), F.col("prediction").cast("int").alias("prediction")))
    return Trained(model, predictions, binary_metrics(judged), class_report(judged), confusion_matrix(judged, (0, 1)))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, requests: DataFrame, drivers: DataFrame, constructors: DataFrame) -> DataFrame:
    """Prediction and label for each request; where the driver or constructor is unknown, `reason` says so and both
    are null."""
    looked_up = look_up_features(requests, drivers, constructors)
    scored = model.transform(model_ready(looked_up))
    prediction = F.when(F.col("reason").isNull(), F.col("prediction").cast("int"))
    label = F.when(prediction == 1, LABELS[1]).when(prediction.isNotNull(), LABELS[0])
    others = [c for c in looked_up.columns if c not in (*FEATURES, "reason")]
    named = [prediction.alias("prediction"), label.alias("label"), F.col("reason")]
    return scored.select(*others, *FEATURES[:6], *named)


def metric_rows(metrics: DataFrame, run: str) -> DataFrame:
    """A one-row metric table as rows (run, metric, value)."""
    return stamp(metrics, run=run).unpivot("run", metrics.columns, "metric", "value")


def log_metrics(metrics: DataFrame, run: str, path: str, fmt: str = "parquet") -> None:
    metric_rows(metrics, run).write.format(fmt).mode("append").save(path)


def run_artefacts(trained: Trained, run: str) -> DataFrame:
    """All that a run has to show as rows of `run`, `artefact` (metrics, report, confusion), `entry` (a class or
    true label, null for the metrics), `metric` and `value`."""

    def rows(table: DataFrame, artefact: str, entry: str | None) -> DataFrame:
        named = [c for c in table.columns if c != entry]
        numbers = table.select(
            (F.lit(None) if entry is None else F.col(entry)).cast("string").alias("entry"),
            *[F.col(f"`{c}`").cast("double").alias(c) for c in named],
        )
        return stamp(numbers.unpivot("entry", named, "metric", "value"), run=run, artefact=artefact)

    parts = [rows(trained.metrics, "metrics", None), rows(trained.report, "report", trained.report.columns[0])]
    parts.append(rows(trained.confusion, "confusion", trained.confusion.columns[0]))
    return union_by_name(parts).select("run", "artefact", "entry", "metric", "value")


def log_run(artefacts: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Keeps a run's artefacts in its own folder; a run that is logged again replaces what it had logged."""
    write_table(artefacts, path, ["run"], fmt, touched_only=True)
