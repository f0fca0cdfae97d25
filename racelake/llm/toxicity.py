"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees the words and the probabilities of the categories
before it. In training these are out-of-fold predictions, so that a model learns from probabilities as it will
meet them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    RegexTokenizer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racelake.sources.scratch import stable

_WORDS, _VECTOR, _CHAINED = "__words", "__vector", "__chained"


#: Lengths of the beginnings of words.
STARTS = (5, 7)


def _tokens(docs: DataFrame, text: str) -> DataFrame:
    """Lower-cased runs of letters and digits, and beginnings of the longer ones, which inflected words share."""
    filled = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    tokenizer = RegexTokenizer(
        inputCol="__text", outputCol=_WORDS, pattern=r"[\p{L}\p{N}]+", gaps=False, toLowercase=True
    )
    found = tokenizer.transform(filled).drop("__text")
    words = F.col(_WORDS)

    def starts(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.left(w, F.lit(n)), F.lit("~")))

    return found.withColumn(_WORDS, F.concat(words, *[starts(n) for n in STARTS]))


@dataclass
class Link:
    """One category's model: words whose log odds stand out, weighted by them, and the probabilities before it."""

    words: VectorSlicer
    weights: ElementwiseProduct
    before: Sequence[str]
    model: LogisticRegressionModel

    def score(self, df: DataFrame, name: str) -> DataFrame:
        scored = self.model.transform(_features(df, self.words, self.weights, self.before))
        scored = scored.withColumn(name, vector_to_array("__probability")[1])
        return scored.drop(_CHAINED, "__probability", "__raw", "__prediction")


def _features(df: DataFrame, words: VectorSlicer, weights: ElementwiseProduct, before: Sequence[str]) -> DataFrame:
    weighted = weights.transform(words.transform(df))
    assembler = VectorAssembler(inputCols=["__weighted", *before], outputCol=_CHAINED)
    return assembler.transform(weighted).drop("__sliced", "__weighted")


def _fit_link(df: DataFrame, label: str, before: Sequence[str], penalty: float, iterations: int, deviations: float) -> Link:
    """`df` is a bounded sample; two vectors of the vocabulary's length come to the driver."""
    sums = df.groupBy(F.col(label).cast("int").alias("y")).agg(
        Summarizer.sum(F.col(_VECTOR)).alias("sum"), F.count(F.lit(1)).alias("n")
    )
    found = {r["y"]: (r["sum"].toArray(), r["n"]) for r in sums.collect()}
    empty = np.zeros(len(next(iter(found.values()))[0]))
    (one, n1), (zero, n0) = (found.get(y, (empty, 0)) for y in (1, 0))
    odds = np.log((one + 1) / (n1 + 2)) - np.log((zero + 1) / (n0 + 2))
    spread = np.sqrt(1 / (one + 1) + 1 / (zero + 1))
    chosen = np.flatnonzero(np.abs(odds) > np.maximum(deviations * spread, 1.0))
    chosen = chosen if len(chosen) else np.array([0])
    words = VectorSlicer(inputCol=_VECTOR, outputCol="__sliced", indices=chosen.tolist())
    weights = ElementwiseProduct(
        inputCol="__sliced", outputCol="__weighted", scalingVec=Vectors.dense(np.abs(odds[chosen]) + 1e-9)
    )
    model = LogisticRegression(
        featuresCol=_CHAINED,
        labelCol=label,
        probabilityCol="__probability",
        rawPredictionCol="__raw",
        predictionCol="__prediction",
        regParam=penalty,
        maxIter=iterations,
        standardization=False,
        family="binomial",
    ).fit(_features(df, words, weights, before))
    return Link(words, weights, before, model)


@dataclass
class Chain:
    """Fitted models in the order of their categories; `p_<category>` is what each predicts from the presence of the
    vocabulary's words."""

    categories: Sequence[str]
    vocabulary: CountVectorizerModel | None
    models: list[Link]

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Every row of `docs` with one probability for each category, by its whole text; nothing is shuffled.

        A null or empty text has no words. Without models every probability is 0. Clashing columns are replaced.
        """
        names = [f"p_{c}" for c in self.categories]
        docs = docs.drop(*[n for n in names if n != text])
        if not self.models:
            return docs.withColumns({n: F.lit(0.0) for n in names})
        scored = self.vocabulary.transform(_tokens(docs, text)).drop(_WORDS)
        for k, model in enumerate(self.models):
            scored = model.score(scored, names[k])
        return scored.drop(_VECTOR)


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str] = ("quality", "toxic"),
    id_col: str = "doc_id",
    text: str = "text",
    max_rows: int = 16000,
    max_words: int = 1 << 16,
    least_share: float = 0.001,
    folds: int = 3,
    penalty: float = 0.0003,
    iterations: int = 25,
    deviations: float = 3.5,
) -> Chain:
    """A chain fitted on a bounded sample: at most `max_rows` labelled ids, those first by a hash of the id, and at
    most `max_words` words, each in `least_share` of the sample and in two documents at least.

    Labels are 0 or 1; of several labels of one id the largest counts, a null one is left out for its category. Ids
    without a document, or null, are left out. A category with one class only gets a constant model; without any
    labelled document the chain has no models.
    """
    wanted = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    known = wanted.agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories])
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__content"))
    # At most `max_rows` ids and labels are broadcast.
    chosen = texts.join(F.broadcast(sample), "__id").withColumn("fold", F.pmod(F.xxhash64("__id"), F.lit(folds)))
    tokens = stable(_tokens(chosen, "__content").drop("__content").repartition(4, "__id"))
    if tokens.isEmpty():
        return Chain(categories, None, [])
    least = float(max(2, math.ceil(least_share * tokens.count())))
    counter = CountVectorizer(inputCol=_WORDS, outputCol=_VECTOR, binary=True, vocabSize=max_words, minDF=least)
    vocabulary = counter.fit(tokens.filter(F.size(_WORDS) > 0))
    rows = stable(vocabulary.transform(tokens).drop(_WORDS))

    def fitted(df: DataFrame, k: int) -> Link:
        return _fit_link(df, categories[k], names[:k], penalty, iterations, deviations)

    names, models = [f"p_{c}" for c in categories], []
    for k, category in enumerate(categories):
        labelled = rows.filter(F.col(category).isNotNull())
        if labelled.isEmpty():
            raise ValueError(f"no label for {category}")
        models.append(fitted(labelled, k))
        if k + 1 == len(categories):
            break
        parts = []
        for fold in range(folds):
            others = labelled.filter(F.col("fold") != fold)
            model = models[-1] if others.isEmpty() else fitted(others, k)
            parts.append(model.score(rows.filter(F.col("fold") == fold), names[k]))
        united = parts[0]
        for part in parts[1:]:
            united = united.unionByName(part)
        rows = stable(united)
    return Chain(categories, vocabulary, models)
