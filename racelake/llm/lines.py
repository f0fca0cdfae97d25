"""Line de-duplication with levelled sorted runs of line hashes.

The index is a set of runs, each a table bucketed and sorted by line hash. A batch of documents is merge-anti-joined
with the runs: lines that no run holds are new, and only these name their keeper; the others add to a count. Both go
into the batch's own run; `fanout` runs of one level are compacted into one of the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from racelake.sources.scratch import new_path, stable

HASH = ["h1", "h2"]
STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without outer white space and with A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(STRIPPED)), upper, upper.lower())


def _hash(key: Column) -> Column:
    """128 bits from two seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _keys(text: Column, min_chars: int) -> Column:
    """Hash of each line's key, in line order; null for a line that is too short."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def of(key: Column) -> Column:
        return F.when(F.length(key) >= min_chars, _hash(key))

    return F.transform(F.transform(lines, line_key), of)


def held_keys(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """A row (id, h1, h2) for each document and each line key it holds."""
    found = F.array_distinct(F.filter(_keys(F.col(text), min_chars), lambda k: k.isNotNull()))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("k")).select("id", "k.*")


def key_counts(held: DataFrame) -> DataFrame:
    """A batch of the index: how many documents hold a line key, and the largest id among them."""
    return held.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))


def line_counts(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """`key_counts` of documents."""
    return key_counts(held_keys(docs, id_col, text, min_chars))


@dataclass
class LineIndex:
    """Runs of (hash, documents, keeper), newest last in each level; `keeper` is null where an earlier run has it.

    Feed batches from the largest ids to the smallest: the run that first holds a line names its keeper, and no other
    run does. `log` has a (level, rows, runs merged) for each run written.
    """

    spark: SparkSession
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)
    log: list[tuple[int, int, int]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join `batch` (h1, h2, n, keeper) with the runs and add it as a run of its own."""
        runs = self.runs()
        if runs:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            batch = stable(batch.repartition(parts, *HASH))
            new = batch
            for run in runs:
                new = new.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
            own = new.select(*HASH, F.lit(True).alias("__new"))
            marked = batch.join(own.hint("merge"), HASH, "left")
            batch = marked.select(*HASH, "n", F.when(F.col("__new"), F.col("keeper")).alias("keeper"))
        self._store(batch, 0)

    def _store(self, run: DataFrame, level: int, merged: int = 0) -> None:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"line_run_{uuid.uuid4().hex}"
        sorted_run = run.select(*HASH, "n", "keeper").repartition(parts, *HASH)
        writer = sorted_run.write.format("parquet").bucketBy(parts, *HASH).sortBy(*HASH)
        self.paths[name] = new_path(self.spark, name)
        writer.option("path", self.paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        self.log.append((level, self.spark.table(name).count(), merged))
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._store(self._merged(full), level + 1, len(full))
            self._forget(full)

    def _forget(self, names: Sequence[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _merged(self, names: Sequence[str]) -> DataFrame:
        """Runs as one table. Read as plain files: a union of bucketed tables must not pass for bucketed itself."""
        every = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[self.paths[n] for n in names])
        keeper = F.first("keeper", ignorenulls=True)  # at most one run has it
        return every.groupBy(*HASH).agg(F.sum("n").alias("n"), keeper.alias("keeper"))

    def merged(self) -> DataFrame:
        return self._merged([name for level in self.levels for name in level])

    def close(self) -> None:
        self._forget([name for level in self.levels for name in level])
        self.levels = []


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int | None = None,
    fanout: int = 4,
    batch_docs: int = 1 << 28,
) -> DataFrame:
    """`docs` with the lines dropped that stay elsewhere, and `n_lines` (before) and `n_dropped`.

    A key of at least `min_chars` code points that at least `min_docs` documents hold stays only in the largest
    id that holds it. Each row is a document; rows with one id are counted each, and all of them keep what that
    id keeps. A null id is below all others and keeps a line only where every holder's id is null. A null text
    is one empty line and becomes an empty text. Texts of any length are split whole, within a row. Other columns pass
    through; clashing ones are replaced. Keys are compared by 128-bit hashes. An empty table gives an empty one.

    Unless `batches` says otherwise, a batch has at most about `batch_docs` documents and there is one batch more than
    `fanout`, at least, so that runs are compacted. Texts are read twice: once for their keys, which are stored by
    batch, and once for the result.
    """
    return index_lines(docs, id_col, text, min_chars, min_docs, batches, fanout, batch_docs)[0]


def index_lines(
    docs: DataFrame, id_col: str, text: str, min_chars: int, min_docs: int, batches: int | None, fanout: int, batch_docs: int
) -> tuple[DataFrame, LineIndex]:
    """`dedup_lines`, and its index (closed) for the log of runs."""
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c not in (id_col, text)])
    spark = docs.sparkSession
    batches = batches or max(fanout + 1, -(-docs.count() // batch_docs))
    # Only ids and hashes are kept, in a folder for each batch.
    path = new_path(spark, "line_keys")
    number, parts = _batch_number(docs, id_col, batches)
    keys = held_keys(docs, id_col, text, min_chars)
    keys.withColumn("batch", number(F.col("id"))).write.partitionBy("batch").parquet(path)
    held = spark.read.schema(keys.schema.add("batch", "integer")).parquet(path)

    index = LineIndex(spark, fanout)
    for k in range(parts):
        index.add(key_counts(held.filter(F.col("batch") == k)))
    frequent = stable(index.merged().filter(F.col("n") >= min_docs).select(*HASH, "keeper"))
    index.close()

    # Each document gets the set of its keys that stay elsewhere.
    lost = held.join(frequent, HASH).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    drops = lost.groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.struct(*HASH)).alias("__drop"))
    joined = docs.join(drops, F.col(id_col).eqNullSafe(F.col("__id")), "left")

    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    marked = F.when(F.col("__drop").isNull(), lines).otherwise(
        F.filter(
            lines,
            lambda line: ~F.coalesce(
                (F.length(line_key(line)) >= min_chars) & F.array_contains(F.col("__drop"), _hash(line_key(line))),
                F.lit(False),
            ),
        )
    )
    kept = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("__kept", marked)
    done = kept.withColumn("n_dropped", F.col("n_lines") - F.size("__kept"))
    return done.withColumn(text, F.array_join("__kept", "\n")).select(*docs.columns, "n_lines", "n_dropped"), index


def _batch_number(docs: DataFrame, id_col: str, batches: int) -> tuple[Callable[[Column], Column], int]:
    """Batches of ids, numbered from the largest ids on, the null id in the last; and how many there are."""
    cuts = docs.select(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    edges = sorted(set(cuts or []), reverse=True)

    def number(ident: Column) -> Column:
        found = F.lit(len(edges))
        for k in range(len(edges) - 1, -1, -1):
            found = F.when(ident >= edges[k], k).otherwise(found)
        return found

    return number, len(edges) + 1
