"""Nested season-result documents in JSON: `{"Races": [{…, "Results": [{Driver, Constructor, …}]}]}`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racelake.operators.ordered import Past, add_past, add_row_number, add_running_sum
from racelake.operators.relations import one_per_key
from racelake.sources import variants


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# The names in the documents.
DRIVER = T.StructType(_texts("driverId", "code", "givenName", "familyName", "nationality"))
CONSTRUCTOR = T.StructType(_texts("constructorId", "name"))
CIRCUIT = T.StructType(_texts("circuitId", "circuitName"))
RESULT = T.StructType(
    [
        T.StructField("Driver", DRIVER),
        T.StructField("Constructor", CONSTRUCTOR),
        *_texts("grid", "position", "points", "laps", "status"),
    ]
)
RACE = T.StructType(
    [
        *_texts("season", "round", "raceName", "date"),
        T.StructField("Circuit", CIRCUIT),
        T.StructField("Results", T.ArrayType(RESULT)),
    ]
)
RACES = T.ArrayType(RACE)
SEASON_DOCUMENT = T.StructType([T.StructField("Races", RACES)])
PAGE = T.StructType(
    [
        T.StructField(
            "MRData",
            T.StructType(
                [
                    *_texts("total", "limit", "offset"),
                    T.StructField("RaceTable", T.StructType([*_texts("season"), T.StructField("Races", RACES)])),
                ]
            ),
        )
    ]
)

# The first and last line of a season's document.
OPENING, CLOSING = '{"Races":[', "]}"

# Results in one document, as many as a page of the results service holds.
PAGE_ROWS = 100


def read_documents(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Season documents, any number at once. `multi_line=False` reads one document for each text line, which
    lets Spark split large files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(SEASON_DOCUMENT).option("multiLine", multi_line).json(paths)


def read_pages(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Pages of the results service as season documents. A race that is split over pages stays split: it
    appears once on each page, with the results of that page."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    pages = spark.read.schema(PAGE).option("multiLine", multi_line).json(paths)
    return pages.select(F.col("MRData.RaceTable.Races").alias("Races"))


def read_rescued(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Season documents, and a quarantine for what they can't hold.

    Quarantined are texts that aren't JSON (`broken`, with the `text`), fields that the documents don't declare
    (`undeclared`) and declared ones with another kind of value (`mismatched`), both with their `place` and their
    `value` as VARIANT; `file` says where from. Everything else of such a document goes on as usual, and a document
    that is broken or no object goes on as one without races. Blank texts and lines are neither.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    texts = spark.read.text(paths, wholetext=multi_line)
    read = texts.select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), variants.parsed(F.col("value")).alias("value")
    ).filter(variants.has_text(F.col("text")))
    shape = F.col("value").try_cast(SEASON_DOCUMENT)
    documents = read.select(shape["Races"].alias("Races"))
    broken = read.filter(variants.is_broken(F.col("text"), F.col("value"))).select(
        "file", F.lit("broken").alias("reason"), F.lit(variants.ROOT).alias("place"), F.lit(None).cast("variant").alias("value"), "text"
    )
    strays = variants.strays(read, "value", ["file"], SEASON_DOCUMENT)
    return documents, strays.select("file", "reason", "place", "value", F.lit(None).cast("string").alias("text")).unionByName(broken)


def read_placed_pages(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """Pages with their place in the season: `season`, `offset`, `total`, `size` (results held), `Races`."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    pages = spark.read.schema(PAGE).option("multiLine", multi_line).json(paths)
    races = F.col("MRData.RaceTable.Races")
    held = F.aggregate(races, F.lit(0), lambda n, race: n + F.greatest(F.size(race["Results"]), F.lit(0)))
    return pages.select(
        F.coalesce("MRData.RaceTable.season", F.try_element_at(races, F.lit(1))["season"]).alias("season"),
        F.coalesce(F.col("MRData.offset").try_cast("long"), F.lit(0)).alias("offset"),
        F.col("MRData.total").try_cast("long").alias("total"),
        F.coalesce(held, F.lit(0)).cast("long").alias("size"),
        races.alias("Races"),
    )


def audit_pages(pages: DataFrame, split: bool = False) -> DataFrame:
    """What is amiss in each season's pages (`season`, `offset`, `total`, `size`): rows of `season`, `issue`,
    `first` and `last` result (from 0) and the number of `pages` involved.

    * `missing`: results below the total that no page holds,
    * `doubled`: a page that came more than once, with how often,
    * `overlap`: results that pages of different extent hold, with how many,
    * `beyond`: results from the total on,
    * `totals`: pages disagree about the total; the greatest counts. `pages` is the number of different totals.

    A sweep over the ends of the distinct pages adds up how many cover each stretch. Ends are summed by place before
    it, so it sees two rows for each page at most, which `split` spreads over tasks for a season of any size.
    """
    by = ["season"]
    extents = pages.groupBy("season", "offset", "size").agg(F.count(F.lit(1)).alias("pages"))
    doubled = extents.filter("pages > 1").select(
        "season", F.lit("doubled").alias("issue"), "offset", (F.col("offset") + F.col("size")).alias("end"), "pages"
    )
    totals = pages.groupBy("season").agg(
        F.max("total").alias("total"), F.min("total").alias("least"), F.count_distinct("total").alias("pages")
    )
    differ = totals.filter("total <> least").select(
        "season", F.lit("totals").alias("issue"), F.col("least").alias("offset"), F.col("total").alias("end"), "pages"
    )
    covered = extents.filter("size > 0")
    ends = F.array(
        F.struct(F.col("offset").alias("at"), F.lit(1).alias("more"), F.lit(0).alias("past")),
        F.struct((F.col("offset") + F.col("size")).alias("at"), F.lit(-1).alias("more"), F.lit(0).alias("past")),
    )
    bounds = F.array(
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("more"), F.lit(0).alias("past")),
        F.struct(F.coalesce("total", F.lit(0)).alias("at"), F.lit(0).alias("more"), F.lit(1).alias("past")),
    )
    marks = covered.select("season", F.inline(ends)).unionByName(totals.select("season", F.inline(bounds)))
    places = marks.groupBy("season", "at").agg(F.sum("more").alias("more"), F.sum("past").alias("past"))
    swept = add_running_sum(places, by, ["at"], {"more": "__cover", "past": "__past"}, split)
    steps = add_past(swept, by, ["at"], [Past(f"{c}_before", c, 1, "value") for c in ("at", "__cover", "__past")], split)
    cover, past = F.col("__cover_before"), F.col("__past_before") > 0
    issue = F.when(past & (cover > 0), "beyond").when(~past & (cover == 0), "missing").when(~past & (cover > 1), "overlap")
    stretches = steps.select(
        "season", issue.alias("issue"), F.col("at_before").alias("offset"), F.col("at").alias("end"), cover.alias("pages")
    ).filter(F.col("issue").isNotNull())
    found = stretches.unionByName(doubled).unionByName(differ)
    return found.select("season", "issue", F.col("offset").alias("first"), (F.col("end") - 1).alias("last"), "pages")


def unique_results(pages: DataFrame) -> DataFrame:
    """The results of placed pages as `flatten_results` gives them, each place in a season once however many pages
    hold it, with `season_place` (from 0)."""
    # A page's results are numbered in its own order: races first, then results in them.
    sizes = F.transform(F.col("Races"), lambda race: F.greatest(F.size(race["Results"]), F.lit(0)))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("__race")), F.lit(0), lambda a, b: a + b)
    counted = pages.withColumn("sizes", sizes).select("season", "offset", "sizes", F.posexplode("Races").alias("__race", "race"))
    numbered = counted.select("season", "offset", "race", before.alias("before"), F.posexplode("race.Results").alias("__at", "result"))
    place = (F.col("offset") + F.col("before") + F.col("__at")).alias("season_place")
    flat = numbered.select(F.col("season").alias("page_season"), place, *_leaves())
    once = one_per_key(flat, ["page_season", "season_place"], [])
    return once.drop("page_season")


def flatten_results(documents: DataFrame) -> DataFrame:
    """One row for each result; a race without results and a document without races give none."""
    races = documents.select(F.explode("Races").alias("race"))
    return races.select("race", F.explode("race.Results").alias("result")).select(*_leaves())


def _leaves() -> list[str]:
    return [
        *[f"race.{c}" for c in ("season", "round", "raceName", "date")],
        *[f"race.Circuit.{c}" for c in CIRCUIT.names],
        *[f"result.Driver.{c}" for c in DRIVER.names],
        *[f"result.Constructor.{c}" for c in CONSTRUCTOR.names],
        *[f"result.{c}" for c in ("grid", "position", "points", "laps", "status")],
    ]


def nest_results(
    flat: DataFrame, order: Sequence[str], page_rows: int = PAGE_ROWS, split: bool = False
) -> DataFrame:
    """The reverse of `flatten_results` in pages: documents of one race each, with at most `page_rows` results.

    A race with more results takes several documents, so no task ever gathers more than one page. For one document
    for each season see `season_documents`.
    """
    race_keys = ["season", "round", "raceName", "date", *CIRCUIT.names]
    numbered = add_row_number(flat, race_keys, order, "__n", split)
    result = F.struct(
        F.struct(*DRIVER.names).alias("Driver"),
        F.struct(*CONSTRUCTOR.names).alias("Constructor"),
        *["grid", "position", "points", "laps", "status"],
    )
    page = F.floor((F.col("__n") - 1) / page_rows).alias("__page")
    pages = numbered.groupBy(*race_keys, page).agg(
        F.array_sort(F.collect_list(F.struct("__n", result.alias("result")))).alias("numbered")
    )
    race = F.struct(
        *["season", "round", "raceName", "date"],
        F.struct(*CIRCUIT.names).alias("Circuit"),
        F.col("numbered.result").alias("Results"),
    )
    return pages.select(F.array(race).alias("Races"))


def season_documents(flat: DataFrame, order: Sequence[str]) -> DataFrame:
    """The reverse of `flatten_results` by season: rows of `season`, `part` and `line`, in whose order a season's lines
    are one document, races by round and name, results in `order`.

    A line holds one race whole, or a bracket, so no task gathers more than a race and no row is a season.
    """
    race_keys = ["season", "round", "raceName", "date", *CIRCUIT.names]
    result = F.struct(
        F.struct(*DRIVER.names).alias("Driver"),
        F.struct(*CONSTRUCTOR.names).alias("Constructor"),
        *["grid", "position", "points", "laps", "status"],
    )
    place = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    races = flat.groupBy(*race_keys).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), result.alias("result")))).alias("numbered")
    )
    race = F.struct(
        *["season", "round", "raceName", "date"],
        F.struct(*CIRCUIT.names).alias("Circuit"),
        F.col("numbered.result").alias("Results"),
    )
    number = F.col("round").try_cast("int").alias("n")
    key = F.struct(number, *[F.col(c) for c in ("raceName", "round", "date", *CIRCUIT.names)])
    # Separators need a season's first race, which its keys tell.
    first = flat.groupBy("season").agg(F.min(key).alias("key")).select(F.col("season").alias("of"), F.col("key").alias("first"))
    placed = races.join(first, F.col("season").eqNullSafe(F.col("of")))
    comma = F.when(key.eqNullSafe(F.col("first")), "").otherwise(",")

    def part(kind: int, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key")).alias("part")

    lines = placed.select("season", part(1, key), F.concat(comma, F.to_json(race)).alias("line"))
    ends = [
        first.select(F.col("of").alias("season"), part(kind, F.col("first")), F.lit(text).alias("line"))
        for kind, text in ((0, OPENING), (2, CLOSING))
    ]
    return lines.unionByName(ends[0]).unionByName(ends[1])


def write_season_documents(documents: DataFrame, path: str) -> None:
    """One file for each season, `season=…` in its folder's name. Lines are sorted and written one by one."""
    # The name of a null's folder: it lets the writer take the rows as they are sorted.
    folder = F.coalesce("season", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("season")
    sorted_lines = documents.select(folder, "part", "line").repartition("season").sortWithinPartitions("season", "part")
    sorted_lines.select("season", "line").write.mode("overwrite").partitionBy("season").text(path)


def read_season_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """What `write_season_documents` wrote, by race: as each line holds one, Spark can split a season's file. For
    season documents with other line breaks see `read_documents`."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).filter(~F.col("value").isin(OPENING, CLOSING))
    race = F.from_json(F.ltrim("value", F.lit(",")), RACE)
    return lines.select(F.array(race).alias("Races"))


def as_pages(documents: DataFrame) -> DataFrame:
    """Season documents in the shape of the results service's pages."""
    table = F.struct("Races").alias("RaceTable")
    return documents.select(F.struct(table).alias("MRData"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One document for each line."""
    documents.write.mode("overwrite").json(path)
