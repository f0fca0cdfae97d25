"""All stages in order of dependency, each reading what earlier stages stored.

Layout: `{lake}/{layer}/{table}`. Raw and bronze tables are partitioned by season and race, raw ones by session type
too, and replace the sessions they get rows for; a race that is dropped from the calendar stays in bronze until its
season's folder is removed. Silver and gold tables are partitioned by season and replaced by whole seasons: those of
the run, or all, so that a race that no longer has rows leaves none behind. Tables of laps, and what is joined to them,
also lie in buckets of (race, driver): from silver on, laps are aggregated, windowed and joined where they are stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racelake import schemas
from racelake.operators.ordered import Past
from racelake.plans import datasets, laps, results, summaries
from racelake.session import COMPILED, set_inside
from racelake.sources.bucketed import Layout, default_buckets, layout_of, read_bucketed, stay, write_bucketed
from racelake.sources.calendar import in_calendar
from racelake.sources.documents import flatten_results, read_documents, read_rescued
from racelake.sources.lookup import read_lookup, write_lookup
from racelake.sources.ordered_tables import write_in_order
from racelake.sources.tables import read_optional, read_required, replace_partitions, stored_values, write_table

# Table names and their raw shapes.
SESSION_TABLES = {
    "laps": schemas.RAW_LAPS,
    "lap_weather": schemas.RAW_LAP_WEATHER,
    "results": schemas.RAW_RESULTS,
}
SESSION = ["season", "race"]
BUCKET_KEYS = ("race", "driver")


class Lake:
    """Tables under one root, and the seasons that a run replaces (None: all). `buckets` counts for tables that don't
    exist yet; tables of another format than Parquet have none."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        fmt: str = "parquet",
        seasons: Sequence[int] | None = None,
        buckets: int | None = None,
    ):
        self.spark, self.root, self.fmt, self.seasons = spark, root.rstrip("/"), fmt, seasons
        self.buckets = buckets or default_buckets(spark)

    def of(self, seasons: Sequence[int] | None) -> Lake:
        """The same lake for a run over other seasons."""
        return Lake(self.spark, self.root, self.fmt, seasons, self.buckets)

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def read(self, layer: str, table: str) -> DataFrame:
        """A stored table; seasons not asked for are pruned by folder."""
        return self._wanted(read_required(self.spark, self.path(layer, table), self.fmt))

    def read_optional(self, layer: str, table: str, schema: T.StructType) -> DataFrame:
        return self._wanted(read_optional(self.spark, self.path(layer, table), schema, self.fmt))

    def write_sessions(self, df: DataFrame, layer: str, table: str, partition_by: Sequence[str]) -> None:
        """Replaces the sessions that `df` has rows for."""
        with set_inside(self.spark, COMPILED):
            write_table(df, self.path(layer, table), partition_by, self.fmt, touched_only=True)

    def write(
        self, df: DataFrame, layer: str, table: str, partition_by: Sequence[str] = ("season",), placed: bool = False
    ) -> None:
        """Replaces the seasons of the run as a whole, or all of them, also where `df` has no rows for them.

        One job writes all seasons; until it has succeeded, the old table stays. `placed` rows come from buckets and are
        written from there, as many files as buckets for each season, and not exchanged.
        """
        path = self.path(layer, table)
        with set_inside(self.spark, COMPILED):
            if not partition_by:
                write_table(df, path, (), self.fmt)
                return
            within = self.seasons if partition_by[0] == "season" else None
            replace_partitions(df, path, partition_by, self.fmt, within, placed=placed)

    def dealt(self, df: DataFrame, layer: str, table: str) -> DataFrame:
        """`df` dealt to the buckets of a table that `write_by_driver` writes, where it has their keys."""
        if self.fmt != "parquet" or not {*BUCKET_KEYS} <= {*df.columns}:
            return df
        kept = layout_of(self.spark, self.path(layer, table))
        return df.repartition(kept.buckets if kept else self.buckets, *BUCKET_KEYS)

    def write_by_driver(self, df: DataFrame, layer: str, table: str, placed: bool = False) -> None:
        """`write` by season, in buckets of (race, driver). `placed` rows come from such a table and stay put."""
        if self.fmt != "parquet":
            self.write(df, layer, table)
            return
        order = ("lap_number",) if "lap_number" in df.columns else ()
        layout = Layout(self.buckets, BUCKET_KEYS, order, ("season",))
        with set_inside(self.spark, COMPILED):
            write_bucketed(df, self.path(layer, table), layout, self.seasons, placed)

    def read_by_driver(self, layer: str, table: str) -> DataFrame:
        if self.fmt != "parquet":
            return self.read(layer, table)
        return self._wanted(read_bucketed(self.spark, self.path(layer, table)))

    def _wanted(self, df: DataFrame) -> DataFrame:
        return df if self.seasons is None else df.filter(F.col("season").isin(list(self.seasons)))


def write_raw_session(lake: Lake, table: str, session: DataFrame, identity: str = "grand_prix") -> None:
    """A session's table (with metadata) beside the others; the session alone is replaced.

    `identity` names the column that tells the races of a season apart. Where a country has two of them, the grand prix
    (a country) doesn't: take the event's name then, here and for the calendar (`build_calendar(race="event_name")`).
    """
    keyed = laps.storable(session).withColumn("race", laps.slug(F.col(identity)))
    lake.write_sessions(keyed, "raw", table, [*SESSION, "session_type"])


def to_bronze(lake: Lake, calendar: DataFrame | None = None, session_type: str = "R") -> None:
    """Every session of the wanted seasons, or those in `calendar`; a table that is absent is left out."""
    for table, schema in SESSION_TABLES.items():
        raw = lake.read_optional("raw", table, schema).filter(F.col("session_type") == session_type)
        tidy = laps.bronze(raw, table, session_type)
        kept = tidy if calendar is None else in_calendar(tidy, calendar)
        lake.write_sessions(kept, "bronze", table, SESSION)


def to_silver(lake: Lake, separator: str | None = ";") -> None:
    """One plan for all sessions: three scans, two joins, one write. Laps and weather are dealt to the buckets of the
    silver table first, so that laps are joined and stored where they are."""
    tables = {
        name: lake.read_optional("bronze", name, laps.normalize_names(lake.spark.createDataFrame([], schema)).schema)
        for name, schema in SESSION_TABLES.items()
        if name != "laps"
    }
    laps_table, weather = (lake.dealt(df, "silver", "laps") for df in (lake.read("bronze", "laps"), tables["lap_weather"]))
    silver = laps.silver(laps_table, weather, tables["results"], separator)
    with stay(lake.spark):
        lake.write_by_driver(silver, "silver", "laps", placed=True)


def to_gold(lake: Lake, carry_over: bool = False, in_order: bool = False) -> None:
    """`carry_over` lets form go on across seasons: it is taken up from the state that the season before left, and
    seasons after those of the run are done again, as theirs depends on it. `in_order` stores the lap table in time
    order, with each lap's place in its season."""
    if carry_over and lake.seasons is not None:
        stored = [int(v) for v in stored_values(lake.spark, lake.path("silver", "laps"), "season", lake.fmt)]
        lake = lake.of(sorted({*lake.seasons, *[s for s in stored if s > min(lake.seasons)]}))
    silver = lake.read_by_driver("silver", "laps")
    lake.write(summaries.driver_race_summary(silver), "gold", "driver_race_summary")
    drivers = lake.read("gold", "driver_race_summary")
    lake.write(summaries.constructor_race_summary(drivers), "gold", "constructor_race_summary")
    for who, entity, past in (
        ("driver", "driver", summaries.DRIVER_FORM),
        ("constructor", "team_name", summaries.TEAM_FORM),
    ):
        summary = lake.read("gold", f"{who}_race_summary")
        form = _carried_form(lake, summary, who, entity, past) if carry_over else summaries.recent_form(summary, entity, past)
        lake.write(form, "gold", f"{who}_recent_form")
    driver_form = lake.read("gold", "driver_recent_form")
    team_form = lake.read("gold", "constructor_recent_form")
    lake.write(datasets.race_dataset(drivers, driver_form, team_form), "gold", "prediction_dataset")
    lake.write_by_driver(datasets.lap_history(driver_form, team_form), "gold", "lap_history")
    with stay(lake.spark):
        lake.write_by_driver(datasets.lap_dataset(silver), "gold", "lap_prediction_dataset", placed=True)
        ml = lap_rows_for_models(lake, keep_time=in_order)
        if in_order:
            write_in_order(ml, lake.path("gold", "lap_ml_table"), datasets.TIME_ORDER, "time_order", ["season"], lake.fmt, lake.seasons)
        else:
            lake.write(ml, "gold", "lap_ml_table", placed=lake.fmt == "parquet")


def lap_rows_for_models(lake: Lake, keep_time: bool = False) -> DataFrame:
    """The lap table for models from what is stored, in no order; laps stay in their buckets."""
    lap_rows = lake.read_by_driver("gold", "lap_prediction_dataset")
    history = lake.read_by_driver("gold", "lap_history")
    return datasets.lap_ml_table_as_stored(lap_rows, history, ordered=False, keep_time=keep_time)


def _carried_form(lake: Lake, summary: DataFrame, who: str, entity: str, past: Sequence[Past]) -> DataFrame:
    table = f"{who}_form_state"
    before = None
    if lake.seasons is not None:
        known = [int(v) for v in stored_values(lake.spark, lake.path("gold", table), "as_of", lake.fmt)]
        earlier = [s for s in known if s < min(lake.seasons)]
        if earlier:
            state = read_required(lake.spark, lake.path("gold", table), lake.fmt)
            before = state.filter(F.col("as_of") == max(earlier)).drop("as_of")
    seasons = lake.seasons or [int(v) for v in stored_values(lake.spark, lake.path("gold", f"{who}_race_summary"), "season", lake.fmt)]
    after = summaries.form_state(summary, entity, past, seasons, before)
    replace_partitions(after, lake.path("gold", table), ["as_of"], lake.fmt, lake.seasons)
    return summaries.carried_form(summary, entity, past, before)


def run_laps(
    lake: Lake,
    calendar: DataFrame | None = None,
    session_type: str = "R",
    carry_over: bool = False,
    in_order: bool = False,
) -> None:
    to_bronze(lake, calendar, session_type)
    to_silver(lake)
    to_gold(lake, carry_over, in_order)


def run_season_results(
    lake: Lake, documents: str | Sequence[str], multi_line: bool = True, quarantine: bool = False
) -> None:
    """Documents of any number of seasons to the season prediction dataset. With `quarantine`, what they hold beyond
    their declared shape, and broken ones, are kept in bronze as `season_results_quarantine`."""
    if quarantine:
        read, strays = read_rescued(lake.spark, documents, multi_line)
        lake.write(strays, "bronze", "season_results_quarantine", ())
    else:
        read = read_documents(lake.spark, documents, multi_line)
    lake.write(flatten_results(read), "bronze", "season_results")
    lake.write(results.clean_results(lake.read("bronze", "season_results")), "silver", "season_results")
    write_careers(lake)
    lake.write(results.race_features(lake.read("silver", "season_results")), "gold", "race_features")
    dataset = results.season_dataset(
        lake.read("gold", "race_features"),
        *[read_lookup(lake.spark, lake.path("gold", f"{who}_stats"), lake.fmt) for who in CAREERS],
    )
    lake.write(dataset, "gold", "season_dataset")


# Career tables: their key, their prefix, and the place that counts as a win.
CAREERS = {
    "driver": ("code", "driver_", results.WINNER),
    "constructor": ("constructor_id", "constructor_", results.TOP),
}


def write_careers(lake: Lake) -> None:
    """Career statistics over all stored seasons. Each season's share is kept, so a run reads the results of its own
    seasons only, and the shares of all."""
    for who, (key, prefix, wins_within) in CAREERS.items():
        shares = lake.path("gold", f"{who}_season_shares")
        # A lake without shares gets those of every season.
        known = stored_values(lake.spark, shares, "season", lake.fmt)
        run = lake if known else lake.of(None)
        run.write(results.career_shares(run.read("silver", "season_results"), key, wins_within), "gold", f"{who}_season_shares")
        stats = results.merged_careers(read_required(lake.spark, shares, lake.fmt), key, prefix)
        write_lookup(stats, lake.path("gold", f"{who}_stats"), key, lake.fmt)
