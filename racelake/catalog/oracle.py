"""The same views in DuckDB's SQL, as named parts that a query's text is put together from."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *needs: str):
    def keep(text: str) -> str:
        VIEWS[name] = (needs, text.strip())
        return text

    return keep


def with_views(body: str, *needs: str, instead: dict[str, str] | None = None) -> str:
    """`body` after a WITH clause of the views in `needs` and those under them. `instead` takes a view's text from
    another view."""
    instead, order = instead or {}, []

    def visit(name: str) -> None:
        if name not in order:
            for need in VIEWS[instead.get(name, name)][0]:
                visit(need)
            order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{name} AS (\n{VIEWS[instead.get(name, name)][1]}\n)" for name in order)
    return f"WITH {parts}\n{body.strip()}"


view("race_laps")("""
SELECT CAST(year(l_shipdate) AS INT) AS season,
       concat('race_', CAST(month(l_shipdate) AS STRING)) AS race,
       concat('S', CAST(l_suppkey AS STRING)) AS driver,
       CAST(l_suppkey AS STRING) AS driver_number,
       n_name AS team_name,
       lap_number,
       l_shipdate AS lapstartdate,
       CASE WHEN lap_number % 11 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS position,
       CASE WHEN lap_number = 1 THEN NULL ELSE 1 + CAST(floor(lap_number / 4) AS INT) END AS stint,
       CASE WHEN lap_number = 1 THEN 'nan' WHEN l_returnflag = 'R' THEN 'SOFT'
            WHEN l_returnflag = 'A' THEN 'HARD' ELSE 'MEDIUM' END AS compound,
       CASE WHEN lap_number = 1 THEN NULL ELSE lap_number % 4 END AS tyre_life,
       (l_returnflag = 'N') AS fresh_tyre,
       (l_linenumber = 6) AS is_pit_in_lap,
       (l_linenumber = 7) AS is_pit_out_lap,
       (l_linenumber IN (6, 7)) AS is_pit_lap,
       (l_linestatus = 'F') AS is_green,
       (l_linenumber % 3 = 0) AS is_yellow,
       (l_linenumber = 5) AS is_safety_car,
       (l_discount > 0.095) AS is_red_flag,
       (l_linenumber = 4) AS is_vsc,
       (l_tax > 0.065) AS is_raining,
       CAST(floor(l_extendedprice) AS DOUBLE) AS lap_time_ms
FROM (SELECT l.*, s_nationkey,
             CAST(row_number() OVER (PARTITION BY year(l_shipdate), month(l_shipdate), l_suppkey
                  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS INT) AS lap_number
      FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey) x
JOIN nation ON s_nationkey = n_nationkey
""")

view("race_weather", "race_laps")("""
SELECT season, race, driver, lap_number,
       lap_time_ms % 17 + 15 AS airtemp, lap_time_ms % 61 + 30 AS humidity,
       lap_time_ms % 31 + 990 AS pressure, is_raining AS rainfall,
       lap_time_ms % 23 + 25 AS tracktemp, lap_time_ms % 360 AS winddirection,
       lap_time_ms % 9 AS windspeed
FROM race_laps WHERE lap_number % 5 <> 0
""")

view("race_results", "race_laps")("""
SELECT season, race, driver AS abbreviation, team_name AS teamname,
       CASE WHEN CAST(driver_number AS INT) % 13 = 0 THEN NULL ELSE
            CAST(row_number() OVER (PARTITION BY season, race ORDER BY best, driver) AS INT) END AS gridposition,
       CAST(row_number() OVER (PARTITION BY season, race ORDER BY laps DESC, best, driver) AS INT) AS position,
       CASE WHEN laps < 3 THEN 'Retired' WHEN laps % 5 = 0 THEN '+1 Lap'
            WHEN laps = 7 THEN NULL ELSE 'Finished' END AS status
FROM (SELECT season, race, driver, driver_number, team_name, count(*) AS laps, min(lap_time_ms) AS best
      FROM race_laps GROUP BY season, race, driver, driver_number, team_name) r
""")

view("raw_laps", "race_laps")("""
SELECT season, race, driver, lap_number,
       CASE WHEN lap_number % 9 = 0 THEN 'NaT'
            WHEN lap_number % 7 = 0 THEN concat(CAST(ms AS STRING), '.5')
            WHEN lap_number % 4 = 0 THEN substr(txt, 8)
            WHEN lap_number % 10 = 0 THEN NULL ELSE txt END AS laptime,
       CASE WHEN is_pit_in_lap THEN txt ELSE 'NaT' END AS pitintime,
       CASE WHEN is_pit_out_lap THEN txt ELSE '' END AS pitouttime,
       CASE WHEN is_green AND is_yellow THEN '1;2' WHEN is_green THEN '1' WHEN is_yellow THEN '2'
            WHEN is_safety_car THEN '4;6' WHEN is_vsc THEN '12' ELSE NULL END AS trackstatus,
       CASE WHEN fresh_tyre THEN 'True' WHEN is_raining THEN 'None' ELSE 'False' END AS freshtyre,
       CASE WHEN compound = 'nan' THEN NULL ELSE compound END AS compound,
       CAST(tyre_life AS DOUBLE) AS tyrelife
FROM (SELECT y.*, concat('0 days ', lpad(CAST(CAST(floor(ms / 3600000) AS INT) AS STRING), 2, '0'), ':',
             lpad(CAST(CAST(floor(ms / 60000) AS INT) % 60 AS STRING), 2, '0'), ':',
             lpad(CAST(CAST(floor(ms / 1000) AS INT) % 60 AS STRING), 2, '0'), '.',
             lpad(CAST(ms % 1000 AS STRING), 3, '0'), '000') AS txt
      FROM (SELECT r.*, CAST(floor(lap_time_ms) AS INT) AS ms FROM race_laps r) y) z
""")

view("silver_race_laps", "race_laps", "race_weather", "race_results")("""
SELECT l.* EXCLUDE (team_name), w.airtemp AS air_temp, w.humidity, w.pressure, w.tracktemp AS track_temp,
       w.winddirection AS wind_direction, w.windspeed AS wind_speed,
       r.gridposition AS grid_position, r.position AS finish_position, r.status AS race_status,
       r.teamname AS team_name
FROM race_laps l
LEFT JOIN race_weather w ON l.season = w.season AND l.race = w.race AND l.driver = w.driver
     AND l.lap_number = w.lap_number
LEFT JOIN race_results r ON l.season = r.season AND l.race = r.race AND l.driver = r.abbreviation
""")

view("driver_summary", "silver_race_laps")("""
SELECT *, grid_position - finish_position AS position_gain,
       CASE WHEN finish_position <= 10 THEN 1 ELSE 0 END AS finished_top_10,
       CASE WHEN finish_position <= 3 THEN 1 ELSE 0 END AS finished_top_3,
       CASE WHEN race_status <> 'Finished' THEN 1 ELSE 0 END AS dnf_flag
FROM (SELECT season, race, driver, team_name, min(lapstartdate) AS race_date, count(*) AS laps_completed,
             avg(lap_time_ms) AS avg_lap_time_ms, min(lap_time_ms) AS best_lap_time_ms,
             CAST(sum(CASE WHEN is_pit_lap THEN 1 ELSE 0 END) AS BIGINT) AS pit_stop_count,
             arg_min(grid_position, lap_number) FILTER (WHERE grid_position IS NOT NULL) AS grid_position,
             arg_min(finish_position, lap_number) FILTER (WHERE finish_position IS NOT NULL) AS finish_position,
             arg_min(race_status, lap_number) FILTER (WHERE race_status IS NOT NULL) AS race_status
      FROM silver_race_laps GROUP BY season, race, driver, team_name) g
""")

view("constructor_summary", "driver_summary")("""
SELECT season, race, team_name, min(race_date) AS race_date, count(*) AS num_drivers,
       avg(finish_position) AS avg_finish_position, min(finish_position) AS best_finish_position,
       CAST(sum(position_gain) AS BIGINT) AS total_position_gain, avg(avg_lap_time_ms) AS avg_lap_time_ms,
       min(best_lap_time_ms) AS best_lap_time_ms, CAST(sum(pit_stop_count) AS BIGINT) AS total_pit_stops,
       CAST(sum(finished_top_10) AS BIGINT) AS top_10_finishes,
       CAST(sum(finished_top_3) AS BIGINT) AS podium_finishes, CAST(sum(dnf_flag) AS BIGINT) AS dnf_count
FROM driver_summary GROUP BY season, race, team_name
""")

view("driver_form", "driver_summary")("""
SELECT *, avg(finish_position) OVER w3 AS avg_finish_last_3, avg(finish_position) OVER w5 AS avg_finish_last_5,
       avg(position_gain) OVER w5 AS avg_position_gain_last_5,
       CAST(sum(finished_top_10) OVER w5 AS BIGINT) AS top_10_count_last_5,
       CAST(sum(finished_top_3) OVER w5 AS BIGINT) AS podium_count_last_5,
       CAST(sum(dnf_flag) OVER w5 AS BIGINT) AS dnf_count_last_5
FROM driver_summary
WINDOW w3 AS (PARTITION BY driver, season ORDER BY race_date NULLS FIRST, race NULLS FIRST
              ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
       w5 AS (PARTITION BY driver, season ORDER BY race_date NULLS FIRST, race NULLS FIRST
              ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")

view("constructor_form", "constructor_summary")("""
SELECT *, avg(avg_finish_position) OVER w3 AS avg_finish_last_3,
       avg(avg_finish_position) OVER w5 AS avg_finish_last_5,
       avg(total_position_gain) OVER w5 AS avg_position_gain_last_5,
       CAST(sum(top_10_finishes) OVER w5 AS BIGINT) AS top_10_count_last_5,
       CAST(sum(podium_finishes) OVER w5 AS BIGINT) AS podium_count_last_5,
       CAST(sum(dnf_count) OVER w5 AS BIGINT) AS dnf_count_last_5
FROM constructor_summary
WINDOW w3 AS (PARTITION BY team_name, season ORDER BY race_date NULLS FIRST, race NULLS FIRST
              ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
       w5 AS (PARTITION BY team_name, season ORDER BY race_date NULLS FIRST, race NULLS FIRST
              ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")

view("lap_rows", "silver_race_laps")("""
SELECT season, race, driver, driver_number, team_name, lap_number, lapstartdate AS lap_context_time, position,
       stint, compound, tyre_life, fresh_tyre, is_pit_lap, is_pit_in_lap, is_pit_out_lap, is_green, is_yellow,
       is_safety_car, is_red_flag, is_vsc, air_temp, humidity, pressure, track_temp, wind_direction, wind_speed,
       is_raining, lag(lap_time_ms) OVER w AS last_lap_time_ms, lag(is_green) OVER w AS last_lap_is_green,
       lag(is_yellow) OVER w AS last_lap_is_yellow, lag(is_safety_car) OVER w AS last_lap_is_safety_car,
       avg(lap_time_ms) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS avg_lap_time_last_2,
       avg(lap_time_ms) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS avg_lap_time_last_3,
       lap_time_ms AS target_lap_time_ms
FROM silver_race_laps
WINDOW w AS (PARTITION BY season, race, driver ORDER BY lap_number NULLS FIRST)
""")

view("next_compound", "lap_rows")("""
SELECT * FROM (
  SELECT * REPLACE (first_value(CASE WHEN compound NOT IN ('nan', 'UNKNOWN') THEN compound END IGNORE NULLS)
      OVER (PARTITION BY season, race, driver ORDER BY lap_number NULLS FIRST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS compound)
  FROM lap_rows) c
WHERE compound IS NOT NULL
""")

view("season_results")("""
SELECT CAST(year(o_orderdate) AS INT) AS season,
       CAST(month(o_orderdate) AS INT) AS round,
       CAST(o_orderdate AS DATE) AS date,
       o_orderkey AS result_id,
       concat('race_', CAST(month(o_orderdate) AS STRING)) AS race_name,
       concat('circuit_', CAST(month(o_orderdate) AS STRING)) AS circuit_id,
       c_name AS driver_id,
       concat('C', CAST(o_custkey AS STRING)) AS code,
       concat('team_', CAST(c_nationkey AS STRING)) AS constructor_id,
       CAST(o_orderkey * 7 % 20 + 1 AS INT) AS grid,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 20 + 1 AS INT) END AS position,
       CAST(floor(o_totalprice / 10000) AS DOUBLE) AS points,
       CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN '+1 Lap' ELSE 'Retired' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey
""")

view("flat_results", "season_results")("""
SELECT result_id, CAST(season AS STRING) AS season, CAST(round AS STRING) AS round, race_name AS "raceName",
       CASE WHEN result_id % 97 = 0 THEN 'unknown' ELSE CAST(date AS STRING) END AS date,
       circuit_id AS "circuitId", concat('Circuit ', CAST(round AS STRING)) AS "circuitName",
       driver_id AS "driverId", code, concat('Given ', CAST(result_id % 31 AS STRING)) AS "givenName",
       concat('Family ', code) AS "familyName",
       CASE WHEN result_id % 11 <> 0 THEN concat('N', CAST(result_id % 7 AS STRING)) END AS nationality,
       constructor_id AS "constructorId", concat('Team ', constructor_id) AS name,
       CAST(grid AS STRING) AS grid, coalesce(CAST(position AS STRING), 'R') AS position,
       CAST(points AS STRING) AS points, CAST(result_id % 70 AS STRING) AS laps, status
FROM season_results
""")

view("race_features", "season_results")("""
SELECT *, CASE WHEN position <= 10 THEN 1 ELSE 0 END AS finished_top_10,
       CASE WHEN position <= 3 THEN 1 ELSE 0 END AS finished_top_3, grid - position AS position_gain
FROM season_results
""")

for _key, _prefix, _view, _wins in (
    ("code", "driver", "driver_stats", 1),
    ("constructor_id", "constructor", "constructor_stats", 10),
):
    view(_view, "season_results")(f"""
SELECT {_key}, count(*) AS {_prefix}_num_races, avg(position) AS {_prefix}_avg_position,
       avg(points) AS {_prefix}_avg_points,
       CAST(sum(CASE WHEN position <= {_wins} THEN 1 ELSE 0 END) AS BIGINT) AS {_prefix}_wins,
       CAST(sum(CASE WHEN position <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS {_prefix}_top10_finishes,
       CAST(sum(CASE WHEN position <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS {_prefix}_podium_finishes,
       avg(grid - position) AS {_prefix}_avg_position_gain
FROM season_results GROUP BY {_key}
""")

view("lake_rows", "flat_results")("""
SELECT *, CASE WHEN position <= 10 THEN 1 ELSE 0 END AS finished_top_10,
       CASE WHEN position <= 3 THEN 1 ELSE 0 END AS finished_top_3, grid - position AS position_gain
FROM (SELECT DISTINCT CAST(season AS INT) AS season, CAST(round AS INT) AS round, "raceName" AS race_name,
             TRY_CAST(date AS DATE) AS date, "circuitId" AS circuit_id, "circuitName" AS circuit_name,
             "driverId" AS driver_id, code, "givenName" AS given_name, "familyName" AS family_name, nationality,
             "constructorId" AS constructor_id, name, CAST(grid AS INT) AS grid, TRY_CAST(position AS INT) AS position,
             CAST(points AS DOUBLE) AS points, CAST(laps AS INT) AS laps, status
      FROM flat_results) r
""")
