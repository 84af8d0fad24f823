"""Queries over positions: what sits where, on which sheet, since when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.identity import STRONG_SOURCES
from quirelake.operators import slots
from quirelake.sources.tables import POSITIONS_SQL, TIE, positions

SHOWN = ["aircraft_key", "position", "sheet_type", "family", "report_date_iso", "ata", "part_number", "description", "source_file"]
CARRIED = ["part_number", "description", "report_date_iso", "source_file"]
_TIE = ", ".join(f"{c} DESC" for c in TIE)
_BEST = f"ORDER BY report_date_iso = '', report_date_iso DESC, {_TIE}"
_P = f"WITH p AS ({POSITIONS_SQL})"


def current_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.current_fit(positions(spark, sf_dir), TIE).select(*SHOWN)


def latest_per_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.latest_per(slots.occupied(positions(spark, sf_dir)), ["aircraft_key", "position", "sheet_type"], "report_date_iso", TIE).select(*SHOWN)


def distinct_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.skeleton(positions(spark, sf_dir), ["aircraft_key", "position", "family", "ata", "sheet_type"])


def position_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.history(positions(spark, sf_dir), TIE).select("aircraft_key", "position", "step", "report_date_iso", "part_number", "previous_part", "swapped")


def cross_sheet_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.side_by_side(positions(spark, sf_dir), TIE, CARRIED)


def cross_sheet_of_aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.side_by_side(positions(spark, sf_dir), TIE, [*CARRIED, "ata"], key="17")
    return rows.orderBy(slots.numeric_prefix(F.coalesce("occm_ata", "ht_ata")), "position")


def slot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cross_sheet_slot(spark, sf_dir)
    return rows.groupBy("aircraft_key").pivot("slot_coverage", ["both", "occm_only", "ht_only"]).count().na.fill(0)


def coverage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_sheet_slot(spark, sf_dir).groupBy("slot_coverage").agg(F.count("*").alias("slots"))


def both_sheets_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cross_sheet_slot(spark, sf_dir)
    same = F.col("occm_part_number") == F.col("ht_part_number")
    return rows.filter(F.col("slot_coverage") == "both").select("aircraft_key", "position", "occm_part_number", "ht_part_number", same.alias("same_part"))


def cross_sheet_airframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.on_both_sheets(positions(spark, sf_dir))


def family_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.inherited_family(positions(spark, sf_dir), TIE)
    return rows.groupBy("sheet_type", "family", "inherited").agg(F.count("*").alias("rows"), F.countDistinct("aircraft_key").alias("aircraft"))


def family_only_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.occupied(positions(spark, sf_dir)).withColumn("position", F.concat_ws("/", "position", (F.col("l_suppkey") % 97).cast("string")))
    return slots.only_in(rows, "NATION_3", "NATION_5")


def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).groupBy("family").agg(F.count("*").alias("rows"), F.countDistinct("source_file").alias("files"))


def key_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).groupBy("aircraft_key_source").agg(F.countDistinct("aircraft_key").alias("aircraft"))


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c: F.count_if(F.col(c) != "")
    n = F.count("*")
    return positions(spark, sf_dir).agg(
        n.alias("rows"), has("position").alias("with_position"), has("report_date_iso").alias("dated"), F.countDistinct("aircraft_key").alias("aircraft"), F.bround(100.0 * has("position") / n, 1).alias("position_pct")
    )


def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir)
    return rows.groupBy("aircraft_key").agg(F.max("family").alias("family"), F.count("*").alias("rows"), F.countDistinct(F.nullif("position", F.lit(""))).alias("slots"))


def strong_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir).filter(F.col("aircraft_key_source").isin(*STRONG_SOURCES))
    return rows.groupBy("aircraft_key", "sheet_type").agg(F.count("*").alias("rows"))


def slot_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir).filter((F.col("aircraft_key") == "42") & (F.col("position") == "P7"))
    return rows.select("report_date_iso", "sheet_type", "part_number", "description", "source_file").orderBy("report_date_iso")


def kardex_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir).withColumn("kardex", F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("K"), F.col("l_suppkey").cast("string"))).otherwise(""))
    return rows.filter("kardex <> ''").groupBy("kardex").agg(F.count("*").alias("rows"), F.countDistinct("position").alias("positions"), F.min("part_number").alias("first_part"))


def top_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the ten slots with the most rows."""
    rows = slots.occupied(positions(spark, sf_dir)).groupBy("aircraft_key", "position").agg(F.count("*").alias("rows"))
    return rows.orderBy(F.desc("rows"), "aircraft_key", "position").limit(10)


QUERIES = {f.__name__: f for f in (current_fit, latest_per_sheet, distinct_positions, position_history, cross_sheet_slot, cross_sheet_of_aircraft, slot_coverage, coverage_total, both_sheets_only, cross_sheet_airframes, family_inheritance, family_only_slots, family_rollup, key_source_counts, build_stats, fleet_summary, strong_keys, slot_snapshots, kardex_lookup, top_slots)}


def _side(where: str = "position <> ''", carried: list[str] = CARRIED) -> str:
    cols = lambda k: ", ".join(f"{k[0]}.{c} AS {k}_{c}" for c in carried)
    return f"""{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY aircraft_key, position, sheet_type {_BEST}) AS rn FROM p WHERE {where}),
      o AS (SELECT * FROM r WHERE rn = 1 AND sheet_type = 'OCCM'), h AS (SELECT * FROM r WHERE rn = 1 AND sheet_type = 'HT'),
      s AS (SELECT coalesce(o.aircraft_key, h.aircraft_key) AS aircraft_key, coalesce(o.position, h.position) AS position, {cols("occm")}, {cols("ht")},
        CASE WHEN o.position IS NOT NULL AND h.position IS NOT NULL THEN 'both' WHEN o.position IS NOT NULL THEN 'occm_only' ELSE 'ht_only' END AS slot_coverage
        FROM o FULL OUTER JOIN h ON o.aircraft_key = h.aircraft_key AND o.position = h.position)"""


_OF_17 = "position <> '' AND aircraft_key = '17'"
SQL = {
    "current_fit": f"{_P} SELECT {', '.join(SHOWN)} FROM p WHERE position <> '' QUALIFY row_number() OVER (PARTITION BY aircraft_key, position {_BEST}) = 1",
    "latest_per_sheet": f"{_P} SELECT {', '.join(SHOWN)} FROM p WHERE position <> '' QUALIFY row_number() OVER (PARTITION BY aircraft_key, position, sheet_type {_BEST}) = 1",
    "distinct_positions": f"{_P} SELECT DISTINCT aircraft_key, position, family, ata, sheet_type FROM p WHERE position <> ''",
    "position_history": f"""{_P} SELECT aircraft_key, position, CAST(row_number() OVER w AS INTEGER) AS step, report_date_iso, part_number,
      coalesce(lag(part_number) OVER w, '') AS previous_part, coalesce(lag(part_number) OVER w <> part_number, false) AS swapped
      FROM p WHERE position <> '' WINDOW w AS (PARTITION BY aircraft_key, position ORDER BY report_date_iso, {", ".join(TIE)})""",
    "cross_sheet_slot": f"{_side()} SELECT * FROM s",
    "cross_sheet_of_aircraft": f"{_side(_OF_17, [*CARRIED, 'ata'])} SELECT * FROM s",
    "slot_coverage": f"{_side()} SELECT aircraft_key, count(*) FILTER (slot_coverage = 'both') AS \"both\", count(*) FILTER (slot_coverage = 'occm_only') AS occm_only, count(*) FILTER (slot_coverage = 'ht_only') AS ht_only FROM s GROUP BY 1",
    "coverage_total": f"{_side()} SELECT slot_coverage, count(*) AS slots FROM s GROUP BY 1",
    "both_sheets_only": f"{_side()} SELECT aircraft_key, position, occm_part_number, ht_part_number, occm_part_number = ht_part_number AS same_part FROM s WHERE slot_coverage = 'both'",
    "cross_sheet_airframes": f"{_P} SELECT aircraft_key, max(family) AS family, count(*) FILTER (sheet_type = 'OCCM') AS occm_rows, count(*) FILTER (sheet_type = 'HT') AS ht_rows FROM p GROUP BY 1 HAVING occm_rows > 0 AND ht_rows > 0",
    "family_inheritance": f"""{_P}, g AS (SELECT aircraft_key, arg_min(family, row({", ".join(TIE)})) AS given FROM p WHERE sheet_type = 'OCCM' AND family NOT IN ('', 'Unknown') GROUP BY 1),
      f AS (SELECT p.*, given, sheet_type = 'HT' AND family IN ('', 'Unknown') AND given IS NOT NULL AS inherited FROM p LEFT JOIN g USING (aircraft_key))
      SELECT sheet_type, CASE WHEN inherited THEN given ELSE family END AS family, inherited, count(*) AS rows, count(DISTINCT aircraft_key) AS aircraft FROM f GROUP BY 1, 2, 3""",
    "family_only_slots": f"""{_P}, q AS (SELECT DISTINCT family, position || '/' || (l_suppkey % 97) AS position FROM p WHERE position <> '')
      SELECT position FROM q WHERE family = 'NATION_3' EXCEPT SELECT position FROM q WHERE family = 'NATION_5'""",
    "family_rollup": f"{_P} SELECT family, count(*) AS rows, count(DISTINCT source_file) AS files FROM p GROUP BY 1",
    "key_source_counts": f"{_P} SELECT aircraft_key_source, count(DISTINCT aircraft_key) AS aircraft FROM p GROUP BY 1",
    "build_stats": f"{_P} SELECT count(*) AS rows, count(*) FILTER (position <> '') AS with_position, count(*) FILTER (report_date_iso <> '') AS dated, count(DISTINCT aircraft_key) AS aircraft, round_even(100.0 * count(*) FILTER (position <> '') / count(*), 1) AS position_pct FROM p",
    "fleet_summary": f"{_P} SELECT aircraft_key, max(family) AS family, count(*) AS rows, count(DISTINCT nullif(position, '')) AS slots FROM p GROUP BY 1",
    "strong_keys": f"{_P} SELECT aircraft_key, sheet_type, count(*) AS rows FROM p WHERE aircraft_key_source IN ({', '.join(repr(s) for s in STRONG_SOURCES)}) GROUP BY 1, 2",
    "slot_snapshots": f"{_P} SELECT report_date_iso, sheet_type, part_number, description, source_file FROM p WHERE aircraft_key = '42' AND position = 'P7'",
    "kardex_lookup": f"{_P} SELECT 'K' || l_suppkey AS kardex, count(*) AS rows, count(DISTINCT position) AS positions, min(part_number) AS first_part FROM p WHERE l_partkey % 4 = 0 GROUP BY 1",
    "top_slots": f"{_P} SELECT aircraft_key, position, count(*) AS rows FROM p WHERE position <> '' GROUP BY 1, 2 ORDER BY rows DESC, aircraft_key, position LIMIT 10",
}
