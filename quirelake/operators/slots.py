"""Snapshots of slots: the latest row, skeletons, history, and the two sheets side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: list[str], date: str, tie: list[str]) -> DataFrame:
    """Of each key the row with the newest date, undated rows after all dated ones; ties by the columns of tie, last first.

    One shuffle by the keys; Catalyst keeps a row of each key before it (WindowGroupLimit).
    """
    order = [F.col(date) == "", F.desc(date), *[F.desc(c) for c in tie]]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key its last row in order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    return ranked.filter("_rank = 1").drop("_rank")


def occupied(df: DataFrame) -> DataFrame:
    return df.filter(F.col("position") != "")


def current_fit(df: DataFrame, tie: list[str]) -> DataFrame:
    return latest_per(occupied(df), ["aircraft_key", "position"], "report_date_iso", tie)


def skeleton(df: DataFrame, columns: list[str]) -> DataFrame:
    return occupied(df).select(*columns).distinct()


def history(df: DataFrame, tie: list[str]) -> DataFrame:
    """Every row of a slot in the order of its dates, with the part before it and whether it was swapped."""
    w = Window.partitionBy("aircraft_key", "position").orderBy("report_date_iso", *tie)
    before = F.lag("part_number").over(w)
    return occupied(df).withColumns({"step": F.row_number().over(w), "previous_part": F.coalesce(before, F.lit("")), "swapped": before.isNotNull() & (before != F.col("part_number"))})


def side_by_side(df: DataFrame, tie: list[str], carried: list[str], key: str | None = None) -> DataFrame:
    """The sheets' current rows of each slot, joined in full, with slot_coverage both, occm_only or ht_only.

    key: one aircraft; both inputs are filtered by it, as no filter passes a full join's coalesced key.
    """
    rows = occupied(df) if key is None else occupied(df).filter(F.col("aircraft_key") == key)
    best = latest_per(rows, ["aircraft_key", "position", "sheet_type"], "report_date_iso", tie)

    def sheet(kind: str) -> DataFrame:
        own = best.filter(F.col("sheet_type") == kind)
        return own.select("aircraft_key", "position", *[F.col(c).alias(f"{kind.lower()}_{c}") for c in carried])

    joined = sheet("OCCM").join(sheet("HT"), ["aircraft_key", "position"], "full_outer")
    has = lambda kind: F.col(f"{kind}_{carried[0]}").isNotNull()
    return joined.withColumn("slot_coverage", F.when(has("occm") & has("ht"), "both").when(has("occm"), "occm_only").otherwise("ht_only"))


def inherited_family(df: DataFrame, tie: list[str]) -> DataFrame:
    """Rows of one sheet without a family take that of the other sheet's first known row of the aircraft."""
    known = df.filter((F.col("sheet_type") == "OCCM") & ~F.col("family").isin("", "Unknown"))
    given = known.groupBy("aircraft_key").agg(F.min_by("family", F.struct(*tie)).alias("_family"))
    wants = (F.col("sheet_type") == "HT") & F.col("family").isin("", "Unknown") & F.col("_family").isNotNull()
    return df.join(given, "aircraft_key", "left").withColumns({"inherited": wants, "family": F.when(wants, F.col("_family")).otherwise(F.col("family"))}).drop("_family")


def on_both_sheets(df: DataFrame) -> DataFrame:
    """Aircraft with rows on either sheet, and how many."""
    n = lambda kind: F.count_if(F.col("sheet_type") == kind)
    both = df.groupBy("aircraft_key").agg(F.max("family").alias("family"), n("OCCM").alias("occm_rows"), n("HT").alias("ht_rows"))
    return both.filter("occm_rows > 0 and ht_rows > 0")


def numeric_prefix(c: Column) -> Column:
    """The whole number a text begins with, 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def only_in(df: DataFrame, family: str, other: str) -> DataFrame:
    slots = occupied(df).select("family", "position").distinct()
    return slots.filter(F.col("family") == family).select("position").exceptAll(slots.filter(F.col("family") == other).select("position"))
