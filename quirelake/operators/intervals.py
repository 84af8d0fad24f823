"""Events of installing and removing to validity intervals, and what holds as of a date.

Rows by their defined results: events without a slot, a time or a kind are left out; a null item is an item of its own.
Events count by their time, whatever the order they came in; of one time, removals go first (a swap), then by `tie`.
An event that comes twice, alike in all of these, counts once. A slot's events meet in one task, other slots' do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(events: DataFrame, slot: list[str], item: str, at: str, installs: Column, removes: Column, tie: list[str]) -> DataFrame:
    """(slot, item, valid_from, valid_to, state, overlaps) of events; valid_to is null for what is still there.

    state is closed, open, or what is missing: no_removal where the item is installed again before it was removed (the
    interval ends there), no_install for a removal of what was not there (valid_from is null). overlaps tells that another
    item of the slot was there at the same time; an interval of no length overlaps nothing, nor does one without a start.
    """
    told = events.withColumn("_kind", F.when(installs, 1).when(removes, 0)).filter(F.col("_kind").isNotNull() & F.col(at).isNotNull())
    for c in slot:
        told = told.filter(F.col(c).isNotNull())
    told = told.select(*slot, F.col(item).alias("item"), F.col(at).alias("_at"), "_kind", *tie).distinct()
    own = Window.partitionBy(*slot, "item").orderBy("_at", "_kind", *tie)
    near = told.withColumns({"_next": F.lead("_at").over(own), "_next_kind": F.lead("_kind").over(own), "_last_kind": F.lag("_kind").over(own)})
    rows = near.filter((F.col("_kind") == 1) | (F.coalesce("_last_kind", F.lit(0)) == 0))
    state = F.when(F.col("_kind") == 0, "no_install").when(F.col("_next").isNull(), "open").when(F.col("_next_kind") == 1, "no_removal").otherwise("closed")
    spans = rows.select(*slot, "item", F.when(F.col("_kind") == 1, F.col("_at")).alias("valid_from"), F.when(F.col("_kind") == 0, F.col("_at")).otherwise(F.col("_next")).alias("valid_to"), state.alias("state"))
    real = F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    by_start = Window.partitionBy(*slot, "_real").orderBy("valid_from", F.col("valid_to").asc_nulls_last(), "item")
    upto, after = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, 1)
    marked = spans.withColumn("_real", real)
    open_before = F.max(F.when(F.col("valid_to").isNull(), 1).otherwise(0)).over(upto) == 1
    before = open_before | (F.max("valid_to").over(upto) > F.col("valid_from"))
    follows = F.min("valid_from").over(after)
    next_ = follows.isNotNull() & (F.col("valid_to").isNull() | (follows < F.col("valid_to")))
    return marked.withColumn("overlaps", F.col("_real") & (F.coalesce(before, F.lit(False)) | next_)).drop("_real")


def as_of(spans: DataFrame, when: Column) -> DataFrame:
    """The intervals that hold at a time: from their start on, up to but not at their end."""
    return spans.filter((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))
