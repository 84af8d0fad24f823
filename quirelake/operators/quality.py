"""Ordered imputation, consistency flags and what is counted of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, group: str, order: list[str], column: str = "ATA", issues: str = "_issues", low: int = 20, high: int = 83) -> DataFrame:
    """Blank values take the last valid one before them in their group; filled rows are tagged, their empty flag goes.

    Valid: digits within low and high, padded to two. Others, not blank, are neither changed nor carried.
    """
    value = F.trim(F.col(column))
    n = F.when(value.rlike(r"^\d{1,9}$"), value.try_cast("int"))
    valid = F.when(n.between(low, high), F.lpad(n.cast("string"), 2, "0"))
    carried = F.last(F.col("_valid"), ignorenulls=True).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blank = F.trim(F.col(column)) == ""
    fills = blank & F.col("_carried").isNotNull()
    kept = F.filter(F.split(F.col(issues), ","), lambda x: (x != "") & (x != f"{column}:empty"))
    return (
        df.withColumn("_valid", valid)
        .withColumn("_carried", carried)
        .withColumns({issues: F.when(fills, F.array_join(F.array_append(kept, F.lit(f"_imputed:{column}")), ",")).otherwise(F.col(issues)), column: F.when(fills, F.col("_carried")).otherwise(F.coalesce("_valid", F.col(column)))})
        .drop("_valid", "_carried")
    )


def disagreeing(df: DataFrame, group: list[str], value: str) -> Column:
    """Whether a group's rows have several values that are not blank: a window without order, so one shuffle."""
    w = Window.partitionBy(*group)
    v = F.nullif(F.trim(F.col(value)), F.lit(""))
    return F.coalesce(F.min(v).over(w) != F.max(v).over(w), F.lit(False))


def exploded_issues(df: DataFrame, keep: list[str], issues: str = "_issues") -> DataFrame:
    """A row for each COLUMN:reason; the reason is what follows the first colon."""
    one = df.select(*keep, F.explode(F.filter(F.split(issues, ","), lambda x: x != "")).alias("_i"))
    return one.select(*keep, F.substring_index("_i", ":", 1).alias("column"), F.regexp_replace("_i", "^[^:]*:?", "").alias("reason"))


def percent(part: Column, whole: Column) -> Column:
    """One decimal, halves to even; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(100.0 * part / whole, 1))


def scoreboard(df: DataFrame, keys: list[str], issues: str = "_issues") -> DataFrame:
    """Of each key rows, clean ones, flagged ones, their share and imputed values; imputed rows count as flagged."""
    clean = F.count_if(F.col(issues) == "")
    n = F.count("*")
    imputed = F.count_if(F.contains(F.col(issues), F.lit("_imputed:")))
    return df.groupBy(*keys).agg(n.alias("rows"), clean.alias("clean"), (n - clean).alias("flagged"), percent(clean, n).alias("clean_pct"), imputed.alias("imputed"))


def missing_numbers(seen: Column, upto: Column) -> Column:
    """The numbers from 1 to upto that an array lacks."""
    return F.when(upto > 0, F.array_except(F.sequence(F.lit(1), upto), seen)).otherwise(F.array().cast("array<int>"))


def row_check(parts: list[Column], total: Column) -> Column:
    """OK, MISMATCH, UNPARSEABLE or SKIPPED: whether numbers in cells add up to another cell's."""
    numbers = [F.regexp_replace(p, "[,' ]", "").try_cast("decimal(18,2)") for p in [*parts, total]]
    blank = [F.trim(p) == "" for p in [*parts, total]]
    some = blank[0]
    for b in blank[1:]:
        some = some | b
    added = numbers[0]
    for n in numbers[1:-1]:
        added = added + n
    return F.when(some, "SKIPPED").when(added.isNull() | numbers[-1].isNull(), "UNPARSEABLE").when(added == numbers[-1], "OK").otherwise("MISMATCH")


def profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, mean, the value at place int(0.95 n) of those in order, largest and sum, of each key.

    Rows are first counted by value, which a key's tasks share; places are then sums of counts over its distinct values,
    rounded to nothing: a key with as many values as rows is what windows can't split, counts of few values are cheap.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumns({"_upto": upto, "_n": F.sum("_c").over(w)})

    def at(place: Column) -> Column:
        """The value that has the place, from 0, in the order of all rows."""
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place), F.col(value)))

    half, last = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    return placed.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        ((at(half).cast("double") + at(last).cast("double")) / 2).alias("median"),
        (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"),
        at(F.floor(F.col("_n") * 0.95)).alias("p95"),
        F.max(value).alias("largest"),
        F.sum(F.col(value) * F.col("_c")).alias("total"),
    )
