"""Lines and words of pages to records: the primitives that document layouts are put together from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(value: Column, group: list[str], order: list[str]) -> Column:
    """The last value that is not null up to a row: section headings, or a record's identity for the rows under it."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def island(starts: Column, group: list[str], order: list[str]) -> Column:
    """Numbers of the runs of rows that starts begins; rows before the first are 0."""
    return F.sum(starts.cast("long")).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def merged_continuations(lines: DataFrame, group: str, anchor: str, text: str = "line", order: str = "line_no", sep: str = " ") -> DataFrame:
    """(group, record, first_line, n_lines, text): lines of an anchor pattern with those that follow it; lines before any are left out."""
    marked = lines.withColumn("record", island(F.col(text).rlike(anchor), [group], [order])).filter("record > 0")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return marked.groupBy(group, "record").agg(F.min(order).alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias("text"))


def offset_record(lines: DataFrame, group: list[str], order: str, anchor: str, fields: dict[str, int], text: str = "line") -> DataFrame:
    """Anchor lines with the lines at fixed distances before and after them as columns; none there is empty."""
    w = Window.partitionBy(*group).orderBy(order)
    near = {name: F.coalesce(F.lead(text, by).over(w) if by > 0 else F.lag(text, -by).over(w) if by < 0 else F.col(text), F.lit("")) for name, by in fields.items()}
    return lines.withColumns(near).filter(F.col(text).rlike(anchor))


def row_islands(words: DataFrame, page: list[str], top: str = "top", left: str = "left", height: str = "height", factor: float = 0.7) -> DataFrame:
    """Words with `row`, the number of their line: a new one where the top jumps by more than factor of the median height."""
    median = F.percentile(height, 0.5).over(Window.partitionBy(*page))
    w = Window.partitionBy(*page).orderBy(top, left)
    jump = F.abs(F.col(top) - F.lag(top).over(w)) > factor * F.col("_median")
    marked = words.dropna(subset=page).withColumn("_median", median).withColumn("_jump", F.coalesce(jump, F.lit(False)))
    return marked.withColumn("row", island(F.col("_jump"), page, [top, left])).drop("_median", "_jump")


def banded(x: Column, bands: Sequence[tuple[str, float, float]]) -> Column:
    """The name of the band [low, high) that x lies in, the first of them; null outside all."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, a, b in bands])
    return F.get(F.filter(table, lambda b: (x >= b["low"]) & (x < b["high"])), 0)["name"]


def nearest_anchor(x: Column, anchors: Column, tolerance: float | None = None) -> Column:
    """The value of an array that x is nearest to, the smaller of two; null beyond tolerance."""
    best = F.array_min(F.transform(anchors, lambda a: F.struct(F.abs(a - x).alias("d"), a.alias("a"))))
    return best["a"] if tolerance is None else F.when(best["d"] <= tolerance, best["a"])


def gap_clusters(points: DataFrame, group: list[str], x: str, n: int) -> DataFrame:
    """(group, cluster, center, members): points cut at their n - 1 widest gaps, the median of each part as its center."""
    w = Window.partitionBy(*group).orderBy(x, "point_no")
    gaps = points.withColumn("_gap", F.col(x) - F.lag(x).over(w))
    widest = Window.partitionBy(*group).orderBy(F.desc_nulls_last("_gap"), x, "point_no")
    cut = gaps.withColumn("_cut", F.col("_gap").isNotNull() & (F.row_number().over(widest) <= n - 1))
    return cut.withColumn("cluster", island(F.col("_cut"), group, [x, "point_no"])).groupBy(*group, "cluster").agg(F.percentile(x, 0.5).alias("center"), F.count("*").alias("members"))


def bucketed_rows(words: DataFrame, page: list[str], bands: Sequence[tuple[str, float, float]], text: str = "text", left: str = "left") -> DataFrame:
    """(page, row, columns of the bands): the words of each line and band, from left to right."""
    named = words.withColumn("_band", banded(F.col(left), bands)).filter("_band is not null")
    cells = named.groupBy(*page, "row").pivot("_band", [b[0] for b in bands]).agg(F.array_sort(F.collect_list(F.struct(F.col(left).alias("l"), F.col(text).alias("t")))))
    join = lambda c: F.coalesce(F.array_join(F.transform(F.col(c), lambda p: p["t"]), " "), F.lit(""))
    return cells.select(*page, "row", *[join(b[0]).alias(b[0]) for b in bands])


@dataclass(frozen=True)
class LineLayout:
    """A layout of text lines, declared: which lines are rows, in which forms, and what surrounds them.

    branches: Java patterns tried in order, each with the columns of its groups; the first that matches a line wins.
    section: a pattern whose first group is carried to the rows below as the column section_column.
    header: columns with patterns, found once in a document and put on all its rows.
    continuation: lines that match are appended to the column named, of the row above.
    skip: lines that are headings or feet.
    """

    name: str
    columns: tuple[str, ...]
    branches: tuple[tuple[str, tuple[str, ...]], ...]
    section: str | None = None
    section_column: str = "ATA"
    header: dict[str, str] = field(default_factory=dict)
    continuation: tuple[str, str] | None = None
    skip: str | None = None


def extract(lines: DataFrame, layout: LineLayout, doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, columns): the records of documents' lines (doc, line_no, line). Every value is text.

    Lines are dealt by document once; what surrounds a row is found by windows and groups within that.
    """
    line = F.col("line")
    rows, heads = lines, {}
    if layout.header:
        found = {c: F.min_by(F.regexp_extract("line", p, 1), F.when(line.rlike(p), F.col("line_no"))) for c, p in layout.header.items()}
        heads = {c: f"_head_{c}" for c in layout.header}
        rows = rows.withColumns({heads[c]: F.coalesce(value.over(Window.partitionBy(doc)), F.lit("")) for c, value in found.items()})
    rows = rows.filter(~line.rlike(layout.skip)) if layout.skip else rows
    shapes = []
    for pattern, names in layout.branches:
        fields = [F.regexp_extract(line, pattern, names.index(c) + 1).alias(c) if c in names else F.lit("").alias(c) for c in layout.columns]
        shapes.append(F.when(line.rlike(pattern), F.struct(*fields)))
    rows = rows.withColumn("_record", F.coalesce(*shapes))
    around = ["line_no", "_record", *heads.values()]
    if layout.section:
        heading = F.nullif(F.regexp_extract(line, layout.section, 1), F.lit(""))
        rows = rows.withColumn("_section", carried(heading, [doc], ["line_no"]))
        around.append("_section")
    if layout.continuation:
        pattern, column = layout.continuation
        here = F.col("_record").isNotNull()
        more = ~here & line.rlike(pattern)
        runs = rows.withColumn("_no", island(here, [doc], ["line_no"])).filter(here | more).groupBy(doc, "_no")
        gathered = runs.agg(F.first(F.when(here, F.struct(*around)), ignorenulls=True).alias("_r"), F.array_sort(F.collect_list(F.when(more, F.struct("line_no", F.trim(line).alias("t"))))).alias("_tail"))
        rows = gathered.filter("_r is not null").select(doc, "_r.*", F.when(F.size("_tail") > 0, F.array_join(F.transform("_tail", lambda p: p["t"]), " ")).alias("_tail"))
        extra = {column: F.trim(F.concat_ws(" ", F.col(f"_record.{column}"), F.col("_tail")))}
    else:
        rows, extra = rows.filter("_record is not null"), {}
    if layout.section:
        extra[layout.section_column] = F.coalesce(F.nullif(F.col(f"_record.{layout.section_column}") if layout.section_column in layout.columns else F.lit(""), F.lit("")), F.col("_section"), F.lit(""))
    names = [*layout.columns, *[c for c in extra if c not in layout.columns]]
    told = [extra.get(c, F.col(f"_record.{c}") if c in layout.columns else None).alias(c) for c in names]
    return rows.select(doc, "line_no", *told, *[F.col(h).alias(c) for c, h in heads.items()])
