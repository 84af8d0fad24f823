"""Layouts that are more than a pattern of a line: tokens around an anchor, matrices of metrics, word bands, ruled lines.

A document's lines, or a page's words, meet in one task; documents do not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import blank
from quirelake.operators.layout import banded, bucketed_rows, island, row_islands

# The least confidence of a recognised word, and the least characters of a page that is read.
CONFIDENCE, SHORT_PAGE = 30, 100
# Pixels. Adjacent ones are one ruled line, near ones a line drawn twice; wide gaps end a table.
ADJACENT, DOUBLED, WIDE, LEAST_LINES = 2, 15, 150, 4


def is_position_code(c: Column) -> Column:
    """Two to ten capitals and digits, some of both."""
    return blank(c).rlike("^(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]{2,10}$")


def date_and_task(line: Column) -> Column:
    """(date, task) of the first token that is a date, or one with a task's name glued on."""
    form = r"(?:^|\s)(\d{2}-\d{2}-\d{4}|\d{2}-[A-Z]{3}-\d{2})([A-Z]*)(?=[^A-Za-z0-9_]|$)"
    return F.struct(F.regexp_extract(blank(line), form, 1).alias("date"), F.regexp_extract(blank(line), form, 2).alias("task"))


def long_pages(pages: DataFrame, text: str = "text", least: int = SHORT_PAGE) -> DataFrame:
    return pages.filter(F.length(blank(F.col(text))) >= least)


def confident(words: DataFrame, conf: str = "conf", least: float = CONFIDENCE) -> DataFrame:
    """Words that were recognised with more than the least confidence; unknown confidence is none."""
    return words.filter(F.col(conf) > least)


@dataclass(frozen=True)
class TokenLayout:
    """Rows told by one token, the anchor; the others have their columns by their distance from it or from the start.

    first: columns from the start, each with the pattern of its token; one that does not match has no token and is empty.
    last: columns that end just before the anchor, in reading order. middle: the column of all tokens between.
    after: columns that follow the anchor; a row must have them all. tail: the column of whatever follows, nothing is lost.
    """

    name: str
    anchor: tuple[str, str]
    first: tuple[tuple[str, str], ...] = ()
    middle: str = "DESCRIPTION"
    last: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    tail: str = "STATUS_TRAIL"
    skip: str | None = None


def token_rows(lines: DataFrame, layout: TokenLayout, doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, the layout's columns) of lines (doc, line_no, line) that hold the anchor and enough tokens around it."""
    name, pattern = layout.anchor
    line = F.trim(F.regexp_replace(blank(F.col("line")), r"\s+", " "))
    rows = lines.filter(~F.col("line").rlike(layout.skip)) if layout.skip else lines
    rows = rows.filter(line != "").select(doc, "line_no", F.split(line, " ").alias("_t"))
    rows = rows.withColumn("_at", F.array_position(F.transform("_t", lambda t: t.rlike(pattern)), True).cast("int") - 1)
    rows = rows.filter((F.col("_at") >= len(layout.last)) & (F.size("_t") > F.col("_at") + len(layout.after)))
    rows = rows.withColumn("_from", F.lit(0))
    left = F.col("_at") - len(layout.last)
    for column, form in layout.first:
        token = F.when(F.col("_from") < left, F.get("_t", F.col("_from")))
        rows = rows.withColumn(column, F.when(token.rlike(form), token).otherwise(""))
        rows = rows.withColumn("_from", F.col("_from") + (F.col(column) != "").cast("int"))
    some = lambda start, n: F.array_join(F.slice("_t", start + 1, F.greatest(n, F.lit(0))), " ")
    after = F.col("_at") + 1 + len(layout.after)
    return rows.select(
        doc,
        "line_no",
        *[c for c, _ in layout.first],
        some(F.col("_from"), left - F.col("_from")).alias(layout.middle),
        *[F.get("_t", left + i).alias(c) for i, c in enumerate(layout.last)],
        F.get("_t", F.col("_at")).alias(name),
        *[F.get("_t", F.col("_at") + 1 + i).alias(c) for i, c in enumerate(layout.after)],
        some(after, F.size("_t") - after).alias(layout.tail),
    )


@dataclass(frozen=True)
class MetricLayout:
    """A component's line, by a pattern with the groups of its columns, and lines of metrics, each with a value for each base."""

    name: str
    component: tuple[str, tuple[str, ...]]
    metrics: tuple[str, ...]
    bases: tuple[str, ...]
    missing: str = "?"


def metric_rows(lines: DataFrame, layout: MetricLayout, doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, columns, METRIC_BASE...): one row of each component; a metric's first line counts, no line is empty.

    A metric is the end of a line, its name and a value for each base; it may end the component's own line.
    """
    pattern, names = layout.component
    line, no = blank(F.col("line")), F.col("line_no")
    rows = lines.withColumn("record", island(line.rlike(pattern), [doc], ["line_no"])).filter("record > 0")
    fields = [F.min_by(F.regexp_extract(line, pattern, i), no).alias(c) for i, c in enumerate(names, 1)]
    values = []
    for metric in layout.metrics:
        form = rf"(?:^|\s){metric}" + r"\s+(\S+)" * len(layout.bases) + r"\s*$"
        cells = F.array(*[F.regexp_extract(line, form, i) for i in range(1, len(layout.bases) + 1)])
        values.append(F.min_by(cells, F.when(line.rlike(form), no)).alias(f"_{metric}"))
    out = rows.groupBy(doc, "record").agg(F.min(no).alias("line_no"), *fields, *values)
    shown = lambda c: F.when(c == layout.missing, "").otherwise(F.coalesce(c, F.lit("")))
    return out.select(doc, "line_no", *names, *[shown(F.get(f"_{m}", F.lit(i))).alias(f"{m.upper()}_{b}") for m in layout.metrics for i, b in enumerate(layout.bases)])


def switched(lines: DataFrame, marker: str, with_marker: Callable[[DataFrame], DataFrame], without: Callable[[DataFrame], DataFrame], doc: str = "doc_id") -> DataFrame:
    """The rows of documents in which some line matches the marker by one layout, and those of all others by another."""
    seen = F.max(blank(F.col("line")).rlike(marker)).over(Window.partitionBy(doc))
    told = lines.withColumn("_marked", seen)
    return with_marker(told.filter("_marked").drop("_marked")).unionByName(without(told.filter("not _marked").drop("_marked")), allowMissingColumns=True)


@dataclass(frozen=True)
class WordLayout:
    """Bands of x that are columns, (name, low, high), and the column and pattern that tell a row from other lines."""

    name: str
    bands: tuple[tuple[str, float, float], ...]
    row: tuple[str, str]


def word_rows(words: DataFrame, layout: WordLayout, page: list[str]) -> DataFrame:
    """(page, row, columns) of words (page, text, left, top, height, conf): the confident ones, by lines and bands."""
    column, pattern = layout.row
    placed = row_islands(confident(words).filter(banded(F.col("left"), layout.bands).isNotNull()), page)
    return bucketed_rows(placed, page, layout.bands).filter(F.col(column).rlike(pattern))


def ruled_lines(dark: Column) -> Column:
    """Where the ruled lines of a page lie: of its dark rows (or columns) of pixels, in order, adjacent ones are one line at
    their mean, and a line near the one before is moved to between both. A page's pixels bound the array."""
    none = F.expr("cast(array() as array<int>)")
    begin = F.struct(none.alias("done"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("last"))
    mean = lambda s: F.when(s["n"] > 0, F.array(F.floor(s["sum"] / s["n"]).cast("int"))).otherwise(none)

    def step(s: Column, x: Column) -> Column:
        same = (s["n"] > 0) & (x - s["last"] <= ADJACENT)
        return F.struct(
            F.when(same, s["done"]).otherwise(F.concat(s["done"], mean(s))).alias("done"),
            F.when(same, s["sum"] + x).otherwise(x.cast("long")).alias("sum"),
            F.when(same, s["n"] + 1).otherwise(F.lit(1)).alias("n"),
            x.alias("last"),
        )

    def near(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        doubled = (F.size(a) > 0) & (x - F.try_element_at(a, F.lit(-1)) <= DOUBLED)
        return F.when(doubled, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.floor((last + x) / 2).cast("int")))).otherwise(F.concat(a, F.array(x)))

    lines = F.aggregate(dark.cast("array<int>"), begin, step, lambda s: F.concat(s["done"], mean(s)))
    return F.aggregate(lines, none, near)


def dense_run(lines: Column) -> Column:
    """(first, last) of the longest run of lines without a wide gap, the first of several; null where it has few gaps."""
    zero = F.lit(0)
    begin = F.struct(*[zero.alias(c) for c in ("best", "best_n", "start", "n")])

    def step(s: Column, i: Column) -> Column:
        close = F.get(lines, i + 1) - F.get(lines, i) < WIDE
        start, n = F.when(s["n"] == 0, i).otherwise(s["start"]), F.when(close, s["n"] + 1).otherwise(zero)
        longer = n > s["best_n"]
        return F.struct(F.when(longer, start).otherwise(s["best"]).alias("best"), F.when(longer, n).otherwise(s["best_n"]).alias("best_n"), start.alias("start"), n.alias("n"))

    gaps = F.when(F.size(lines) > 1, F.sequence(zero, F.size(lines) - 2)).otherwise(F.expr("cast(array() as array<int>)"))
    found = F.aggregate(gaps, begin, step)
    return F.when(found["best_n"] >= LEAST_LINES, F.struct(F.get(lines, found["best"]).alias("first"), F.get(lines, found["best"] + found["best_n"]).alias("last")))
