"""Tables from word boxes: columns found from a header's tokens, and cells between ruled lines.

A page's words, lines and rules meet in one task, as arrays of its row; pages do not. Words are (doc, page, text, left,
top, width, height), boxes in pixels.

Rows by their defined results: words without a place or a text are left out; a page without a header takes its document's
columns from the other pages, and a document without any has only its left columns; a page without rules has no cells;
repeated words stand side by side. Columns beyond the named ones are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import blank
from quirelake.operators.forms import ruled_lines
from quirelake.operators.layout import row_islands

WORDS = ("text", "left", "top", "width", "height")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _told(df: DataFrame, **values: Column) -> DataFrame:
    """df with values that no optimiser writes out again where they are used: a generator's only row."""
    one = F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("_told")
    return df.select("*", one).select("*", "_told.*").drop("_told")


def page_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """(page, row, words): each line's words from left to right, an array of (left, center, text)."""
    placed = words.select(*page, *WORDS).dropna(subset=[*WORDS]).filter(F.trim("text") != "")
    rows = row_islands(placed, page)
    of = F.struct(F.col("left").cast("double").alias("left"), (F.col("left") + F.col("width") / 2).cast("double").alias("center"), F.trim("text").alias("text"))
    return rows.groupBy(*page, "row").agg(F.array_sort(F.collect_list(of)).alias("words"))


@dataclass(frozen=True)
class AnchorLayout:
    """right: columns and the header tokens that stand over them, in order; a header may lack some. left: columns by position.

    optional: of the left columns, those whose word must match a pattern, else they are empty and the word is the next
    column's. The last left column takes all words up to the right columns, which begin `slack` before the first of them.
    row: patterns of a data row's first words. within: a word further from its column than this share of the gap to the
    next is loose and goes to no column; none: the nearest column takes it.
    """

    left: tuple[str, ...]
    right: tuple[tuple[str, str], ...]
    row: tuple[str, ...]
    optional: tuple[tuple[str, str], ...] = ()
    slack: float = 50.0
    within: float | None = None


def aligned(words: Column, tokens: tuple[str, ...]) -> Column:
    """Places of a line's words that are the tokens, in their order; null for a token that the line lacks.

    The most tokens that can stand in order; of several ways the one whose words come first. For each token the ways to
    end with it are kept by their number of tokens, so a word that comes twice, or out of order, costs no other its place.
    """
    place = "struct<n:int,back:array<double>>"
    none = F.expr("cast(null as double)")
    start = F.struct(F.lit(0).alias("n"), F.array(*[none] * len(tokens)).alias("back")).cast(place)

    def step(ways: Column, word: Column) -> Column:
        """ways: for each k, the best alignment whose last token is the k-th or one before it, up to this word."""
        name = F.upper(F.regexp_replace(word["text"], ":+$", ""))
        out = []
        for k, t in enumerate(tokens):
            before = F.get(ways, F.lit(k - 1)) if k else start
            mine = F.struct((before["n"] + 1).alias("n"), F.array(*[word["left"] if i == k else F.get(before["back"], F.lit(i)) for i in range(len(tokens))]).alias("back")).cast(place)
            held = F.get(ways, F.lit(k))
            here = F.when((name == t.upper()) & (mine["n"] > held["n"]), mine).otherwise(held)
            out.append(here if not k else F.when(out[-1]["n"] > here["n"], out[-1]).otherwise(here))
        return F.array(*out)

    return F.element_at(F.aggregate(words, F.array(*[start] * len(tokens)), step), -1)["back"]


def with_anchors(lines: DataFrame, layout: AnchorLayout, doc: str, page: list[str]) -> DataFrame:
    """lines with anchors: for each right column its place, the median over its document's pages of where the page's header
    has it, or null; null where the document has no header.

    A page's header is the line with most of the tokens in order, two at least, the first of several. doc is one of page.
    Lines are told once, by windows: they are not joined with what is found in them.
    """
    tokens = tuple(t for _, t in layout.right)
    least = min(2, len(tokens))
    # only words that are tokens can be aligned, and few lines have enough of them
    named = F.filter("words", lambda w: F.upper(F.rtrim(w["text"], F.lit(":"))).isin([t.upper() for t in tokens]))
    told = _told(lines, _at=F.when(F.size(named) >= least, _let(named, lambda words: aligned(words, tokens))))
    n = F.size(F.filter("_at", lambda x: x.isNotNull()))
    rank = F.when(n >= least, F.struct(n.alias("n"), (-F.col("row")).alias("r")))
    told = told.withColumn("_rank", rank).withColumn("_best", F.max("_rank").over(Window.partitionBy(*page)))
    own = Window.partitionBy(doc)
    header = lambda i: F.when(F.col("_rank") == F.col("_best"), F.get("_at", F.lit(i)))
    medians = [F.floor(F.percentile(header(i), 0.5).over(own)).cast("double") for i in range(len(tokens))]
    some = F.max(F.col("_best").isNotNull()).over(own)
    return told.withColumn("anchors", F.when(some, F.array(*medians))).drop("_at", "_rank", "_best")


def anchored_rows(words: DataFrame, layout: AnchorLayout, doc: str, page: list[str]) -> DataFrame:
    """(page, row, left and right columns, loose) of the data rows of words; every value is text."""
    lines = page_lines(words, page)
    held = with_anchors(lines, layout, doc, page)
    for i, form in enumerate(layout.row):
        held = held.filter(F.coalesce(F.get("words", F.lit(i))["text"].rlike(form), F.lit(False)))
    names = [c for c, _ in layout.right]
    # the columns that the document has, from left to right: (place, number, half of the gaps to its neighbours)
    some = F.filter(F.transform(F.col("anchors"), lambda x, i: F.struct(x.alias("at"), i.alias("no"))), lambda a: a["at"].isNotNull())
    held = held.withColumn("_a", F.coalesce(F.array_sort(some), F.expr("cast(array() as array<struct<at:double,no:int>>)")))
    first = F.coalesce(F.get("_a", F.lit(0))["at"] - layout.slack, F.lit(float("inf")))
    held = held.withColumn("_left", F.transform(F.filter("words", lambda w: w["left"] < first), lambda w: w["text"]))

    def nearest(w: Column) -> Column:
        return F.array_min(F.transform("_a", lambda a: F.struct(F.abs(a["at"] - w["center"]).alias("d"), a["no"].alias("no"), a["at"].alias("at"))))

    def told(w: Column) -> Column:
        if layout.within is None:
            return _let(nearest(w), lambda b: F.struct(b["no"].alias("no"), w["text"].alias("text")))
        gaps = lambda b: F.array_min(F.transform(F.filter("_a", lambda a: a["no"] != b["no"]), lambda a: F.abs(a["at"] - b["at"])))
        return _let(nearest(w), lambda b: F.struct(F.when(gaps(b).isNull() | (b["d"] <= layout.within * gaps(b)), b["no"]).alias("no"), w["text"].alias("text")))

    held = held.withColumn("_right", F.transform(F.filter("words", lambda w: w["left"] >= first), told))
    text = lambda words: F.array_join(F.transform(words, lambda w: w["text"]), " ")

    def numbered(i: int):
        return lambda w: w["no"] == i

    out = held.select(*page, "row", "_left", "_right", F.lit(1).alias("_at"))
    rules = dict(layout.optional)
    for c in layout.left[:-1]:
        word = F.get("_left", F.col("_at") - 1)
        taken = F.coalesce(word.rlike(rules[c]), F.lit(False)) if c in rules else word.isNotNull()
        out = out.withColumn(c, F.when(taken, word).otherwise("")).withColumn("_at", F.col("_at") + taken.cast("int"))
    out = out.withColumn(layout.left[-1], F.array_join(F.slice("_left", F.col("_at"), F.size("_left")), " "))
    return out.select(*page, "row", *layout.left, *[text(F.filter("_right", numbered(i))).alias(c) for i, c in enumerate(names)], text(F.filter("_right", lambda w: w["no"].isNull())).alias("loose"))


#: Pixels by which a rule may miss its line, and the share of a side that it must cover.
OFF, COVERED = 8.0, 0.5


def page_grids(rules: DataFrame, page: list[str]) -> DataFrame:
    """(page, xs, ys, v, h) of rules (page, kind, at, start, stop): lines' places in order, and the pieces they are drawn in.

    kind is v for an upright rule, at an x from one y to another, and h for a level one. Pieces near each other are of
    one line, as in `ruled_lines`.
    """
    piece = F.struct(F.col("at").cast("double").alias("at"), F.least("start", "stop").cast("double").alias("low"), F.greatest("start", "stop").cast("double").alias("high"))
    grouped = rules.dropna(subset=["at", "start", "stop"]).groupBy(*page).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, piece))).alias(k) for k in ("v", "h")])
    lines = lambda c: ruled_lines(F.array_sort(F.array_distinct(F.transform(c, lambda p: F.round(p["at"]).cast("int")))))
    return grouped.select(*page, lines("v").alias("xs"), lines("h").alias("ys"), "v", "h")


def _drawn(pieces: Column, low: Column, high: Column) -> Column:
    """Whether rules near a line cover enough of one side of a cell."""
    over = F.transform(pieces, lambda p: F.greatest(F.lit(0.0), F.least(p["high"], high) - F.greatest(p["low"], low)))
    return F.aggregate(over, F.lit(0.0), lambda a, b: a + b) >= COVERED * (high - low)


def _borders(pieces: Column, lines: Column, across: Column) -> Column:
    """Of each line, and each interval of the lines across it, whether it is drawn there."""
    spans = F.arrays_zip(F.slice(across, 1, F.greatest(F.size(across) - 1, F.lit(0))).alias("low"), F.slice(across, 2, F.greatest(F.size(across) - 1, F.lit(0))).alias("high"))
    near = lambda at: F.filter(pieces, lambda p: F.abs(p["at"] - at) <= OFF)
    sides = lambda own: F.transform(spans, lambda s: _drawn(own, s["low"].cast("double"), s["high"].cast("double")))
    return F.transform(lines, lambda at: _let(near(at.cast("double")), sides))


def grid_cells(words: DataFrame, rules: DataFrame, page: list[str]) -> DataFrame:
    """(page, row, col, row_span, col_span, text) of each cell with words: where its first row and column are, from 0.

    A word belongs to the interval of lines that its middle lies in, both ways. Between two intervals without a rule the
    cell goes on: it is the cell of the last one before it, up to which there is none, first to the left, then upward.
    Words outside of the lines belong to no cell. Texts go by the words' lines, then from left to right.
    """
    # a page's borders are told once, not once a word
    grids = _told(page_grids(rules, page), upright=_borders(F.col("v"), F.col("xs"), F.col("ys")), level=_borders(F.col("h"), F.col("ys"), F.col("xs"))).drop("v", "h")
    held = words.select(*page, *WORDS).dropna(subset=[*WORDS]).filter(F.trim("text") != "").join(grids, page)
    x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    at = lambda lines, p: F.size(F.filter(lines, lambda q: q <= p)) - 1
    held = _told(held, _c=at("xs", x), _r=at("ys", y))
    held = held.filter((F.col("_c") >= 0) & (F.col("_c") < F.size("xs") - 1) & (F.col("_r") >= 0) & (F.col("_r") < F.size("ys") - 1))
    upright = lambda c, r: F.get(F.get("upright", c), r)
    level = lambda r, c: F.get(F.get("level", r), c)
    lead = lambda upto, border: F.array_max(F.filter(F.sequence(F.lit(0), upto), lambda i: (i == 0) | border(i)))
    held = _told(held, col=lead(F.col("_c"), lambda i: upright(i, F.col("_r"))))
    held = _told(held, row=lead(F.col("_r"), lambda i: level(i, F.col("col"))))
    n_rows, n_cols = F.size("ys") - 1, F.size("xs") - 1
    ends = lambda first, n, border: F.array_min(F.filter(F.sequence(first + 1, n), lambda i: (i == n) | border(i))) - first
    held = held.withColumn("col_span", ends(F.col("col"), n_cols, lambda i: upright(i, F.col("row"))))
    held = held.withColumn("row_span", ends(F.col("row"), n_rows, lambda i: level(i, F.col("col"))))
    # the lines of words within a cell: a new one where a word begins below the middle of the line's first
    one = F.struct(F.col("top").cast("double").alias("top"), F.col("left").cast("double").alias("left"), F.col("height").cast("double").alias("height"), F.trim("text").alias("text"))
    cells = held.groupBy(*page, "row", "col").agg(F.max("row_span").alias("row_span"), F.max("col_span").alias("col_span"), F.array_sort(F.collect_list(one)).alias("w"))
    numbered = "array<struct<no:int,left:double,text:string>>"
    begin = F.struct(F.lit(0).alias("no"), F.expr("cast(null as double)").alias("below"), F.expr(f"cast(array() as {numbered})").alias("out"))

    def step(s: Column, w: Column) -> Column:
        new = s["below"].isNotNull() & (w["top"] >= s["below"])
        no = s["no"] + new.cast("int")
        return F.struct(no.alias("no"), F.when(s["below"].isNull() | new, w["top"] + w["height"] / 2).otherwise(s["below"]).alias("below"), F.array_append(s["out"], F.struct(no.alias("no"), w["left"].alias("left"), w["text"].alias("text"))).alias("out"))

    text = F.array_join(F.transform(F.array_sort(F.aggregate("w", begin, step, lambda s: s["out"])), lambda p: p["text"]), " ")
    return cells.select(*page, "row", "col", "row_span", "col_span", text.alias("text"))


def grid_records(cells: DataFrame, columns: tuple[str, ...], page: list[str], first_row: int = 1) -> DataFrame:
    """(page, row, columns): the rows of cells from first_row on, a column of each; a cell over several rows counts in its first."""
    rows = cells.filter(F.col("row") >= first_row).groupBy(*page, "row")
    return rows.agg(*[blank(F.max(F.when(F.col("col") == i, F.col("text")))).alias(c) for i, c in enumerate(columns)])
