"""A registry of document formats: documents are routed once, and only their own format reads their lines.

A format is a declaration: signatures, the forms its printed rows can have, and what surrounds them. All formats compile
to one dispatch over a document's variant, so a table of documents of any mixture of formats is read in one pass, in the
JVM. Formats whose rows hang on other lines (sections, wrapped text, rows of several lines) pass through windows of their
own documents; all others need no shuffle at all.

Rows by their defined results: a null text routes like an empty one, to Unknown; documents of Unknown have no records;
repeated rows give repeated records where no window is needed, and rows of one key are one document where one is; a line
of more than LONGEST_LINE characters is no printed row. Columns beyond the named ones are left behind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.identity import short_family
from quirelake.functions.text import LINE_END, blank, collapse, plain_dashes, unusable_reason, without_spaces

# Sheets in the order of priority; characters of a signature without blanks; pages that a head has.
SHEETS = ("LLP", "HT", "OCCM")
LEAST_WITHOUT_SPACES = 8
HEAD_PAGES = 3
UNKNOWN = "Unknown"
LONGEST_LINE = 4096
#: Between the cells of a row that an expression has found.
_CUT = "\x1f"


@dataclass(frozen=True)
class Part:
    """A piece of a row's expression, over the line with one blank before each of its tokens, and the columns of its groups."""

    pattern: str
    names: tuple[str, ...] = ()


_END = "(?= |$)"


def one(name: str, token: str = r"\S+") -> Part:
    """A token."""
    return Part(f" ({token}){_END}", (name,))


def opt(name: str, token: str = r"\S+") -> Part:
    """A token that may be missing."""
    return Part(f"(?: ({token}){_END})?", (name,))


def _token(but: str | None) -> str:
    return f"(?: (?!(?:{but}){_END})\\S+)" if but else r"(?: \S+)"


def many(name: str, least: int = 1, but: str | None = None, lazy: bool = False) -> Part:
    """At least so many tokens, none of which is one of but; lazy: as few as the rest allows, else as many."""
    return Part(f"({_token(but)}{{{least},}}{'?' if lazy else ''})", (name,))


def raw(pattern: str, *names: str) -> Part:
    return Part(pattern, names)


def rest(name: str | None = None) -> Part:
    """All that follows."""
    return Part("( .*)?" if name else "(?: .*)?", (name,) if name else ())


@dataclass(frozen=True)
class Form:
    """One shape of a row. constant: columns of a fixed value. under: a row that has the carried columns of the row above."""

    parts: tuple[Part, ...]
    constant: tuple[tuple[str, str], ...] = ()
    under: bool = False

    @property
    def pattern(self) -> str:
        return "^" + "".join(p.pattern for p in self.parts) + "$"

    def written(self, columns: tuple[str, ...]) -> str:
        """What an expression replaces a row by: its cells in the columns' order."""
        names = [n for p in self.parts for n in p.names]
        fixed = dict(self.constant)
        return _CUT.join(f"${names.index(c) + 1}" if c in names else fixed.get(c, "") for c in columns)


def form(*parts: Part, under: bool = False, **constant: str) -> Form:
    return Form(parts, tuple(constant.items()), under)


@dataclass(frozen=True)
class Format:
    """name and sheet; signatures that a head has; columns of the result; forms, the first that fits a line wins.

    aircraft: a pattern that the head's family must have, if it has one. least_page: pages of fewer characters are not
    read. dashes: all dashes are read as hyphens. skip: lines that are never rows. upper: columns put in capitals.
    empty: values that stand for none. section: (pattern whose first group is carried down, column); a section line is no
    row. continuation: (pattern of a line directly below a row that goes on with it, column, what stands between).
    carried: columns that rows of an under form have from the last other row; without one before them they are no rows, but
    where orphans is set they are, with these columns empty. offsets: columns that are a line's distance
    away, (column, distance, prefix to cut). before: a pattern of the line before a row. notes: (column, pattern whose
    first group is it) of lines below a row, the last counts, up to a line of ends. file_values: (column, (pattern of
    the file's name, value) in order).
    """

    name: str
    sheet: str
    signatures: tuple[str, ...]
    columns: tuple[str, ...] = ()
    forms: tuple[Form, ...] = ()
    aircraft: str | None = None
    least_page: int = 0
    dashes: bool = False
    skip: str | None = None
    upper: tuple[str, ...] = ()
    empty: tuple[tuple[str, str], ...] = ()
    section: tuple[str, str] | None = None
    continuation: tuple[str, str, str] | None = None
    carried: tuple[str, ...] = ()
    orphans: bool = False
    offsets: tuple[tuple[str, int, str], ...] = ()
    before: tuple[str, str, str] | None = None
    notes: tuple[tuple[str, str], ...] = ()
    starts: str | None = None
    ends: str | None = None
    file_values: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = ()

    @property
    def stateful(self) -> bool:
        return bool(self.section or self.continuation or self.carried or self.offsets or self.before or self.notes)

    def alias(self, name: str, sheet: str, *signatures: str) -> Format:
        """The same rows under another name: nothing of the layout is stated again."""
        return replace(self, name=name, sheet=sheet, signatures=signatures)


def _once(value: Column) -> Column:
    """A value that no optimiser writes out again where it is used: a generator's only row."""
    return F.explode_outer(F.array(value))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _squeezed(signature: str) -> str:
    return "".join(signature.upper().split())


#: Characters of a piece that several signatures share, and signatures of a mask: two bits of each.
_SHARED, _MASKED = 4, 31


class _Found:
    """Which signatures a head has, each looked for once: as masks of two bits a signature, squeezed and literal.

    Signatures are put together by a piece that they share, and looked for where that is there. One that stands literally in
    a head stands in it without blanks too, so the head itself is searched only for those found without blanks, and short ones.
    """

    def __init__(self, signatures: list[str]):
        left = list(dict.fromkeys((" ".join(s.upper().split()), _squeezed(s)) for s in signatures))
        self.groups: list[tuple[str, list[tuple[str, str]]]] = []
        while left:
            pieces = Counter(p for _, q in left if len(q) >= LEAST_WITHOUT_SPACES for p in {q[i : i + _SHARED] for i in range(len(q) - _SHARED + 1)})
            piece = min(pieces, key=lambda p: (-pieces[p], p), default="")
            own = [x for x in left if not piece or len(x[1]) >= LEAST_WITHOUT_SPACES and piece in x[1]]
            self.groups += [(piece, own[i : i + _MASKED]) for i in range(0, len(own), _MASKED)]
            left = [x for x in left if x not in own]
        self.at: dict[tuple[str, str], tuple[int, int]] = {}
        self.packed: list[list[tuple[str, list[tuple[str, str]]]]] = [[]]
        n = 0
        for piece, own in self.groups:
            if n + len(own) > _MASKED:
                self.packed.append([])
                n = 0
            self.at |= {x: (len(self.packed) - 1, n + i) for i, x in enumerate(own)}
            self.packed[-1].append((piece, own))
            n += len(own)

    def masks(self, head: Column, tight: Column) -> Column:
        bits = lambda x, b: F.lit(b << 2 * self.at[x][1]).cast("long")
        none = F.lit(0).cast("long")

        def one(x: tuple[str, str]) -> Column:
            here = F.contains(head, F.lit(x[0]))
            if len(x[1]) < LEAST_WITHOUT_SPACES:
                return F.when(here, bits(x, 2)).otherwise(none)
            return F.when(F.contains(tight, F.lit(x[1])), F.when(here, bits(x, 3)).otherwise(bits(x, 1))).otherwise(none)

        def group(piece: str, own: list[tuple[str, str]]) -> Column:
            both = reduce(lambda a, b: a.bitwiseOR(b), [one(x) for x in own])
            return F.when(F.contains(tight, F.lit(piece)), both).otherwise(none) if piece and len(own) > 1 else both

        return F.struct(*[reduce(lambda a, b: a.bitwiseOR(b), [group(*g) for g in mask] or [none]).alias(f"m{i}") for i, mask in enumerate(self.packed)])

    def _any_of(self, signatures: tuple[str, ...], bit: int) -> Column:
        wanted: dict[int, int] = {}
        for s in signatures:
            x = (" ".join(s.upper().split()), _squeezed(s))
            if bit == 2 or len(x[1]) >= LEAST_WITHOUT_SPACES:
                mask, i = self.at[x]
                wanted[mask] = wanted.get(mask, 0) | bit << 2 * i
        return _any([F.col(f"_m.m{i}").bitwiseAND(F.lit(w).cast("long")) != 0 for i, w in sorted(wanted.items())])

    def literal(self, signatures: tuple[str, ...]) -> Column:
        return self._any_of(signatures, 2)

    def squeezed(self, signatures: tuple[str, ...]) -> Column:
        return self._any_of(signatures, 1)


@dataclass(frozen=True)
class Registry:
    """formats in order of priority within their sheet; sheets: the signatures of each sheet itself."""

    formats: tuple[Format, ...]
    sheets: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def of(self, sheet: str) -> list[Format]:
        return [f for f in self.formats if f.sheet == sheet]

    def route(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with sheet_type, variant (both Unknown where nothing fits) and diagnosis (why nothing does, else null).

        The sheet: its own signatures literally, in the sheets' order, then without blanks; then those of any of its
        formats, literally and without blanks. The format, within the sheet: the first with a signature and of the
        head's aircraft, literally, then without blanks.
        """
        h, found = F.col("_h"), _Found([s for own in (*self.sheets.values(), *(f.signatures for f in self.formats)) for s in own])
        # a text without other characters than ASCII has no other white space
        tight = F.when(F.octet_length(h) == F.char_length(h), F.replace(h, F.lit(" "), F.lit(""))).otherwise(F.upper(without_spaces(h)))
        heads = docs.withColumn("_h", F.upper(collapse(blank(F.col(text))))).withColumn("_q", tight)
        heads = heads.select("*", _once(found.masks(h, F.col("_q"))).alias("_m"))
        literal, squeezed = found.literal, found.squeezed

        # an aircraft is looked for only where a format that wants one has a signature
        wanting = tuple(s for f in self.formats if f.aircraft for s in f.signatures)
        heads = heads.withColumn("_f", F.when(literal(wanting) | squeezed(wanting), short_family(blank(F.col(text)))).otherwise("") if wanting else F.lit(""))

        def fits(f: Format) -> Column:
            return F.lit(True) if f.aircraft is None else (F.col("_f") == "") | F.col("_f").rlike(f.aircraft)

        order = [s for s in SHEETS if self.of(s) or self.sheets.get(s)]
        tiers = [F.when(found(self.sheets.get(s, ())), s) for found in (literal, squeezed) for s in order]
        tiers += [F.when(_any([found(f.signatures) for f in self.of(s)]), s) for found in (literal, squeezed) for s in order]
        routed = heads.withColumn("sheet_type", F.coalesce(*tiers, F.lit(UNKNOWN)))
        within = [F.when(F.col("sheet_type") == s, F.coalesce(*[F.when(found(f.signatures) & fits(f), f.name) for found in (literal, squeezed) for f in self.of(s)])) for s in order if self.of(s)]
        routed = routed.withColumn("variant", F.coalesce(*within, F.lit(UNKNOWN)))
        why = F.when(F.col("sheet_type") == UNKNOWN, F.coalesce(unusable_reason(F.col(text)), F.lit("no_signature_match")))
        told = F.struct("sheet_type", "variant", why.alias("diagnosis"))
        return routed.select(*[f"`{c}`" for c in docs.columns if c not in ("sheet_type", "variant", "diagnosis")], _once(told).alias("_r")).select("*", "_r.*").drop("_r")

    def _each(self, of: Callable[[Format], Column | None]) -> Column:
        """The column of the row's own format; null where it has none."""
        found = sorted({f.name: c for f in reversed(self.formats) if (c := of(f)) is not None}.items(), key=lambda x: x[0].encode())

        def halved(some: list[tuple[str, Column]]) -> Column:
            if len(some) == 1:
                return F.when(F.col("variant") == some[0][0], some[0][1])
            half = len(some) // 2
            return F.when(F.col("variant") < some[half][0], halved(some[:half])).otherwise(halved(some[half:]))

        return halved(found) if found else F.lit(None)

    def _cells(self, line: Column) -> Column:
        """Of a line, one blank before each token: struct(under, cells) in the columns' order of its format, or null."""

        def found(f: Format) -> Column | None:
            shapes = [F.when(line.rlike(x.pattern), F.struct(F.lit(x.under).alias("under"), F.transform(F.split(F.regexp_replace(line, x.pattern, x.written(f.columns)), _CUT, -1), lambda c: F.trim(c)).alias("cells"))) for x in f.forms]
            if not shapes:
                return None
            rows = F.coalesce(*shapes)
            return F.when(~line.rlike(f.skip), rows) if f.skip else rows

        return self._each(found)

    def lines(self, routed: DataFrame, doc: str, text: str = "text", page: str | None = None, file: str | None = None) -> DataFrame:
        """(doc, page, line_no, variant, file, line) of routed documents: lines with text, one blank before each token."""
        known = [f.name for f in self.formats]
        short = self._each(lambda f: F.length(text) < f.least_page if f.least_page else None)
        plain = self._each(lambda f: plain_dashes(blank(F.col(text))) if f.dashes else None)
        read = routed.filter(F.col("variant").isin(known) & ~F.coalesce(short, F.lit(False)))
        split = F.posexplode(F.split(F.coalesce(plain, blank(F.col(text))), LINE_END)).alias("line_no", "_line")
        own = read.select(F.col(doc).alias("doc"), (F.col(page) if page else F.lit(1)).alias("page"), "variant", (F.col(file) if file else F.lit("")).alias("file"), split)
        told = own.withColumn("line", F.concat(F.lit(" "), collapse(F.col("_line")))).drop("_line")
        return told.withColumn("line_no", (F.col("line_no") + 1).cast("int"))

    def records(self, routed: DataFrame, doc: str, text: str = "text", page: str | None = None, file: str | None = None) -> DataFrame:
        """(doc, page, line_no, variant, record) of routed documents: record is a map of the format's columns, each a text."""
        stateful = [f.name for f in self.formats if f.stateful]
        plain = self._plain(self.lines(routed.filter(~F.col("variant").isin(stateful)) if stateful else routed, doc, text, page, file))
        if stateful:
            plain = plain.unionByName(self._with_state(self.lines(routed.filter(F.col("variant").isin(stateful)), doc, text, page, file)))
        cells = self._finished(F.col("_cells"))
        names = self._each(lambda f: F.array(*[F.lit(c) for c in f.columns]))
        return plain.select("doc", "page", "line_no", "variant", F.map_from_arrays(names, cells).alias("record"))

    def _plain(self, lines: DataFrame) -> DataFrame:
        rows = lines.filter((F.length("line") > 1) & (F.length("line") <= LONGEST_LINE)).withColumn("_row", _once(self._cells(F.col("line"))))
        return rows.filter("_row is not null and not _row.under").select("doc", "page", "line_no", "variant", "file", F.col("_row.cells").alias("_cells"))

    def _finished(self, cells: Column) -> Column:
        """Capitals, values that stand for none, and what the file's name tells."""

        def of(f: Format) -> Column | None:
            own = []
            for i, c in enumerate(f.columns):
                cell = F.get(cells, F.lit(i))
                cell = F.upper(cell) if c in f.upper else cell
                for name, none in f.empty:
                    cell = F.when(cell == none, "").otherwise(cell) if name == c else cell
                told = dict(f.file_values).get(c)
                own.append(F.coalesce(*[F.when(F.lower("file").rlike(p), v) for p, v in told], F.lit("")) if told else cell)
            return F.array(*own) if f.upper or f.empty or f.file_values else F.slice(cells, 1, len(f.columns))

        return self._each(of)

    def _put(self, cells: Column, values: Callable[[Format], dict[str, Column]]) -> Column:
        """cells with some columns of their formats replaced, where the new value is not null."""

        def of(f: Format) -> Column | None:
            new = values(f)
            return F.array(*[F.coalesce(new[c], F.get(cells, F.lit(i))) if c in new else F.get(cells, F.lit(i)) for i, c in enumerate(f.columns)]) if new else None

        return F.coalesce(self._each(of), cells)

    def _with_state(self, lines: DataFrame) -> DataFrame:
        """Rows of formats that hang on other lines, by windows over a document's lines in order."""
        line, no = F.col("line"), F.col("line_no")
        rows = lines.withColumn("_row", _once(F.when((F.length("line") > 1) & (F.length("line") <= LONGEST_LINE), self._cells(line))))
        of_doc = Window.partitionBy("doc", "variant").orderBy("page", "line_no")
        of_page = Window.partitionBy("doc", "variant", "page").orderBy("line_no")
        upto = Window.unboundedPreceding, Window.currentRow
        # sections
        head = F.nullif(self._each(lambda f: F.regexp_extract(F.ltrim(line), f.section[0], 1) if f.section else None), F.lit(""))
        rows = rows.withColumn("_head", head).withColumn("_section", F.last("_head", ignorenulls=True).over(of_doc.rowsBetween(*upto)))
        rows = rows.withColumn("_row", F.when(F.col("_head").isNull(), F.col("_row")))
        # what rows of an under form have from the last row that is none
        main = F.when(F.col("_row").isNotNull() & ~F.col("_row.under"), F.col("_row.cells"))
        rows = rows.withColumn("_above", F.last(main, ignorenulls=True).over(of_doc.rowsBetween(*upto)))
        alone = F.col("variant").isin([f.name for f in self.formats if f.orphans])
        rows = rows.withColumn("_row", F.when(~F.coalesce(F.col("_row.under"), F.lit(False)) | F.col("_above").isNotNull() | alone, F.col("_row")))
        # lines at a distance, of those with text
        distances = sorted({d for f in self.formats for _, d, _ in f.offsets} | {-1 for f in self.formats if f.before})
        spaced = [f.name for f in self.formats if f.offsets or f.before]
        texts = rows.filter((F.length("line") > 1) | ~F.col("variant").isin(spaced)) if spaced else rows
        for d in distances:
            texts = texts.withColumn(f"_at{d}", F.coalesce(F.ltrim(F.lead("line", d).over(of_page) if d > 0 else F.lag("line", -d).over(of_page)), F.lit("")))
        # the lines directly below a row that go on with it, and the notes up to the next start
        goes_on = F.coalesce(self._each(lambda f: F.ltrim(line).rlike(f.continuation[0]) if f.continuation else None), F.lit(False)) & F.col("_row").isNull()
        starts = self._each(lambda f: F.ltrim(line).rlike(f.starts) if f.starts else None)
        told = texts.withColumn("_run", F.sum((~F.when(starts.isNull(), goes_on).otherwise(~starts)).cast("long")).over(of_page.rowsBetween(*upto)))
        ended = self._each(lambda f: F.lower(F.ltrim(line)).rlike(f.ends) if f.ends else None)
        told = told.withColumn("_ended", F.coalesce(F.max(F.coalesce(ended, F.lit(False))).over(Window.partitionBy("doc", "variant", "page", "_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
        n_notes = max((len(f.notes) for f in self.formats), default=0)
        note = lambda i: self._each(lambda f: F.when(F.ltrim(line).rlike(f.notes[i][1]), F.regexp_extract(F.ltrim(line), f.notes[i][1], 1)) if len(f.notes) > i else None)
        gathered = told.groupBy("doc", "variant", "page", "_run").agg(
            F.min_by(F.struct("line_no", "file", "_row", "_section", "_above", *[f"_at{d}" for d in distances]), "line_no").alias("r"),
            F.array_sort(F.collect_list(F.when(goes_on, F.struct(no, F.ltrim(line).alias("t"))))).alias("_tail"),
            *[F.max_by(note(i), F.when(note(i).isNotNull() & ~F.col("_ended"), no)).alias(f"_note{i}") for i in range(n_notes)],
        )
        got = gathered.filter("r._row is not null").select("doc", "page", "variant", "r.*", "_tail", *[f"_note{i}" for i in range(n_notes)])

        def values(f: Format) -> dict[str, Column]:
            new: dict[str, Column] = {}
            if f.section:
                new[f.section[1]] = F.coalesce("_section", F.lit(""))
            for c in f.carried:
                new[c] = F.when(F.col("_row.under"), F.coalesce(F.get("_above", F.lit(f.columns.index(c))), F.lit("")))
            for c, d, prefix in f.offsets:
                new[c] = F.regexp_replace(F.col(f"_at{d}"), f"^{prefix}", "") if prefix else F.col(f"_at{d}")
            if f.before:
                pattern, first, other = f.before
                new[first], new[other] = F.regexp_extract("_at-1", r"^(\S+)", 1), F.regexp_extract("_at-1", r"^\S+ (.*)$", 1)
            if f.continuation:
                _, c, between = f.continuation
                own = F.get("_row.cells", F.lit(f.columns.index(c)))
                new[c] = F.when(F.size("_tail") > 0, F.concat(own, F.lit(between), F.array_join(F.transform("_tail", lambda x: x["t"]), between)))
            for i, (c, _) in enumerate(f.notes):
                new[c] = F.trim(f"_note{i}")
            return new

        if any(f.before for f in self.formats):
            wanted = self._each(lambda f: F.col("_at-1").rlike(f.before[0]) if f.before else None)
            got = got.filter(F.coalesce(wanted, F.lit(True)))
        return got.select("doc", "page", "line_no", "variant", "file", self._put(F.col("_row.cells"), values).alias("_cells"))


def heads(pages: DataFrame, doc: str, page: str = "page", text: str = "text") -> DataFrame:
    """(doc, head): the first pages' texts, what a document is routed by."""
    first = pages.filter(F.col(page) <= HEAD_PAGES).groupBy(doc)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, F.col(text).alias("t")))), lambda p: p["t"]), "\n").alias("head"))
