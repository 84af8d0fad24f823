"""Formats as functions of SQL: rows of a format from a table of lines, and whether a text is of a format.

    SELECT * FROM read_format(TABLE(SELECT doc_id, line_no, line FROM lines) PARTITION BY doc_id ORDER BY (line_no), 'AMOS')
    SELECT * FROM read_format(TABLE(SELECT doc_id, CAST(1 AS BIGINT) AS line_no, text AS line FROM documents WHERE is_format(text, 'AMOS')) PARTITION BY doc_id ORDER BY (line_no), 'AMOS')

read_format is polymorphic: its columns are those of the format it is told, known when the query is analysed. It is for ad
hoc use from SQL; over whole tables of mixed formats `Registry.records` reads in the JVM.
"""

from __future__ import annotations

from functools import cache, lru_cache

import regex
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quirelake.operators.catalogue import CATALOGUE
from quirelake.operators.registry import LEAST_WITHOUT_SPACES, LONGEST_LINE, Format, Registry


def _format(name: str) -> Format:
    found = next((f for f in CATALOGUE.formats if f.name == name), None)
    if found is None:
        raise ValueError(f"no format is named {name}")
    unread = [what for what, has in (("lines at a distance", found.offsets or found.before), ("notes below its rows", found.notes)) if has]
    if unread:
        raise ValueError(f"{name} hangs on {unread[0]}: read it by Registry.records")
    return found


#: Lines whose reading a worker keeps for each format: heads, feet and rules come back on every page.
_KEPT = 1024


class _Reader:
    """A format's expressions, and what a line says by itself; one for each format and worker."""

    def __init__(self, name: str):
        own = self.own = _format(name)
        self.forms = [(regex.compile(f.pattern), [n for p in f.parts for n in p.names], dict(f.constant), f.under) for f in own.forms]
        self.skip = regex.compile(own.skip) if own.skip else None
        self.head = regex.compile(own.section[0]) if own.section else None
        self.more = regex.compile(own.continuation[0]) if own.continuation else None
        self.none, self.upper = dict(own.empty), [i for i, c in enumerate(own.columns) if c in own.upper]
        self.kept = lru_cache(_KEPT)(self._told)

    def told(self, line: str) -> tuple[str | None, tuple[dict, bool] | None, bool]:
        """Of a line, one blank before each token: its section, its row with whether it is under another, whether it can go on with one."""
        return self.kept(line) if len(line) <= LONGEST_LINE else self._told(line)

    def _told(self, line: str) -> tuple[str | None, tuple[dict, bool] | None, bool]:
        text = line.lstrip(" ")
        if self.head and (found := self.head.search(text)):
            return found[1], None, False
        row = self._row(line)
        return None, row, bool(row is None and self.more and self.more.search(text))

    def _row(self, line: str) -> tuple[dict, bool] | None:
        if len(line) < 2 or len(line) > LONGEST_LINE or self.skip and self.skip.search(line):
            return None
        for pattern, names, constant, under in self.forms:
            found = pattern.match(line)
            if found:
                return constant | {n: (v or "").strip(" ") for n, v in zip(names, found.groups(), strict=True)}, under
        return None

    def shown(self, cells: dict) -> list[str]:
        out = [cells.get(c, "") for c in self.own.columns]
        if self.none:
            out = ["" if self.none.get(c) == v else v for c, v in zip(self.own.columns, out, strict=True)]
        for i in self.upper:
            out[i] = out[i].upper()
        return out


_reader = cache(_Reader)


class ReadFormat:
    """read_format(TABLE(doc_id, line_no, line), format): (doc_id, line_no, the format's columns) of the lines that are rows.

    Lines are to be partitioned by document and ordered. A row may hold several lines, parted by line feeds and numbered from
    its line_no on, as far as a whole document. Sections, carried columns and lines that go on with a row are kept from
    line to line; memory is one row's. Null lines are empty ones.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or [f.name.lower() for f in rows.dataType.fields][:3] != ["doc_id", "line_no", "line"]:
            raise ValueError("read_format takes a table of doc_id, line_no and line")
        if not name.isConstantExpression or name.value is None:
            raise ValueError("read_format takes the name of a format as a constant")
        own = _format(name.value)
        doc = rows.dataType.fields[0].dataType
        return AnalyzeResult(schema=T.StructType([T.StructField("doc_id", doc), T.StructField("line_no", T.LongType()), *[T.StructField(c, T.StringType()) for c in own.columns]]))

    def __init__(self):
        self.held: list | None = None
        self.section, self.above = "", None

    def eval(self, rows, name: str):
        self.reader = _reader(name)
        doc, no = rows["doc_id"], rows["line_no"]
        for i, line in enumerate((rows["line"] or "").split("\n")):
            yield from self._line(doc, no + i if i else no, " " + " ".join(line.split()))

    def _line(self, doc, no: int, line: str) -> list[tuple]:
        """The row that ends with a line, if one does."""
        own = self.reader.own
        section, found, goes_on = self.reader.told(line)
        if goes_on and self.held:
            self.held[2][own.continuation[1]] += own.continuation[2] + line.lstrip(" ")
            return []
        ended = self._flush()
        if section is not None:
            self.section = section
        if found is None:
            return ended
        cells, under = found
        if under:
            if self.above is None and not own.orphans:
                return ended
            cells = cells | {c: (self.above or {}).get(c, "") for c in own.carried}
        else:
            self.above = cells
        self.held = [doc, no, cells | ({own.section[1]: self.section} if own.section else {})]
        return ended

    def terminate(self):
        return self._flush()

    def _flush(self) -> list[tuple]:
        if not self.held:
            return []
        doc, no, cells = self.held
        self.held = None
        return [(doc, no, *self.reader.shown(cells))]


def _predicate(registry: Registry) -> str:
    """SQL of is_format's body: signatures literally in the collapsed text, or without blanks. Plain built-in functions.

    A text is collapsed and squeezed at most once for all signatures. One that stands literally in a text stands in it
    without blanks too, so only the short ones are looked for in the text itself; a single word stands there however blanks
    are collapsed.
    """
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    head, tight = r"upper(trim(regexp_replace(t, '[ \\t\\r\\n\\f\\x0B]+', ' ')))", r"upper(regexp_replace(t, '\\s+', ''))"
    cases = []
    for f in registry.formats:
        words = [s.upper().split() for s in f.signatures]
        short = [w for w in words if len("".join(w)) < LEAST_WITHOUT_SPACES]
        own = [f"contains(upper(t), {quoted(w[0])})" for w in short if len(w) == 1]
        for once, some in ((head, [" ".join(w) for w in short if len(w) > 1]), (tight, ["".join(w) for w in words if w not in short])):
            own += [f"exists(array({once}), x -> {' OR '.join(f'contains(x, {quoted(s)})' for s in some)})"] if some else []
        cases.append(f"WHEN {quoted(f.name)} THEN {' OR '.join(own)}")
    return f"coalesce(CASE name {' '.join(cases)} END, false)"


def register(spark: SparkSession) -> None:
    """read_format and is_format for this session's SQL. is_format is an SQL function: it runs in the JVM."""
    spark.udtf.register("read_format", udtf(ReadFormat))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_format(t STRING, name STRING) RETURNS BOOLEAN RETURN {_predicate(CATALOGUE)}")
