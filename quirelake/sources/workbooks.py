"""Workbooks as a data source: read by sheet and range of rows, written as they stream, a workbook a key.

    register(spark)
    spark.read.format("workbook").load("file:///in/*.xlsx")          # all sheets, columns of the first row, as text
    write_workbooks(df, "file:///out", "aircraft_key", "sheet")      # out/<key>.xlsx, a sheet for each value of sheet

Reading parses a sheet's XML as it comes out of its archive and drops each row when it has been given; a task holds one row
and the workbook's table of shared strings, if it has one. Writing holds one row; a sheet that is full goes on in another.
Tasks write under names of their own; the driver puts them in place when all have ended, and takes them away if one failed.

By their defined results: every value is a text, a missing or empty cell null; a row shorter than the header has nulls, what
stands beyond it is left out; blank header cells are named by their letters, names that come twice get their letters too.
Characters that XML has no place for, and carriage returns, are written as _xHHHH_ and read back. An empty table writes no
workbooks. Folders are any that pyarrow's file systems open.
"""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The formats' names and a sheet's most rows.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576
ROWS_PER_PARTITION = 100_000
_ODD = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODE = re.compile("_x([0-9A-Fa-f]{4})_")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system and place there; the last part of the path is taken as it stands, whatever URIs make of it."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    head, _, last = path.rstrip("/").rpartition("/")
    if head.endswith("/"):
        return pafs.FileSystem.from_uri(path)
    files, at = pafs.FileSystem.from_uri(head)
    return files, f"{at.rstrip('/')}/{last}"


def _uri(path: str) -> str:
    """file:/x as file:///x, which pyarrow asks for."""
    return re.sub("^file:/(?!/)", "file:///", path)


def _files(path: str) -> list[str]:
    """Workbooks of a path: a file, a folder's, or those that a pattern in the last part fits."""
    path = _uri(path)
    head, _, last = path.rpartition("/")
    if "*" in last or "?" in last:
        files, at = _opened(head)
        found = files.get_file_info(pafs.FileSelector(at))
        return sorted(f"{head}/{i.base_name}" for i in found if i.is_file and fnmatch(i.base_name, last))
    files, at = _opened(path)
    if files.get_file_info(at).type == pafs.FileType.Directory:
        return sorted(f"{path.rstrip('/')}/{i.base_name}" for i in files.get_file_info(pafs.FileSelector(at)) if i.is_file and i.base_name.endswith(".xlsx"))
    return [path]


def column_letters(n: int) -> str:
    """A, B, ..., Z, AA, ... of 0, 1, ..."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def _decoded(text: str) -> str:
    return _CODE.sub(lambda m: chr(int(m[1], 16)), text)


def _encoded(text: str) -> str:
    return escape(_ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets, in order."""
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ET.fromstring(book.read("xl/workbook.xml"))
    found = [(s.get("name"), links[s.get(f"{{{LINKS}}}id")]) for s in root.iter(f"{{{MAIN}}}sheet")]
    return [(name, at.lstrip("/") if at.startswith("/") else f"xl/{at}") for name, at in found]


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, e in ET.iterparse(stream):
            if e.tag == f"{{{MAIN}}}si":
                out.append(_decoded("".join(t.text or "" for t in e.iter(f"{{{MAIN}}}t"))))
                e.clear()
    return out


def _last_row(book: zipfile.ZipFile, part: str) -> int | None:
    """The last row that a sheet says it has; None where it doesn't say."""
    with book.open(part) as stream:
        found = re.search(rb'<dimension ref="[A-Z]+[0-9]+:[A-Z]+([0-9]+)"', stream.read(4096))
    return int(found[1]) if found else None


def sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str], first: int = 1, last: int | None = None) -> Iterator[dict[int, str]]:
    """Rows first to last of a sheet, each as texts by column number; a row is gone when the next is asked for."""
    number = 0
    with book.open(part) as stream:
        parent = None
        for event, e in ET.iterparse(stream, ("start", "end")):
            if event == "start":
                if e.tag == f"{{{MAIN}}}sheetData":
                    parent = e
                continue
            if e.tag != f"{{{MAIN}}}row":
                continue
            number = int(e.get("r") or number + 1)
            if last is not None and number > last:
                return
            if number >= first:
                cells, at = {}, -1
                for c in e:
                    at = column_number(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else at + 1
                    kind, value = c.get("t"), c.find(f"{{{MAIN}}}v")
                    if kind == "inlineStr":
                        text = _decoded("".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t")))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else _decoded(value.text)
                    if text != "":
                        cells[at] = text
                yield cells
            e.clear()
            if parent is not None:
                parent.clear()


@dataclass
class SheetRange(InputPartition):
    path: str
    part: str
    sheet: str
    first: int
    last: int | None

    def __post_init__(self):
        super().__init__((self.path, self.part, self.first))


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.path, self.only = options["path"], options.get("sheet")
        self.rows = int(options.get("rowspartition") or options.get("rowsPerPartition") or ROWS_PER_PARTITION)

    def partitions(self) -> list[SheetRange]:
        out = []
        for path in _files(self.path):
            files, at = _opened(path)
            with files.open_input_file(at) as f, zipfile.ZipFile(f) as book:
                for name, part in _sheets(book):
                    if self.only and name != self.only:
                        continue
                    last = _last_row(book, part)
                    if last is None:
                        out.append(SheetRange(path, part, name, 2, None))
                    else:
                        out += [SheetRange(path, part, name, a, min(a + self.rows - 1, last)) for a in range(2, last + 1, self.rows)]
        return out or [SheetRange("", "", "", 0, 0)]

    def read(self, own: SheetRange) -> Iterator[tuple]:
        if not own.path:
            return
        files, at = _opened(own.path)
        with files.open_input_file(at) as f, zipfile.ZipFile(f) as book:
            shared = _shared(book)
            head = next(sheet_rows(book, own.part, shared, 1, 1), {})
            place = {n: i for i, n in named(head).items()}
            fixed = {"_path": own.path, "_sheet": own.sheet}
            for row in sheet_rows(book, own.part, shared, own.first, own.last):
                yield tuple(fixed[n] if n in fixed else row.get(place[n]) if n in place else None for n in self.names)


def named(head: dict[int, str]) -> dict[int, str]:
    """Columns' names from a header row: blank ones by their letters, repeated ones with theirs."""
    out: dict[int, str] = {}
    for i in range(max(head, default=-1) + 1):
        name = head.get(i, "").strip() or column_letters(i)
        out[i] = f"{name}_{column_letters(i)}" if name.lower() in {n.lower() for n in out.values()} | {"_path", "_sheet"} else name
    return out


class Sheet:
    """A sheet's XML as it is written, row by row."""

    def __init__(self, book: zipfile.ZipFile, no: int, columns: list[str]):
        self.stream = book.open(f"xl/worksheets/sheet{no}.xml", "w", force_zip64=True)
        self.stream.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
        self.n = 0
        self.letters = [column_letters(i) for i in range(len(columns))]
        self.add(columns)

    def add(self, values: list[str | None]) -> None:
        self.n += 1
        cells = "".join(f'<c r="{a}{self.n}" t="inlineStr"><is><t xml:space="preserve">{_encoded(v)}</t></is></c>' for a, v in zip(self.letters, values, strict=True) if v not in (None, ""))
        self.stream.write(f'<row r="{self.n}">{cells}</row>'.encode())

    def close(self) -> None:
        self.stream.write(b"</sheetData></worksheet>")
        self.stream.close()


class Workbook:
    """An archive that sheets are streamed into, one after the other."""

    def __init__(self, path: str, columns: list[str]):
        self.book = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True)
        self.columns, self.names = columns, []
        self.sheet: Sheet | None = None
        self.of: str | None = None

    def add(self, of: str, values: list[str | None]) -> None:
        if self.sheet is None or of != self.of or self.sheet.n >= MOST_ROWS:
            if self.sheet:
                self.sheet.close()
            self.of = of
            self.names.append(self._name(of))
            self.sheet = Sheet(self.book, len(self.names), self.columns)
        self.sheet.add(values)

    def _name(self, of: str) -> str:
        """At most 31 characters, none of which a sheet's name can't have, and no other sheet's."""
        plain = re.sub(r"[\[\]:*?/\\]", "_", of)[:31].strip("'") or "sheet"
        name, n, taken = plain, 1, {x.lower() for x in self.names}
        while name.lower() in taken:
            n += 1
            name = f"{plain[: 31 - len(str(n)) - 1]} {n}"
        return name

    def close(self) -> None:
        if self.sheet:
            self.sheet.close()
        n = len(self.names)
        put = lambda at, body: self.book.writestr(at, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{body}')
        put("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>' + "".join(f'<sheet name={quoteattr(x)} sheetId="{i}" r:id="rId{i}"/>' for i, x in enumerate(self.names, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        put("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        sheets = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, n + 1))
        put("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{sheets}</Types>')
        self.book.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WorkbookWriter(DataSourceWriter):
    """Rows (key, sheet, columns), ordered by key and sheet within a task; a key's rows are one task's."""

    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields][2:]
        self.path = _uri(options["path"]).rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        files, at = _opened(self.path)
        files.create_dir(at, recursive=True)
        done: list[tuple[str, str]] = []
        key, book, local = None, None, None

        def close() -> None:
            if book is not None:
                book.close()
                # a task that is tried again writes under another name
                staged = f"{at}/.{self.job}-{uuid.uuid4().hex}"
                with open(local.name, "rb") as src, files.open_output_stream(staged) as out:
                    shutil.copyfileobj(src, out, 1 << 20)
                local.close()
                done.append((staged, f"{at}/{file_name(key)}.xlsx"))

        for row in rows:
            own = row[0] or ""
            if book is None or own != key:
                close()
                key, local = own, tempfile.NamedTemporaryFile(suffix=".xlsx")
                book = Workbook(local.name, self.columns)
            book.add(row[1] or "", list(row[2:]))
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = _opened(self.path)
        for m in messages:
            for staged, final in m.files if m else ():
                files.move(staged, final)

    def abort(self, messages: list[Written | None]) -> None:
        files, at = _opened(self.path)
        for i in files.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if i.base_name.startswith(f".{self.job}-"):
                files.delete_file(i.path)


def file_name(key: str) -> str:
    """A key as a file's name; what names can't have is written as %XX, so no two keys share one."""
    return re.sub(r"[^A-Za-z0-9._ -]|^\.", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), key) or "%"


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        """The first workbook's header (of the sheet asked for, else its first), then _path and _sheet."""
        found = _files(self.options["path"])
        head: dict[int, str] = {}
        if found:
            files, at = _opened(found[0])
            with files.open_input_file(at) as f, zipfile.ZipFile(f) as book:
                part = next((p for n, p in _sheets(book) if self.options.get("sheet") in (None, n)), None)
                head = next(sheet_rows(book, part, _shared(book), 1, 1), {}) if part else {}
        return T.StructType([T.StructField(n, T.StringType()) for n in [*named(head).values(), "_path", "_sheet"]])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def write_workbooks(df: DataFrame, path: str, key: str, sheet: str, order: tuple[str, ...] = ()) -> None:
    """A workbook for each key in a folder, with a sheet for each value of sheet, rows by order; other columns as text.

    A workbook that is there is replaced. A key's rows meet in one task, which streams them.
    """
    register(df.sparkSession)
    text = lambda c: F.col(f"`{c}`").cast("string")
    columns = [c for c in df.columns if c not in (key, sheet)]
    rows = df.select(text(key).alias("_key"), text(sheet).alias("_sheet_of"), *[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(order)], *[text(c).alias(c) for c in columns])
    placed = rows.repartition("_key").sortWithinPartitions("_key", "_sheet_of", *[f"_by{i}" for i in range(len(order))])
    placed.drop(*[f"_by{i}" for i in range(len(order))]).write.format("workbook").mode("append").option("path", path).save()
