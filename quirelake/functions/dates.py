"""Two normalisers of dates, which differ on purpose: cells keep what they can't read, report dates become empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import LINE_END, plain_dashes, strip

# Months of cells.
CELL_MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
    "JANUARY": 1, "FEBRUARY": 2, "MARCH": 3, "APRIL": 4, "JUNE": 6, "JULY": 7, "AUGUST": 8, "SEPTEMBER": 9, "OCTOBER": 10, "NOVEMBER": 11, "DECEMBER": 12,
    "ENE": 1, "FEV": 2, "ABR": 4, "MAI": 5, "AGO": 8, "SET": 9, "OUT": 10, "DEZ": 12, "DIC": 12,
}
# Months of report dates.
REPORT_MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
    "JANUARY": 1, "FEBRUARY": 2, "MARCH": 3, "APRIL": 4, "JUNE": 6, "JULY": 7, "AUGUST": 8, "SEPTEMBER": 9, "OCTOBER": 10, "NOVEMBER": 11, "DECEMBER": 12,
    "FEV": 2, "ABR": 4, "AGO": 8, "SET": 9, "OUT": 10, "DEZ": 12,
    "JANV": 1, "FÉVR": 2, "FEVR": 2, "MARS": 3, "AVR": 4, "JUIN": 6, "JUIL": 7, "AOÛ": 8, "AOU": 8, "AOÛT": 8, "AOUT": 8, "SEPT": 9, "DÉC": 12,
}
# Forms of cell dates in the order they are tried, and which group is what.
CELL_FORMS = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "ymd"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "dmy"),
    (r"^(\d{1,2})[-/.]([A-Za-z]{3,9})[-/.](\d{4})$", "dMy"),
    (r"^(\d{1,2})[-/.]([A-Za-z]{3,9})[-/.](\d{2})$", "dMy"),
    (r"^([A-Za-z]{3,9})[-/.\s](\d{1,2})[-/.,\s]+(\d{4})$", "Mdy"),
    (r"^([A-Za-z]{3,9})[-/.\s](\d{1,2})[-/.,\s]+(\d{2})$", "Mdy"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})$", "dmy"),
)
# Forms of report dates.
REPORT_FORMS = (
    (r"^(\d{4})-(\d{2})-(\d{2})$", "ymd"),
    (r"^(\d{1,2})[-/]([A-Za-z]{3,9}\.?)[-/.]?(\d{2,4})$", "dMy"),
    (r"^(\d{1,2})\.([A-Za-z]{3,4})\.(\d{4})$", "dMy"),
    (r"^(\d{1,2})([A-Za-z]{3,4})(\d{4})$", "dMy"),
    (r"^(\d{1,2})\s+([A-Za-z]{3})\s+(\d{2,4})$", "dMy"),
    (r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})$", "dmy"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "dmy"),
    (r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})$", "Mdy"),
)


#: Between a date's parts, once its form is known.
_CUT = "\x1f"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _told(s: Column, forms: tuple[tuple[str, str], ...]) -> Column:
    """Year, month, day and "M" for a month's name, as texts, of the first form that s has; no form is null."""
    shapes = []
    for pattern, order in forms:
        at = {k.lower(): f"${i}" for i, k in enumerate(order, 1)}
        shapes.append(F.when(s.rlike(pattern), F.regexp_replace(s, pattern, _CUT.join([at["y"], at["m"], at["d"], "M" if "M" in order else ""]))))
    return F.split(F.coalesce(*shapes), _CUT, -1)


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _month(p: Column, months: dict[str, int]) -> Column:
    return F.when(p[3] == "M", _named(F.rtrim(p[1], F.lit(".")), months)).otherwise(_number(p[1]))


def _named(c: Column, months: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    return F.try_element_at(table, F.upper(c))


def _padded(n: Column, width: int) -> Column:
    """With zeros in front; longer numbers stay whole."""
    return _let(n.cast("string"), lambda s: F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0")))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", _padded(year, 4), _padded(month, 2), _padded(day, 2))


def normalize_date(value: Column) -> Column:
    """A cell's date as YYYY-MM-DD, the day first; two digits up to 50 are of this century.

    A value in no known form, or no day of the calendar, stays as it was.
    """

    def dated(p: Column) -> Column:
        year = _let(_number(p[0]), lambda y: F.when(y < 100, y + F.when(y <= 50, 2000).otherwise(1900)).otherwise(y))
        iso = F.concat_ws("-", *[F.lpad(n.cast("string"), w, "0") for n, w in ((year, 4), (_month(p, CELL_MONTHS), 2), (_number(p[2]), 2))])
        return _let(iso, lambda d: F.when((F.left(d, F.lit(4)) != "0000") & F.try_to_date(d, "yyyy-MM-dd").isNotNull(), d))

    def read(s: Column) -> Column:
        known = F.when((s == "") | s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
        return F.coalesce(known, _let(_told(s, CELL_FORMS), lambda p: F.when(p.isNotNull(), dated(p))))

    return F.coalesce(_let(plain_dashes(strip(value)), read), value)


def report_date_iso(raw: Column) -> Column:
    """A report's date as YYYY-MM-DD, or empty; days and months are held to 31 and 12, two digits from 50 on are 19xx.

    Forms with a month's name don't check the day.
    """

    def dated(p: Column) -> Column:
        day, month = _number(p[2]), _month(p, REPORT_MONTHS)
        year = F.when(F.length(p[0]) == 4, p[0]).otherwise(_let(_number(p[0]), lambda n: F.concat(F.when(n < 50, "20").otherwise("19"), _padded(n, 2))))
        fine = F.when(p[3] == "M", month.isNotNull()).otherwise(day.between(1, 31) & month.between(1, 12))
        return F.when(fine, _iso(year, month, day)).otherwise("")

    def read(s: Column) -> Column:
        return _let(_told(s, REPORT_FORMS), lambda p: F.when(p.isNotNull(), dated(p)))

    return F.when(raw.isNotNull(), F.coalesce(_let(F.rtrim(strip(raw), F.lit(".")), read), F.lit(""))).otherwise("")


# Words of lines that carry a report's date, and its forms anywhere in a line.
REPORT_DATE_LINE = r"(?i)\b(DATE|REPORT|AS\s+OF|VALID\s+AS\s+OF|REFERENCE|UPDATED|dd)\b"
ANY_DATE = (
    r"\b(\d{1,2}[-/][A-Za-z]{3,8}[-/.]?\d{2,4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|[A-Z][a-z]{2,8}\s+\d{1,2},?\s+\d{4}"
    r"|\d{1,2}\.[A-Za-z]{3,4}\.\d{4}|\d{1,2}[A-Za-z]{3,4}\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}\s+[A-Za-z]{3}\s+\d{2,4})\b"
)


# Dashes that report dates are read with.
REPORT_DASHES = "\u2010\u2011\u2013\u2014\u2212"


def extract_report_date(text: Column) -> Column:
    """The first date of a line among the first twenty that speaks of one; else the first in 3000 characters; raw, dashes plain."""
    text = F.translate(text, REPORT_DASHES, "-" * len(REPORT_DASHES))
    lines = F.slice(F.split(text, LINE_END), 1, 20)
    dated = F.filter(lines, lambda x: x.rlike(REPORT_DATE_LINE) & x.rlike(ANY_DATE))
    named = F.regexp_extract(F.get(dated, 0), ANY_DATE, 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.regexp_extract(F.left(text, F.lit(3000)), ANY_DATE, 1), F.lit(""))


# Columns that hold dates; so does every other one whose name ends in _DATE.
DATE_COLUMNS = (
    "INSTALL_DATE", "DATE", "LAST_DONE_DATE", "NEXT_DUE_DATE", "REMOVAL_DATE", "EXPIRY_DATE", "OVERHAUL_DATE", "MANUFACTURE_DATE",
    "LAST_SHOP_VISIT_DATE", "FITMENT_DATE", "COMPLIANCE_DATE", "DUE_DATE", "LAST_DATE", "DONE_DATE", "CERT_DATE", "D.O.M",
)


def is_date_column(name: str) -> bool:
    return not name.startswith("_") and (name.upper() in DATE_COLUMNS or name.upper().endswith("_DATE"))


def normalize_dates(df: DataFrame) -> DataFrame:
    """Every text column that holds dates, by its name, with its cells normalised; blank cells stay as they are."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.when(strip(c) == "", c).otherwise(normalize_date(c))
    return df.select(*[cell(F.col(f"`{c}`")).alias(c) if is_date_column(c) and kinds[c] == "string" else F.col(f"`{c}`") for c in df.columns])
