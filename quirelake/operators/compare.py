"""Two snapshots compared, two documents paired, rows found by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import blank

# Columns that comparisons leave out.
INTERNAL = ("_issues", "_page", "_source", "_trailer", "_ref_htll", "_pn_known")
KINDS = ("added", "changed", "removed", "unchanged")
# Keys by sheet.
DEFAULT_KEYS = {"OCCM": ("FIN", "PART_NUMBER"), "HT": ("PART_NUMBER", "SERIAL_NUMBER"), "LLP": ("NO",)}


def sheet_of(columns: list[str]) -> str:
    """The sheet that columns look like."""
    has = set(columns).issuperset
    if has({"FIN", "PART_NUMBER", "SERIAL_NUMBER"}):
        return "OCCM"
    if has({"PART_NUMBER", "AIRCRAFT", "DEADLINE"}):
        return "HT"
    return "LLP" if has({"NO", "TSN", "CSN", "REMAINING"}) else "OCCM"


def shown(c: Column) -> Column:
    return F.when(F.length(c) <= 40, c).otherwise(F.concat(F.left(c, F.lit(37)), F.lit("…")))


def key_of(df: DataFrame, keys: list[str]) -> Column:
    return F.concat_ws(",", *[F.upper(F.trim(blank(F.col(k)))) if k in df.columns else F.lit("") for k in keys])


def diff_snapshots(old: DataFrame, new: DataFrame, keys: list[str] | None = None, order: str = "row_seq", ignore: tuple[str, ...] = ()) -> DataFrame:
    """_change, _key, _changes and the columns of both: what was added, changed, removed or stayed.

    Of rows with one key the last in `order` counts. Keys are stripped and in upper case; columns of either snapshot are
    compared as stripped text, a missing one as empty.
    """
    keys = list(keys or DEFAULT_KEYS[sheet_of(new.columns)])
    skip = {*INTERNAL, *ignore, order}
    columns = [c for c in dict.fromkeys([*new.columns, *old.columns]) if c not in skip]

    def last(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("_key").orderBy(F.desc(order))
        own = df.withColumn("_key", key_of(df, keys)).withColumn("_no", F.row_number().over(w)).filter("_no = 1")
        values = F.struct(*[(blank(F.col(f"`{c}`")) if c in df.columns else F.lit("")).alias(c) for c in columns])
        return own.select("_key", values.alias("v"))

    both = last(old).select("_key", F.col("v").alias("o")).join(last(new).select("_key", F.col("v").alias("n")), "_key", "full_outer")
    deltas = []
    for c in columns:
        a, b = F.trim(F.col(f"o.`{c}`")), F.trim(F.col(f"n.`{c}`"))
        deltas.append(F.when(a != b, F.concat(F.lit(f"{c}:"), shown(a), F.lit("→"), shown(b))))
    found = F.filter(F.array(*deltas), lambda x: x.isNotNull())
    here = F.col("o").isNotNull() & F.col("n").isNotNull()
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(found) > 0, "changed").otherwise("unchanged")
    out = both.select(kind.alias("_change"), "_key", F.when(here, F.array_join(found, "; ")).otherwise("").alias("_changes"), F.coalesce("n", "o").alias("v"))
    return out.select("_change", "_key", "_changes", "v.*")


def in_diff_order(diff: DataFrame) -> DataFrame:
    return diff.orderBy(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("_change")), "_key")


def search(df: DataFrame, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where some column matches a pattern, whatever the case."""
    hit = F.lit(False)
    for c in columns or df.columns:
        hit = hit | F.coalesce(F.col(c).cast("string").rlike(f"(?i){pattern}"), F.lit(False))
    return df.filter(hit)


def row_text_contains(df: DataFrame, text: str, columns: list[str], flagged_only: bool = False) -> DataFrame:
    """Rows whose cells, put together without blanks between, contain a text, whatever the case."""
    hit = F.contains(F.lower(F.concat(*[blank(F.col(c)) for c in columns])), F.lit(text.lower()))
    return df.filter(hit & (F.col("_issues") != "")) if flagged_only else df.filter(hit)


# What a caller may do with a pair.
PAIR_CLASSES = {
    "manual_override": "safe", "msn_match": "safe", "registration_match": "safe", "msn_one_side_only": "safe",
    "filename_only": "ask", "no_match": "ask",
    "msn_mismatch": "hard-stop", "registration_mismatch": "hard-stop",
}


def pair(a: str, b: str, override: Column | None = None) -> Column:
    """struct(status, key, confidence, class, warning) of two documents' structs (msn, registration, key, source).

    The first rung that applies: an override; serial numbers on both, equal or not; registrations on both, equal or not;
    a serial number on one side that the other's key agrees with; equal keys of file names; nothing in common.
    """
    x, y = (lambda f: F.coalesce(F.col(f"{a}.{f}"), F.lit(""))), (lambda f: F.coalesce(F.col(f"{b}.{f}"), F.lit("")))
    both = lambda f: (x(f) != "") & (y(f) != "")
    same = lambda f: x(f) == y(f)

    def verdict(status: str, key: Column | str, sure: str, warning: Column | str = "") -> Column:
        parts = {"status": status, "key": key, "confidence": sure, "class": PAIR_CLASSES[status], "warning": warning}
        return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in parts.items()])

    differ = lambda f: F.concat(F.lit(f"{f} "), x(f), F.lit(" is not "), y(f))
    given = F.coalesce(override, F.lit("")) if override is not None else F.lit("")
    return (
        F.when(given != "", verdict("manual_override", given, "manual_required"))
        .when(both("msn") & same("msn"), verdict("msn_match", x("msn"), "high"))
        .when(both("msn"), verdict("msn_mismatch", "", "manual_required", differ("msn")))
        .when(both("registration") & same("registration"), verdict("registration_match", x("registration"), "high"))
        .when(both("registration"), verdict("registration_mismatch", "", "manual_required", differ("registration")))
        .when((x("msn") != "") & (y("msn") == "") & (y("key") == x("msn")), verdict("msn_one_side_only", x("msn"), "medium", "matched on the second side's key"))
        .when((y("msn") != "") & (x("msn") == "") & (x("key") == y("msn")), verdict("msn_one_side_only", y("msn"), "medium", "matched on the first side's key"))
        .when((x("key") != "") & same("key"), verdict("filename_only", x("key"), "manual_required", "matched on keys of file names"))
        .otherwise(verdict("no_match", "", "manual_required", differ("key")))
    )
