"""Cell rules compiled to Column expressions: clean a value, flag what is doubtful, never drop a row.

The order of the steps is part of the contract: sequences, characters, pipes, leading marks, spaces, case, the I of a
letter prefix, emptiness, pattern, ranges.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import strip, without_spaces

# Sequences replaced in this order, then characters.
SEQUENCES = (("-'", "7"), ("'-", "7"), ("°1", "7"), ("1°", "7"), ("~~", "-"), ("··", "-"))
CHARACTERS = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "", "$": "S", "£": "E", "€": "E", "~": "-", "·": "-", "°": "-", "'": "", "`": ""}
LEADING_MARKS = ".,;:•·*"
THOUSANDS = r"^[-+]?\d{1,3}(?:[,.']\d{3})*$|^[-+]?\d+$"


@dataclass(frozen=True)
class Rule:
    pattern: str | None = None
    sequences: bool = False
    characters: bool = False
    strip_leading_marks: bool = False
    no_spaces: bool = False
    uppercase: bool = False
    keep_prefix_i: bool = False
    allow_empty: bool = False
    hard: tuple[int, int] | None = None
    review: tuple[int, int] | None = None


_OCR = {"sequences": True, "characters": True, "uppercase": True}
# Rules by column.
COLUMN_RULES: dict[str, Rule] = {
    "ATA": Rule(r"^\d{2}$", hard=(20, 83)),
    "ZONE": Rule(r"^\d{2,3}$"),
    "FIN": Rule(r"^[A-Z0-9]{2,8}$", no_spaces=True, **_OCR),
    "DESCRIPTION": Rule(uppercase=True),
    "VENDOR_CODE": Rule(r"^[A-Z0-9]{4,5}$", no_spaces=True, **_OCR),
    "PART_NUMBER": Rule(r"^[A-Z0-9](?:[A-Z0-9\-]*[A-Z0-9])?$", no_spaces=True, keep_prefix_i=True, strip_leading_marks=True, **_OCR),
    "SERIAL_NUMBER": Rule(r"^[A-Z0-9/](?:[A-Z0-9\-/]*[A-Z0-9/])?$", strip_leading_marks=True, **_OCR),
}


def merged_rules(base: Mapping[str, Rule], own: Mapping[str, Mapping | Rule]) -> dict[str, Rule]:
    """base overlaid column by column, and within a column key by key; None puts a key back to its default."""
    defaults = {f.name: f.default for f in fields(Rule)}
    out = dict(base)
    for column, changes in own.items():
        given = changes if isinstance(changes, Mapping) else {f.name: getattr(changes, f.name) for f in fields(Rule) if getattr(changes, f.name) != f.default}
        out[column] = replace(out.get(column, Rule()), **{k: defaults[k] if v is None else v for k, v in given.items()})
    return out


def prefix_i_restored(c: Column) -> Column:
    """A 1 among the first letters of a part number, at the second to fourth place between letters, is an I."""
    return F.regexp_replace(c, r"(?<=^(?=\p{L}).{0,2}\p{L})1(?=\p{L})", "I")


def cleaned(value: Column, rule: Rule | None) -> Column:
    c = strip(value)
    if rule is None:
        return c
    if rule.sequences:
        for old, new in SEQUENCES:
            c = F.replace(c, F.lit(old), F.lit(new))
    if rule.characters:
        kept = {k: v for k, v in CHARACTERS.items() if v}
        gone = [k for k, v in CHARACTERS.items() if not v]
        c = F.translate(c, "".join([*kept, *gone]), "".join(kept.values()))
    c = strip(F.replace(c, F.lit("|"), F.lit("")))
    if rule.strip_leading_marks:
        c = F.regexp_replace(c, f"^[{LEADING_MARKS}]+", "")
    if rule.no_spaces:
        c = without_spaces(c)
    if rule.uppercase:
        c = F.upper(c)
    if rule.keep_prefix_i:
        c = prefix_i_restored(c)
    return c


def thousands(c: Column) -> Column:
    """A whole number with or without marks between groups of three digits; null for anything else."""
    return F.when(c.rlike(THOUSANDS), F.translate(c, ",'.", "").try_cast("bigint"))


def issues(c: Column, rule: Rule | None) -> Column:
    """What is doubtful about a cleaned value: an array of reasons."""
    if rule is None:
        return F.array().cast("array<string>")
    empty = c == ""
    found = [F.when(empty, F.lit(None) if rule.allow_empty else F.lit("empty"))]
    if rule.pattern:
        anchored = rule.pattern if rule.pattern.startswith("^") else f"^(?:{rule.pattern})"
        found.append(F.when(~empty & ~c.rlike(anchored), "bad_format"))
    if rule.hard or rule.review:
        n = thousands(c)
        outside = lambda r: (n < r[0]) | (n > r[1])
        kind = F.when(n.isNull(), "not_a_number")
        if rule.hard:
            kind = kind.when(outside(rule.hard), "out_of_range")
        if rule.review:
            kind = kind.when(outside(rule.review), "over_review_band")
        found.append(F.when(~empty, kind))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def clean_record(df: DataFrame, rules: Mapping[str, Rule] = COLUMN_RULES, into: str = "_issues") -> DataFrame:
    """df with every column cleaned by its rule and the issues of all, COLUMN:reason, joined by commas in order.

    Columns that begin with an underscore are left alone; values become text, null the empty one. Rows stay as many.
    """
    named = [c for c in df.columns if not c.startswith("_")]
    # one layer for values, one for issues: expressions don't multiply
    values = df.select(*[cleaned(F.col(f"`{c}`"), rules.get(c)).alias(c) if c in named else F.col(f"`{c}`") for c in df.columns if c != into])
    marks = [F.transform(issues(F.col(f"`{c}`"), rules.get(c)), _tagged(c)) for c in named]
    return values.withColumn(into, F.array_join(F.flatten(F.array(*marks)), ",") if marks else F.lit(""))


def _tagged(column: str):
    return lambda reason: F.concat(F.lit(f"{column}:"), reason)
