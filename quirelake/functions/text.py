"""Text expressions: every one is a Column, so it stays in generated code.

White space and digits are ASCII where a function says so; strip() alone takes all Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a line ends, as Python splits text.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# The dashes that count as one.
DASHES = "‐‑‒–—−"
# Letters whose capital is several letters, and one letter that stands for each: its own, or itself.
_WIDE = "".join(c for c in map(chr, range(0xFB20)) if len(c.upper()) > 1)
_NARROW = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _WIDE)
#: Ranges that hold all of these but ß.
_RARE = "[\\u0149\\u01f0\\u0390\\u03b0\\u0587\\u1e96-\\u1e9a\\u1f50-\\u1fff\\ufb00-\\ufb1f]"
#: Private characters that stand for these while the others are put in capitals.
_HELD = "".join(chr(0x10FF00 + i) for i in range(len(_WIDE)))


def blank(c: Column) -> Column:
    """The text of a cell; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of ASCII white space as one blank, ends stripped."""
    return F.trim(F.regexp_replace(blank(c), r"[ \t\r\n\f\x0B]+", " "))


def plain_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def without_spaces(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"(?U)\s+", "")


def capitals(c: Column, of: Column | None = None) -> Column:
    """A text in capitals, a letter for each letter, as SQL's upper has it: ß is ẞ, never two letters that other words hold.

    of: the text that c is made of, which is searched in its place for letters that need care.
    """
    plain = F.replace(c, F.lit("ß"), F.lit("ẞ"))
    held = F.translate(F.upper(F.translate(plain, _WIDE, _HELD)), _HELD, _NARROW)
    return F.when((c if of is None else of).rlike(_RARE), held).otherwise(F.upper(plain))


def capital(text: str) -> str:
    """`capitals` of a text in Python."""
    return "".join(_NARROW[_WIDE.index(c)] if c in _WIDE else c.upper() for c in text)


def undoubled(c: Column) -> Column:
    """Characters that a broken font printed twice, once: pairs from the left."""
    return F.regexp_replace(c, r"(.)\1", "$1")


def joined_letters(line: Column) -> Column:
    """A letter-spaced heading as words: runs of three single letters and more are joined."""
    state = F.struct(F.lit("").alias("out"), F.lit("").alias("run"))

    def flushed(s: Column) -> Column:
        run = F.when(F.length(s["run"]) >= 3, s["run"]).otherwise(F.array_join(F.split(s["run"], ""), " "))
        return F.when(s["run"] == "", s["out"]).otherwise(F.concat_ws(" ", F.nullif(s["out"], F.lit("")), run))

    def step(s: Column, t: Column) -> Column:
        single = t.rlike(r"^\p{L}$")
        more = F.concat_ws(" ", F.nullif(flushed(s), F.lit("")), t)
        return F.struct(F.when(single, s["out"]).otherwise(more).alias("out"), F.when(single, F.concat(s["run"], t)).otherwise(F.lit("")).alias("run"))

    return F.aggregate(F.filter(F.split(collapse(line), " "), lambda t: t != ""), state, step, flushed)


def joined_thousands(c: Column) -> Column:
    """Blanks between a number's groups of three digits removed."""
    return F.regexp_replace(c, r"(?<=\d) (?=\d{3}(?!\d))", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), r"[/()]", "")


def stem(filename: Column) -> Column:
    """A name without its last suffix, blanks and slashes as underscores, 100 characters at most."""
    return F.left(F.translate(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), " /", "__"), F.lit(100))


def snippet(c: Column, n: int) -> Column:
    return F.left(collapse(c), F.lit(n))


# text layers


def cid_share(c: Column) -> Column:
    """The share of a text that is (cid:n) codes of an undecoded font."""
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(1 - F.length(F.regexp_replace(c, r"\(cid:\d+\)", "")) / F.length(c))


def letter_share(c: Column) -> Column:
    """The share of ASCII letters among a text's characters other than white space."""
    solid = F.regexp_replace(c, r"\s", "")
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(solid, "[^A-Za-z]", "")) / F.length(solid))


def unusable_reason(c: Column) -> Column:
    """Why a text layer can't be read, or null."""
    text = strip(c)
    return (
        F.when(F.length(text) == 0, "no_text_layer")
        .when(F.length(text) < 50, "near_blank_text")
        .when(cid_share(text) >= 0.5, "garbled_cid")
        .when(letter_share(text) < 0.3, "garbled_encoding")
    )


def ocr_cleaned(page: Column) -> Column:
    """A recognised page's lines without table borders and separator runs; blank lines go."""
    lines = F.transform(F.split(blank(page), "\n"), lambda x: collapse(F.regexp_replace(F.regexp_replace(x, r"[|\[\]{}]", " "), r"[-_=~]{3,}", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
