"""Which sheet and which format a document is of, by signatures; and why it is of none."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import capital, capitals, collapse, without_spaces

#: Characters that a signature without its blanks must have to count.
LEAST_WITHOUT_SPACES = 8
#: Signatures at most: they are one expression's.
MOST_SIGNATURES = 20_000
# Sheets in the order of priority.
SHEETS = ("LLP", "HT", "OCCM")


def head(text: Column) -> Column:
    return capitals(collapse(text), text)


def _listed(signatures: DataFrame, *columns: Column) -> list:
    """The signatures themselves, which workers search for all at once: formats are few, and more than MOST are an error."""
    rows = signatures.select(*columns).limit(MOST_SIGNATURES + 1).collect()
    if len(rows) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} signatures")
    return rows


def _tree(words: list[str]) -> str:
    """An expression for the longest of words, in which no place of a text is tried once for each of them."""
    start = os.path.commonprefix(words)
    rest = [w[len(start) :] for w in words]
    if len(words) == 1:
        return re.escape(start)
    by: dict[str, list[str]] = {}
    for w in rest:
        if w:
            by.setdefault(w[0], []).append(w)
    return re.escape(start) + "(?:" + "|".join(_tree(own) for own in by.values()) + ")" + "?" * ("" in rest)


def _found(text: Column, words: list[str]) -> Column:
    """The longest of words at each place of a text; what else begins there is a beginning of it."""
    words = sorted({w for w in words if w})
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_tree(words)}))"), F.lit(1))) if words else F.array().cast("array<string>")


def _beginnings(words: Iterable[str]) -> dict[str, list[str]]:
    """Of each word those of words that it begins with, itself included."""
    every = set(words)
    return {w: [w[:n] for n in range(1, len(w) + 1) if w[:n] in every] for w in every if w}


def match_signatures(docs: DataFrame, signatures: DataFrame, key: str, text: str) -> DataFrame:
    """(key, variant, pass): of each document the first variant one of whose signatures it contains.

    signatures: (variant, priority, signature). Two passes: literally, then with blanks taken out of both for
    signatures of eight characters and more. A document of none is left out, and so is a null text; rows of one key
    count together. All signatures are found in one pass over a text, by one expression of a tree of them.
    """
    spark = docs.sparkSession
    s, s2 = capitals(F.col("signature")).alias("s"), capitals(without_spaces(F.col("signature"))).alias("s2")
    dim = sorted((r for r in _listed(signatures.dropna(subset=["signature"]), "priority", "variant", s, s2)), key=lambda r: (r["priority"], r["variant"]))
    first: dict[str, int] = {}
    squeezed: dict[str, int] = {}
    for i, r in enumerate(dim):
        first.setdefault(r["s"], i)
        if len(r["s2"]) >= LEAST_WITHOUT_SPACES:
            squeezed.setdefault(r["s2"], i)
    always = first.get("")
    ranks = [(1, w, min(first[b] for b in own)) for w, own in _beginnings(first).items()] + [(2, w, min(squeezed[b] for b in own)) for w, own in _beginnings(squeezed).items()]
    # tables of at most MOST_SIGNATURES words a pass
    table = F.broadcast(spark.createDataFrame(ranks, "pass int, word string, rank int"))
    named = F.broadcast(spark.createDataFrame([(i, r["variant"]) for i, r in enumerate(dim)], f"rank int, variant {dict(signatures.dtypes)['variant']}"))
    told = docs.filter(F.col(text).isNotNull()).select(key, _found(head(F.col(text)), list(first)).alias("_one"), text)
    literal = (F.size("_one") > 0) | F.lit(always is not None)
    # without blanks only where nothing is found literally
    told = told.select(key, F.when(literal, 1).otherwise(2).alias("pass"), F.when(literal, F.col("_one")).otherwise(_found(capitals(without_spaces(F.col(text)), F.col(text)), list(squeezed))).alias("words"))
    ranked = told.select(key, "pass", F.explode("words").alias("word")).join(table, ["pass", "word"]).select(key, "pass", "rank")
    if always is not None:
        ranked = ranked.unionByName(told.select(key, F.lit(1).alias("pass"), F.lit(always).alias("rank")))
    best = ranked.groupBy(key).agg(F.min(F.struct("pass", "rank")).alias("b"))
    return best.select(key, "b.pass", "b.rank").join(named, "rank").select(key, "variant", "pass")


def near_misses(docs: DataFrame, signatures: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """(key, variant, ratio): variants of which a document has at least 0.6 of a signature's words, though not all.

    The best ratios first, then by variant; a variant counts once; each row of docs is a document of its own. All words
    are found in one pass over a text.
    """
    spark = docs.sparkSession
    words = F.filter(F.split(head(F.col("signature")), " "), lambda w: w != "")
    dim = [(r["variant"], r["words"]) for r in _listed(signatures, "variant", words.alias("words")) if r["words"] and len(r["words"]) >= 2]
    of: dict[str, list[int]] = {}
    for i, (_, own) in enumerate(dim):
        for w in own:
            of.setdefault(w, []).append(i)
    # a word that is found at a place tells of all that begin it; each of them counts once a document
    begins = F.broadcast(spark.createDataFrame([(w, b) for w, own in _beginnings(of).items() for b in own], "word string, has string"))
    uses = F.broadcast(spark.createDataFrame([(w, i, own.count(i), len(dim[i][1]), dim[i][0]) for w, own in of.items() for i in sorted(set(own))], f"has string, no int, times int, size int, variant {dict(signatures.dtypes)['variant']}"))
    # numbered before words multiply the rows
    told = docs.select(key, text, F.monotonically_increasing_id().alias("_row")).select(key, "_row", F.explode(_found(head(F.col(text)), list(of))).alias("word"))
    held = told.join(begins, "word").select(key, "_row", "has").distinct().join(uses, "has")
    ratios = held.groupBy(key, "_row", "no", "variant", "size").agg((F.sum("times") / F.col("size")).alias("ratio")).filter((F.col("ratio") >= 0.6) & (F.col("ratio") < 1))
    best = ratios.groupBy(key, "_row", "variant").agg(F.max("ratio").alias("ratio"))
    place = F.row_number().over(Window.partitionBy(key, "_row").orderBy(F.desc("ratio"), "variant"))
    return best.withColumn("_no", place).filter(F.col("_no") <= most).select(key, "variant", "ratio")


def sheet_type(text: Column, signatures: dict[str, list[str]]) -> Column:
    """The first sheet, by priority, of which a text has a signature; literally first, then without blanks; else Unknown."""
    h, h2 = head(text), capitals(without_spaces(text), text)
    found = []
    for squeezed in (False, True):
        for sheet in SHEETS:
            for s in signatures.get(sheet, ()):
                own = "".join(capital(s).split()) if squeezed else capital(s)
                if not squeezed or len(own) >= LEAST_WITHOUT_SPACES:
                    found.append(F.when(F.contains(h2 if squeezed else h, F.lit(own)), sheet))
    return F.coalesce(*found, F.lit("Unknown"))


def dropped_rows(cells: Column, kept: Column) -> Column:
    """True, False or n/a: whether rows of eight characters and more were no data rows."""
    lost = F.size(F.filter(cells, lambda r: F.length(F.array_join(r, "")) >= 8)) - kept
    return F.when(F.size(cells) == 0, "n/a").when(lost > 0, "True").otherwise("False")
