"""Building the fact of positions from a list of classified files and the rows read from them, and its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import blank

# Formats that tell positions, with the columns of the position, its source, the zone and the kardex.
POSITION_COLUMNS = (
    ("Aeroflot", "FIN", "FIN", "ZONE", None),
    ("Aircraft Inventory Report (MM_504)", "POSITION", "POSITION", None, None),
    ("Aircraft Rotables Report", "POSITION", "POSITION", None, None),
    ("AMOS", "POS", "POS", None, None),
    ("Aircraft Spec File OCCM", "POS", "POS", None, None),
    ("A330 Engineering Planning OCCM", "FIN", "FIN", "ZONE", None),
    ("B777 Annex 8 OCCM", "POSITION", "POSITION", None, None),
    ("EL AL B767-3Q8ER Records Package", None, "NONE", None, None),
    ("Georgian Airways B737", "POSITION", "POSITION", None, None),
    ("AMOS HT (Aircraft Equipment List Report)", "POS", "POS", None, None),
    ("MM_510 HARD TIME LLP Components", "POSITION", "POSITION", None, None),
    ("TAP HT (compact)", "POSITION", "POSITION", None, None),
    ("Iberia Listado HT", "LOCATION", "LOCATION", None, None),
    ("OASES Lifed Component Report", "POSITION", "POSITION", None, None),
    ("STARS Trax HT", "POSITION", "POSITION", None, None),
    ("Aircraft Rotables HT", "POSITION", "POSITION", None, None),
    ("B777 Annex 7 OCCM", None, "TEMPLATE", None, None),
    ("CCA A340 OCCM", "LOCATION", "LOCATION", None, None),
    ("On Condition Monitoring OCCM", "POSITION", "POSITION", None, None),
    ("Swiss A340 OCCM", "POSITION", "POSITION", None, None),
    ("A305 A340 OCCM", "POSITION", "POSITION", None, None),
    ("Avianca OCCM", "POSITION", "POSITION", None, None),
    ("Aegean ERJ OCCM", "POSITION", "POSITION", None, None),
    ("Cathay OCCM", "LOCATION", "LOCATION", None, None),
    ("CONFIG SLOT OCCM", "POSITION", "POSITION", None, None),
    ("Iberia Listado OCCM", "LOCATION", "LOCATION", None, None),
    ("OASES", "POSITION", "POSITION", "ZONE", None),
    ("OCCM List As At", "POSN", "POSN", None, None),
    ("OCCM Status List", "FIN", "FIN", None, None),
    ("MSN Components Status List", "FIN", "FIN", "ZONE", None),
    ("B737-600 IPC-style OCCM (Multi-line)", "POS", "POS", None, None),
    ("On Condition Components Report", "POSITION", "POSITION", None, None),
    ("Remaining Potentials", "AMM_FIN", "AMM_FIN", None, "KARDEX"),
    ("Standard OCCM", "FIN", "FIN", None, None),
    ("TAP Compact OCCM", "POSITION", "POSITION", None, None),
    ("Technical Object Listing", "FUNCTIONAL_LOCATION", "FUNCTIONAL_LOCATION", None, "KARDEX"),
)
# Names that a format may give a column, the first that is there and not blank counts.
CANDIDATES = {"part_number": ("PART_NUMBER", "PN", "P_N"), "serial_number": ("SERIAL_NUMBER", "SERIAL", "S_N"), "description": ("DESCRIPTION", "EQUIPMENT_DESCRIPTION", "PART_NAME"), "ata": ("ATA",)}
# Variants of files that no format was found for.
UNREAD = ("", "Unknown", "Timeout")


def position_columns(spark) -> DataFrame:
    """(variant, position_column, position_source, zone_column, kardex_column): a table of a few dozen rows."""
    return spark.createDataFrame(POSITION_COLUMNS, "variant string, position_column string, position_source string, zone_column string, kardex_column string")


def tagged(sheets: dict[str, DataFrame]) -> DataFrame:
    """Rows of all sheets, whatever their columns, each with its sheet_type; what a sheet lacks is null."""
    out: DataFrame | None = None
    for tag, df in sheets.items():
        own = df.withColumn("sheet_type", F.lit(tag))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sheets")
    return out


def read_files(files: DataFrame) -> DataFrame:
    """Files of a known variant, its name stripped."""
    variant = F.trim(blank(F.col("variant")))
    return files.withColumn("variant", variant).filter(~variant.isin(*UNREAD))


def with_families(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """files (filename, family, family_confidence, model_raw) with reviewed families (filename, family, model_raw) where theirs is unsure."""
    own = overrides.select(F.col("filename").alias("_file"), F.col("family").alias("_family"), F.col("model_raw").alias("_model"))
    unsure = F.col("_file").isNotNull() & (F.trim(blank(F.col("family"))).isin("", "Unknown") | blank(F.col("family_confidence")).isin("", "none", "low"))
    return files.join(own, F.col("filename") == F.col("_file"), "left").select(
        *[c for c in files.columns if c not in ("family", "family_confidence", "model_raw")],
        F.when(unsure, F.col("_family")).otherwise(F.col("family")).alias("family"),
        F.when(unsure, F.lit("manual_review")).otherwise(F.col("family_confidence")).alias("family_confidence"),
        F.when(unsure, F.coalesce(F.nullif("_model", F.lit("")), F.col("model_raw"))).otherwise(F.col("model_raw")).alias("model_raw"),
    )


def first_present(record: Column, names: Sequence[str]) -> Column:
    """The first of a record's (map) named cells that is not blank, stripped; else empty."""
    return F.coalesce(*[F.nullif(F.trim(blank(F.try_element_at(record, F.lit(n)))), F.lit("")) for n in names], F.lit(""))


def positions(files: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The fact: files (filename, variant, ...) with rows (source_file, variant, record map) of formats that tell positions.

    Files of unread or unmapped variants and files without rows are left out; unmapped() and without_rows() report them.
    """
    mapped = read_files(files).join(columns, "variant")
    own = rows.select(F.col("source_file").alias("filename"), F.trim(blank(F.col("variant"))).alias("variant"), "record")
    named = mapped.join(own, ["filename", "variant"])
    cell = lambda c: F.trim(blank(F.try_element_at("record", F.col(c))))
    conformed = [first_present(F.col("record"), names).alias(k) for k, names in CANDIDATES.items()]
    kept = [c for c in files.columns if c not in ("variant",)]
    return named.select(*kept, "variant", "position_source", cell("position_column").alias("position"), cell("zone_column").alias("zone"), cell("kardex_column").alias("kardex"), *conformed)


def unmapped(files: DataFrame, columns: DataFrame) -> DataFrame:
    """(variant, files): read files whose format tells no positions."""
    return read_files(files).join(columns, "variant", "left_anti").groupBy("variant").agg(F.count("*").alias("files"))


def without_rows(files: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Files whose format tells positions, but of which there are no rows."""
    mapped = read_files(files).join(columns, "variant", "left_semi")
    own = rows.select(F.col("source_file").alias("filename"), F.trim(blank(F.col("variant"))).alias("variant")).distinct()
    return mapped.join(own, ["filename", "variant"], "left_anti").select(*files.columns)


def buckets(files: DataFrame) -> DataFrame:
    """(sheet_type, variant, files), the fullest first."""
    return files.groupBy("sheet_type", "variant").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "sheet_type", "variant")


def dropped_text(files: DataFrame) -> DataFrame:
    """Of files (sheet_type, variant, l2_kept_rows, l2_candidate) that were looked at: (sheet_type, variant, checked, flagged)."""
    looked = files.filter(~blank(F.col("l2_kept_rows").cast("string")).isin("", "-1") & F.col("l2_candidate").isin("True", "False"))
    return looked.groupBy("sheet_type", "variant").agg(F.count("*").alias("checked"), F.count_if(F.col("l2_candidate") == "True").alias("flagged"))


def worst_dropped(files: DataFrame, n: int = 10) -> DataFrame:
    """A top-k report: flagged files by the number of rows that were lost."""
    return files.filter("l2_candidate = 'True'").orderBy(F.col("l2_dropped_rows").cast("long").desc_nulls_last(), "filename").limit(n)


def variant_rollup(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(variant, files_total, files_ok, rows, clean): files are ok if they have rows; rows are clean without issues."""
    own = rows.groupBy(F.col("source_file").alias("filename"), "variant").agg(F.count("*").alias("n"), F.count_if(blank(F.col("_issues")) == "").alias("c"))
    each = files.join(own, ["filename", "variant"], "left")
    return each.groupBy("variant").agg(F.count("*").alias("files_total"), F.count("n").alias("files_ok"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("c"), F.lit(0)).alias("clean"))


def chapter_rows(rows: DataFrame, chapter: str = "21") -> DataFrame:
    """(variant, rows): rows of an ATA chapter by variant."""
    return rows.filter(blank(F.col("ata")).startswith(chapter)).groupBy("variant").agg(F.count("*").alias("rows"))


def seeded_sample(files: DataFrame, key: str, n: int = 10, seed: int = 7) -> DataFrame:
    """A sampling operator: n files by the digest of seed and key, the same for the same seed whatever engine takes it."""
    return files.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def without_trailing_hyphens(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"-+$", "")
