"""Queries of the fact build: order lines as the rows of files, orders as files, their formats from the order's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import facts
from quirelake.sources.tables import table

_VARIANTS = ("AMOS", "OASES", " Standard OCCM ", "Remaining Potentials", "Unknown", "", "No Such List")


def _variant():
    return F.get(F.array(*[F.lit(v) for v in _VARIANTS]), (F.col("o_orderkey") % len(_VARIANTS)).cast("int"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("F"), F.col("o_orderkey").cast("string"))
    low = F.col("o_orderkey") % 3 == 0
    files = o.select(name.alias("filename"), _variant().alias("variant"), "o_orderpriority", F.when(low, "Unknown").otherwise("A330").alias("family"), F.when(low, "none").otherwise("high").alias("family_confidence"), F.lit("330").alias("model_raw"), (F.col("o_custkey") % 2).alias("side"))
    sheets = {"OCCM": files.filter("side = 0").drop("side"), "HT": files.filter("side = 1").drop("side", "model_raw")}
    return facts.tagged(sheets)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    part, text = F.col("l_partkey").cast("string"), lambda c: F.col(c).cast("string")
    record = F.create_map(
        F.lit("POS"), text("l_linenumber"), F.lit("POSITION"), F.concat(F.lit(" P"), text("l_linenumber")), F.lit("FIN"), text("l_suppkey"), F.lit("AMM_FIN"), F.concat(text("l_suppkey"), F.lit("VU")), F.lit("KARDEX"), part,
        F.lit("ZONE"), F.col("l_returnflag"), F.lit("PN"), F.when(F.col("l_partkey") % 2 == 0, part).otherwise(F.lit(" ")), F.lit("P_N"), F.concat(part, F.lit("-")), F.lit("ATA"), F.when(F.col("l_linenumber") == 1, "21-10").otherwise("24-00"),
    )
    read = li.filter("l_linestatus <> 'F'")
    return read.select(F.concat(F.lit("F"), text("l_orderkey")).alias("source_file"), _variant().alias("variant"), record.alias("record"), F.when(F.col("l_quantity") > 25, "x").otherwise("").alias("_issues"))


def fact_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact, counted by what tells its rows apart."""
    fact = facts.positions(_files(spark, sf_dir), _rows(spark, sf_dir), facts.position_columns(spark))
    number = facts.without_trailing_hyphens(F.col("part_number"))
    return fact.groupBy("sheet_type", "variant", "position_source", "position", "zone", "kardex", number.alias("part_number"), "ata").agg(F.count("*").alias("rows"))


def fact_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    reviewed = table(spark, sf_dir, "customer").select(F.concat(F.lit("F"), F.col("c_custkey").cast("string")).alias("filename"), F.lit("A340").alias("family"), F.when(F.col("c_custkey") % 2 == 0, "340-300").otherwise("").alias("model_raw"))
    return facts.with_families(files, reviewed).groupBy("family", "family_confidence", F.coalesce("model_raw", F.lit("")).alias("model_raw")).agg(F.count("*").alias("files"))


def fact_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.unmapped(_files(spark, sf_dir), facts.position_columns(spark))


def fact_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.without_rows(_files(spark, sf_dir), _rows(spark, sf_dir), facts.position_columns(spark)).select("filename")


def file_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.buckets(facts.read_files(_files(spark, sf_dir)))


def variant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.variant_rollup(_files(spark, sf_dir), _rows(spark, sf_dir))


def chapter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return facts.chapter_rows(rows.select("variant", facts.first_present(F.col("record"), ("ATA",)).alias("ata")))


QUERIES = {f.__name__: f for f in (fact_build, fact_families, fact_unmapped, fact_without_rows, file_buckets, variant_rollup, chapter_rows)}

_V = "CASE o_orderkey % 7 WHEN 0 THEN 'AMOS' WHEN 1 THEN 'OASES' WHEN 2 THEN ' Standard OCCM ' WHEN 3 THEN 'Remaining Potentials' WHEN 4 THEN 'Unknown' WHEN 5 THEN '' ELSE 'No Such List' END"
_F = f"WITH f AS (SELECT 'F' || o_orderkey AS filename, {_V} AS variant, o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'OCCM' ELSE 'HT' END AS sheet_type FROM orders), r AS (SELECT f.*, l.* FROM f JOIN lineitem l ON l_orderkey = o_orderkey WHERE l_linestatus <> 'F')"

SQL = {
    "fact_build": f"""{_F} SELECT sheet_type, trim(variant) AS variant, CASE trim(variant) WHEN 'AMOS' THEN 'POS' WHEN 'OASES' THEN 'POSITION' WHEN 'Standard OCCM' THEN 'FIN' ELSE 'AMM_FIN' END AS position_source,
      CASE trim(variant) WHEN 'AMOS' THEN CAST(l_linenumber AS VARCHAR) WHEN 'OASES' THEN 'P' || l_linenumber WHEN 'Standard OCCM' THEN CAST(l_suppkey AS VARCHAR) ELSE l_suppkey || 'VU' END AS position,
      CASE WHEN variant = 'OASES' THEN l_returnflag ELSE '' END AS zone, CASE WHEN variant = 'Remaining Potentials' THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS kardex, CAST(l_partkey AS VARCHAR) AS part_number,
      CASE WHEN l_linenumber = 1 THEN '21-10' ELSE '24-00' END AS ata, count(*) AS rows FROM r WHERE o_orderkey % 7 < 4 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    "fact_families": """WITH f AS (SELECT o_orderkey, o_custkey % 2 = 0 AS occm, c_custkey IS NOT NULL AND o_orderkey % 3 = 0 AS over, c_custkey FROM orders LEFT JOIN customer ON c_custkey = o_orderkey)
      SELECT CASE WHEN over THEN 'A340' WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE 'A330' END AS family, CASE WHEN over THEN 'manual_review' WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'high' END AS family_confidence,
      CASE WHEN over AND c_custkey % 2 = 0 THEN '340-300' WHEN occm THEN '330' ELSE '' END AS model_raw, count(*) AS files FROM f GROUP BY 1, 2, 3""",
    "fact_unmapped": f"{_F} SELECT variant, count(*) AS files FROM f WHERE variant = 'No Such List' GROUP BY 1",
    "fact_without_rows": f"{_F} SELECT filename FROM f WHERE o_orderkey % 7 < 4 AND filename NOT IN (SELECT filename FROM r)",
    "file_buckets": f"{_F} SELECT sheet_type, trim(variant) AS variant, count(*) AS files FROM f WHERE trim(variant) NOT IN ('', 'Unknown', 'Timeout') GROUP BY 1, 2",
    "variant_rollup": f"""{_F}, n AS (SELECT filename, count(*) AS n, count(*) FILTER (l_quantity <= 25) AS c FROM r GROUP BY 1)
      SELECT variant, count(*) AS files_total, count(n) AS files_ok, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, CAST(coalesce(sum(c), 0) AS BIGINT) AS clean FROM f LEFT JOIN n USING (filename) GROUP BY 1""",
    "chapter_rows": f"{_F} SELECT variant, count(*) AS rows FROM r WHERE l_linenumber = 1 GROUP BY 1",
}
