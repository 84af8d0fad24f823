"""The analytic fact of component positions, here projected from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A position's total order: by date, then these columns, of which no two rows share all.
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files whose rows one task sorts: lines and words made of them take some fifty times as much.
PART = 4 << 20


def spread(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table dealt by keys into parts whose number follows the size of its files, so that no task's share grows with it."""
    size = spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet").agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    return table(spark, sf_dir, name).repartition(parts, *keys)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for each order line: sheet, aircraft, slot, family, dates and part, some of them blank."""
    t = lambda n: table(spark, sf_dir, n)
    rows = (
        t("lineitem")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    )
    ht = F.col("l_returnflag") == "R"
    return rows.select(
        *TIE,
        F.when(ht, "HT").otherwise("OCCM").alias("sheet_type"),
        (F.col("o_custkey") % 200).cast("string").alias("aircraft_key"),
        F.when(F.col("l_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string"))).alias("position"),
        F.when(ht & (F.col("l_orderkey") % 3 == 0), "Unknown").otherwise(F.col("n_name")).alias("family"),
        F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("report_date_iso"),
        F.col("p_brand").alias("part_number"),
        F.col("p_name").alias("description"),
        F.lpad((F.col("l_suppkey") % 64 + 20).cast("string"), 2, "0").alias("ata"),
        F.concat(F.lit("S"), (F.col("l_orderkey") % 50).cast("string")).alias("source_file"),
        F.when(F.col("o_custkey") % 5 == 0, "msn_guess").when(F.col("o_custkey") % 5 == 1, "filename").otherwise("msn").alias("aircraft_key_source"),
    )


POSITIONS_SQL = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
    CASE WHEN l_returnflag = 'R' THEN 'HT' ELSE 'OCCM' END AS sheet_type, CAST(o_custkey % 200 AS VARCHAR) AS aircraft_key,
    CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE 'P' || (l_partkey % 40) END AS position,
    CASE WHEN l_returnflag = 'R' AND l_orderkey % 3 = 0 THEN 'Unknown' ELSE n_name END AS family,
    CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS report_date_iso,
    p_brand AS part_number, p_name AS description, lpad(CAST(l_suppkey % 64 + 20 AS VARCHAR), 2, '0') AS ata, 'S' || (l_orderkey % 50) AS source_file,
    CASE o_custkey % 5 WHEN 0 THEN 'msn_guess' WHEN 1 THEN 'filename' ELSE 'msn' END AS aircraft_key_source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
"""
