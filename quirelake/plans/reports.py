"""Queries of reports: lost rows, clusters and their representatives, seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import detect, facts, similarity
from quirelake.plans import documents
from quirelake.sources.tables import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files that were read at a second level, or were not."""
    o = table(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    candidate = F.element_at(F.array(F.lit("True"), F.lit("False"), F.lit("n/a")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(text("o_orderkey").alias("filename"), F.col("o_orderstatus").alias("sheet_type"), F.col("o_orderpriority").alias("variant"), (F.col("o_custkey") % 5 - 1).cast("string").alias("l2_kept_rows"), (F.col("o_custkey") % 97).cast("string").alias("l2_dropped_rows"), candidate.alias("l2_candidate"))


def dropped_text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.dropped_text(_files(spark, sf_dir))


def worst_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: ten files of which most rows were lost."""
    return facts.worst_dropped(_files(spark, sf_dir)).select("filename", "l2_dropped_rows")


def sampled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: ten files, always the same."""
    return facts.seeded_sample(_files(spark, sf_dir), "filename").select("filename", "variant")


def dropped_row_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rows with text of an order's table were no data rows, by how many there are."""
    cell = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("a"), F.col("l_returnflag"))).otherwise(F.array(F.lit("row "), F.col("l_partkey").cast("string"), F.lit("PN-1")))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(cell).alias("cells"), F.count_if(F.col("l_linenumber") % 2 == 1).alias("kept"))
    told = li.select(detect.dropped_rows(F.col("cells"), F.col("kept")).alias("dropped"))
    return told.groupBy("dropped").agg(F.count("*").alias("tables"))


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and size as a cluster."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("leader"))
    return similarity.cluster_sizes(p)


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three benchmark texts of each fourth of them that are most like the others there."""
    b = table(spark, sf_dir, "benchmark")
    clusters = b.select("item_id", (F.col("item_id") % 4).alias("leader"))
    pairs = similarity.trigram_cosine(b, b, "item_id", "text").filter(F.col("a") % 4 == F.col("b") % 4)
    return similarity.representatives(pairs, clusters, "item_id").select("leader", "item_id", F.round("mean", 6).alias("mean"))


QUERIES = {f.__name__: f for f in (dropped_text_summary, worst_dropped, sampled_files, dropped_row_flags, cluster_stats, cluster_representatives)}

_FILES = "f AS (SELECT CAST(o_orderkey AS VARCHAR) AS filename, o_orderstatus AS sheet_type, o_orderpriority AS variant, o_custkey % 5 - 1 AS kept, o_custkey % 97 AS lost, ['True', 'False', 'n/a'][o_orderkey % 3 + 1] AS candidate FROM orders)"
_PAIRS = documents.SQL["trigram_similarity"].replace("x.item_id < y.item_id", "x.item_id <> y.item_id AND x.item_id % 4 = y.item_id % 4").replace("round(sum(x.n * y.n) / (any_value(p.norm) * any_value(q.norm)), 6)", "sum(x.n * y.n) / (any_value(p.norm) * any_value(q.norm))")
SQL = {
    "dropped_text_summary": f"WITH {_FILES} SELECT sheet_type, variant, count(*) AS checked, count(*) FILTER (candidate = 'True') AS flagged FROM f WHERE kept <> -1 AND candidate <> 'n/a' GROUP BY 1, 2",
    "worst_dropped": f"WITH {_FILES} SELECT filename, CAST(lost AS VARCHAR) AS l2_dropped_rows FROM f WHERE candidate = 'True' ORDER BY lost DESC, filename LIMIT 10",
    "sampled_files": f"WITH {_FILES} SELECT filename, variant FROM f ORDER BY md5('7|' || filename), filename LIMIT 10",
    "dropped_row_flags": """WITH t AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 3 <> 0 AND length('row ' || l_partkey || 'PN-1') >= 8) AS lines, count(*) FILTER (l_linenumber % 2 = 1) AS kept FROM lineitem GROUP BY 1)
      SELECT CASE WHEN lines - kept > 0 THEN 'True' ELSE 'False' END AS dropped, count(*) AS tables FROM t GROUP BY 1""",
    "cluster_stats": """WITH s AS (SELECT count(*) AS n FROM part GROUP BY p_brand, p_size), o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS no, count(*) OVER () AS k FROM s)
      SELECT count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, max(CASE WHEN no = k // 2 + 1 THEN n END) AS median FROM o""",
    "cluster_representatives": f"""WITH pairs AS ({_PAIRS}), c AS (SELECT item_id, item_id % 4 AS leader, count(*) OVER (PARTITION BY item_id % 4) AS k FROM benchmark),
      m AS (SELECT leader, item_id, coalesce((SELECT sum(cosine) FROM pairs WHERE a = item_id), 0) / greatest(k - 1, 1) AS mean FROM c)
      SELECT leader, item_id, round(mean, 6) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY leader ORDER BY m.mean DESC, item_id DESC) <= 3""",
}
