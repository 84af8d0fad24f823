"""Queries of layouts by tokens, metrics, words and switches: order lines printed in such forms and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.operators import forms, layout
from quirelake.sources.tables import spread, table

FITTED = forms.TokenLayout(
    name="fitted parts around the date of installation",
    anchor=("INSTALL_DATE", r"^\d{4}-\d{2}-\d{2}$"),
    first=(("POSITION", "^(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]{2,10}$"), ("PART_NUMBER", "-")),
    last=("SERIAL_NUMBER",),
    after=("TSN", "CSN"),
    skip="^Page ",
)
TIMES = forms.MetricLayout(
    name="components with their times",
    component=(r"^(\d{8}) (\S+) (\S+) (.+?) (\S+) (\d{4}-\d{2}-\d{2}) Days ", ("ATA", "POSITION", "PART_NUMBER", "DESCRIPTION", "SERIAL_NUMBER", "LAST_BATCH_MOVEMENT")),
    metrics=("Days", "Hours", "Landings"),
    bases=("SINCE_NEW", "SINCE_FIT", "SINCE_OVERHAUL", "SINCE_REPAIR"),
)
NUMBERED = layout.LineLayout(name="numbered rows", columns=("NO", "PART_NUMBER"), branches=((r"^(\d+) (PN-\d+)$", ("NO", "PART_NUMBER")),))
UNNUMBERED = layout.LineLayout(name="rows without numbers", columns=("PART_NUMBER",), branches=((r"^(?:\d+ )?(PN-\d+)$", ("PART_NUMBER",)),))
BANDS = forms.WordLayout(name="three columns", bands=(("ATA", 0, 50), ("PART_NUMBER", 50, 200), ("SERIAL_NUMBER", 200, 400)), row=("PART_NUMBER", "^PN-"))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _day() -> Column:
    return F.date_format("l_shipdate", "yyyy-MM-dd")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's rows, numbered anew: line numbers repeat."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return spread(spark, sf_dir, "lineitem", "l_orderkey").withColumn("row", F.row_number().over(w))


def _numbered(spark: SparkSession, sf_dir: str, *lines: Column) -> DataFrame:
    """Lines of an order: those given, for each of its rows."""
    li = _rows(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("row").alias("_row"), F.posexplode(F.array(*lines)).alias("_no", "line"))
    return li.select("doc_id", (F.col("_row") * 10 + F.col("_no")).cast("long").alias("line_no"), "line")


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("AB"), _text("l_linenumber"), F.lit(" "))).otherwise("")
    tail = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("  seen "), _text("l_returnflag"))).otherwise("")
    row = F.concat(position, F.lit("PN-"), _text("l_partkey"), F.lit(" fuel  pump SN"), _text("l_suppkey"), F.lit(" "), _day(), F.lit(" "), _text("l_orderkey"), F.lit(" "), _text("l_linenumber"), tail)
    return forms.token_rows(_numbered(spark, sf_dir, row, F.lit("Page 1 SN 2020-01-01 1 2"), F.concat(F.lit("no times "), _day())), FITTED)


def metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("24110000 P"), _text("l_linenumber"), F.lit(" PN-"), _text("l_partkey"), F.lit(" fuel pump "), _text("l_suppkey"), F.lit(" "), _day(), F.lit(" Days "), _text("l_linenumber"), F.lit(" ? 3 4"))
    hours = F.concat(F.lit("Hours "), _text("l_partkey"), F.lit(" 6 7 ?"))
    landings = F.when(F.col("l_linenumber") % 2 == 0, "Landings 1 2 3 4").otherwise("Landings 1 2")
    return forms.metric_rows(_numbered(spark, sf_dir, head, hours, landings), TIMES)


def layout_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("l_orderkey") % 2 == 0, "No. Part Number").otherwise("Part Number")
    row = F.concat(_text("l_linenumber"), F.lit(" PN-"), _text("l_partkey"))
    found = forms.switched(_numbered(spark, sf_dir, head, row), r"^No\. ", lambda x: layout.extract(x, NUMBERED), lambda x: layout.extract(x, UNNUMBERED))
    return found.select("doc_id", "line_no", F.coalesce("NO", F.lit("")).alias("NO"), "PART_NUMBER")


def word_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _rows(spark, sf_dir)
    word = lambda text, left, conf: F.struct(text.alias("text"), F.lit(left).alias("left"), conf.alias("conf"))
    sure, unsure = F.lit(90), F.when(F.col("l_linenumber") % 3 == 0, 30).otherwise(31)
    words = F.array(word(F.lit("24"), 10, sure), word(F.concat(F.lit("PN-"), _text("l_partkey")), 60, sure), word(F.lit("B"), 150, sure), word(_text("l_suppkey"), 250, unsure), word(F.lit("margin"), 500, sure))
    placed = li.select(F.col("l_orderkey").alias("page"), (F.col("row") * 40).alias("top"), F.lit(10).alias("height"), F.explode(words).alias("w")).select("page", "top", "height", "w.*")
    return forms.word_rows(placed, BANDS, ["page"]).select("page", "ATA", "PART_NUMBER", "SERIAL_NUMBER")


def glued_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "dd-MM-yyyy")
    line = F.concat(F.lit("2400 P1 x "), day, F.when(F.col("l_linenumber") % 2 == 0, "CLEANING").otherwise(""), F.lit(" 10 "), day)
    found = li.select(forms.date_and_task(line).alias("f"), forms.is_position_code(F.concat("l_returnflag", _text("l_linenumber"))).alias("code"))
    return found.groupBy(F.col("f.date").alias("date"), F.col("f.task").alias("task")).agg(F.count("*").alias("rows"), F.count_if("code").alias("codes"))


QUERIES = {f.__name__: f for f in (token_rows, metric_matrix, layout_switch, word_layout, glued_tasks)}

_DAY = "strftime(l_shipdate, '%Y-%m-%d')"
_L = '(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS "row" FROM lineitem)'
_T = "CAST({} AS VARCHAR)".format

SQL = {
    "token_rows": f"""SELECT l_orderkey AS doc_id, CAST("row" * 10 AS BIGINT) AS line_no, CASE WHEN l_linenumber % 2 = 0 THEN 'AB' || l_linenumber ELSE '' END AS "POSITION", 'PN-' || l_partkey AS "PART_NUMBER",
      'fuel pump' AS "DESCRIPTION", 'SN' || l_suppkey AS "SERIAL_NUMBER", {_DAY} AS "INSTALL_DATE", {_T("l_orderkey")} AS "TSN", {_T("l_linenumber")} AS "CSN",
      CASE WHEN l_linenumber % 3 = 0 THEN 'seen ' || l_returnflag ELSE '' END AS "STATUS_TRAIL" FROM {_L}""",
    "metric_matrix": f"""SELECT l_orderkey AS doc_id, CAST("row" * 10 AS BIGINT) AS line_no, '24110000' AS "ATA", 'P' || l_linenumber AS "POSITION", 'PN-' || l_partkey AS "PART_NUMBER", 'fuel pump' AS "DESCRIPTION",
      {_T("l_suppkey")} AS "SERIAL_NUMBER", {_DAY} AS "LAST_BATCH_MOVEMENT", {_T("l_linenumber")} AS "DAYS_SINCE_NEW", '' AS "DAYS_SINCE_FIT", '3' AS "DAYS_SINCE_OVERHAUL", '4' AS "DAYS_SINCE_REPAIR",
      {_T("l_partkey")} AS "HOURS_SINCE_NEW", '6' AS "HOURS_SINCE_FIT", '7' AS "HOURS_SINCE_OVERHAUL", '' AS "HOURS_SINCE_REPAIR",
      {", ".join(f"CASE WHEN l_linenumber % 2 = 0 THEN '{i}' ELSE '' END" + f' AS "LANDINGS_{b}"' for i, b in enumerate(TIMES.bases, 1))} FROM {_L}""",
    "layout_switch": f"""SELECT l_orderkey AS doc_id, CAST("row" * 10 + 1 AS BIGINT) AS line_no, CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END AS "NO", 'PN-' || l_partkey AS "PART_NUMBER" FROM {_L}""",
    "word_layout": """SELECT l_orderkey AS page, '24' AS "ATA", 'PN-' || l_partkey || ' B' AS "PART_NUMBER", CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS "SERIAL_NUMBER" FROM lineitem""",
    "glued_tasks": """SELECT strftime(l_shipdate, '%d-%m-%Y') AS date, CASE WHEN l_linenumber % 2 = 0 THEN 'CLEANING' ELSE '' END AS task, count(*) AS rows, count(*) AS codes FROM lineitem GROUP BY 1, 2""",
}
