"""Queries of tables from word boxes: orders set as pages of words and rules, and read back; the SQL reads the same boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import grids
from quirelake.plans.forms import _rows

ANCHORED = grids.AnchorLayout(
    left=("ATA", "ZONE", "FIN", "DESCRIPTION"), right=(("VENDOR_CODE", "VENDOR"), ("PART_NUMBER", "PART"), ("SERIAL_NUMBER", "SERIAL")),
    row=(r"^\d{2}$", r"^\d{2,3}$"), optional=(("FIN", "^[A-Za-z0-9]{2,8}$"),),
)
#: Words of a row: text, place, when it is there; over the rows of an order, in SQL that both engines read.
_WORDS = (
    ("CAST(l_partkey % 64 + 20 AS STRING)", "20", "true"),
    ("CAST(l_suppkey % 900 + 100 AS STRING)", "80", "true"),
    ("concat('X', CAST(l_partkey % 90 + 10 AS STRING))", "140", "row % 2 = 0"),
    ("'(fuel)'", "220", "true"),
    ("'pump'", "300", "true"),
    ("concat('V', CAST(l_suppkey AS STRING))", "500 + l_suppkey % 60 - 20", "row % 4 <> 1"),
    ("concat('P', CAST(l_partkey AS STRING))", "700 + l_partkey % 60 - 20", "true"),
    ("concat('S', CAST(l_orderkey AS STRING))", "900 + l_orderkey % 60 - 20", "row % 5 <> 2"),
)
_HEAD = (("'Vendor:'", "500", "l_orderkey % 5 <> 0"), ("'PART'", "700", "true"), ("'SERIAL'", "900", "true"))
_SHIFT = "l_orderkey % 7 * 5"


def _boxes(words: tuple, top: str) -> str:
    one = [f"SELECT l_orderkey AS doc, {t} AS text, CAST({x} + {_SHIFT} AS DOUBLE) AS x, CAST({top} AS DOUBLE) AS top, CAST(40 AS DOUBLE) AS width, CAST(20 AS DOUBLE) AS height FROM rows WHERE {when}" for t, x, when in words]
    return " UNION ALL ".join(one)


def anchored_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pages whose columns are shifted, with or without a vendor's."""
    rows = _rows(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "row")
    heads = rows.filter("row = 1")
    words = _by_sql(rows, _WORDS, "20 + 40 * row").unionByName(_by_sql(heads, _HEAD, "10"))
    return grids.anchored_rows(words, ANCHORED, "doc", ["doc"]).withColumn("row", F.col("row").cast("long")).drop("loose")


def _by_sql(rows: DataFrame, words: tuple, top: str) -> DataFrame:
    box = [F.when(F.expr(when), F.struct(F.expr(t).alias("text"), F.expr(f"CAST({x} + {_SHIFT} AS DOUBLE)").alias("left"))) for t, x, when in words]
    each = rows.select(F.col("l_orderkey").alias("doc"), F.expr(f"CAST({top} AS DOUBLE)").alias("top"), F.explode(F.array_compact(F.array(*box))).alias("b"))
    return each.select("doc", "b.text", "b.left", "top", F.lit(40.0).alias("width"), F.lit(20.0).alias("height"))


def ruled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of pages ruled in three columns, of which every third row leaves a rule out."""
    rows = _rows(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "row")
    words = [("A", "l_partkey", 20.0), ("P", "l_suppkey", 120.0), ("S", "l_orderkey", 220.0)]
    box = F.explode(F.array(*[F.struct(F.concat(F.lit(a), F.col(c).cast("string")).alias("text"), F.lit(x).alias("left")) for a, c, x in words])).alias("b")
    boxes = rows.select(F.col("l_orderkey").alias("page"), (F.col("row") * 40 - 30).cast("double").alias("top"), box).select("page", "b.text", "b.left", "top", F.lit(40.0).alias("width"), F.lit(10.0).alias("height"))
    top, bottom = (F.col("row") * 40 - 40).cast("double"), (F.col("row") * 40).cast("double")
    rule = lambda kind, at, a, b: F.struct(F.lit(kind).alias("kind"), at.alias("at"), a.alias("start"), b.alias("stop"))
    upright = [F.when((F.col("row") % 3 != 0) | (F.lit(x) != 100.0), rule("v", F.lit(x), top, bottom)) for x in (0.0, 100.0, 200.0, 300.0)]
    level = [rule("h", at, F.lit(0.0), F.lit(300.0)) for at in (top, bottom)]
    rules = rows.select(F.col("l_orderkey").alias("page"), F.explode(F.array_compact(F.array(*upright, *level))).alias("r")).select("page", "r.*")
    cells = grids.grid_cells(boxes, rules, ["page"])
    return cells.select(F.col("page").alias("l_orderkey"), *[F.col(c).cast("long").alias(c) for c in ("row", "col", "row_span", "col_span")], "text")


QUERIES = {f.__name__: f for f in (anchored_columns, ruled_cells)}

_NUMBERED = "rows AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS row FROM lineitem)"
SQL = {
    "anchored_columns": f"""WITH {_NUMBERED}, w AS ({_boxes(_WORDS, '20 + 40 * row').replace('l_orderkey AS doc', 'l_orderkey AS doc, row')}), h AS ({_boxes(tuple((t, x, f'row = 1 AND {when}') for t, x, when in _HEAD), '10')}),
      a AS (SELECT doc, rtrim(upper(text), ':') AS token, x AS spot, min(x) OVER (PARTITION BY doc) - 50 AS cut FROM h), c AS (SELECT DISTINCT doc, cut FROM a),
      l AS (SELECT w.*, row_number() OVER (PARTITION BY w.doc, row ORDER BY x) AS no FROM w JOIN c ON w.doc = c.doc AND w.x < cut),
      n AS (SELECT w.doc, row, text, x, arg_min(token, struct_pack(d := abs(x + width / 2 - spot), spot := spot)) AS token FROM w JOIN a ON w.doc = a.doc AND w.x >= cut GROUP BY w.doc, row, text, x, width),
      f AS (SELECT doc, row, max(text) FILTER (no = 1) AS ata, max(text) FILTER (no = 2) AS zone, max(CASE WHEN no = 3 AND regexp_full_match(text, '[A-Za-z0-9]{{2,8}}') THEN text ELSE '' END) FILTER (no = 3) AS fin FROM l GROUP BY 1, 2),
      r AS (SELECT doc, row, {", ".join(f"coalesce(string_agg(text, ' ' ORDER BY x) FILTER (token = '{t}'), '') AS {t.lower()}" for t in ("VENDOR", "PART", "SERIAL"))} FROM n GROUP BY 1, 2)
      SELECT f.doc, f.row, f.ata AS "ATA", f.zone AS "ZONE", f.fin AS "FIN", (SELECT string_agg(text, ' ' ORDER BY x) FROM l WHERE l.doc = f.doc AND l.row = f.row AND l.no > CASE WHEN f.fin = '' THEN 2 ELSE 3 END) AS "DESCRIPTION",
        coalesce(vendor, '') AS "VENDOR_CODE", coalesce(part, '') AS "PART_NUMBER", coalesce(serial, '') AS "SERIAL_NUMBER" FROM f LEFT JOIN r ON f.doc = r.doc AND f.row = r.row""",
    "ruled_cells": f"""WITH {_NUMBERED}, b AS (SELECT l_orderkey AS page, unnest([{{'text': 'A' || l_partkey, 'x': 40}}, {{'text': 'P' || l_suppkey, 'x': 140}}, {{'text': 'S' || l_orderkey, 'x': 240}}]) AS b, row * 40 - 25 AS y FROM rows),
      v AS (SELECT l_orderkey AS page, unnest(CASE WHEN row % 3 = 0 THEN [0, 200, 300] ELSE [0, 100, 200, 300] END) AS spot, row * 40 - 40 AS a, row * 40 AS b FROM rows),
      c AS (SELECT b.page, CAST(floor(y / 40) AS BIGINT) AS row, b.b.text AS text, b.b.x AS x, max(spot) FILTER (spot <= b.b.x) AS low, min(spot) FILTER (spot > b.b.x) AS high FROM b JOIN v ON v.page = b.page AND v.a <= y AND v.b > y GROUP BY 1, 2, 3, 4)
      SELECT page AS l_orderkey, row, CAST(low / 100 AS BIGINT) AS col, CAST(1 AS BIGINT) AS row_span, CAST((high - low) / 100 AS BIGINT) AS col_span, string_agg(text, ' ' ORDER BY x) AS text FROM c GROUP BY page, row, low, high""",
}
