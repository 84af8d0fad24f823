"""Queries of intervals, hints and formats called from SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import hints, intervals
from quirelake.plans import catalogue
from quirelake.sources import table_functions
from quirelake.sources.tables import table

AS_OF = "2024-03-01 00:00:00"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's changes as events of its segment: set by inserts and updates, gone by deletes; late ones among them."""
    changes = table(spark, sf_dir, "client_changes")
    return intervals.intervals(changes, ["client_id"], "segment", "valid_at", F.col("op").isin("I", "U"), F.col("op") == "D", ["seq", "change_id"])


def valid_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = intervals.as_of(_segments(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"))
    return held.groupBy("item").agg(F.count("*").alias("intervals"), F.count_if("overlaps").alias("overlapping"))


_FILES = ("VH-ABC", "B-2345", "N-123A", "X1", "VP-BDK")
_NAMES = (" China Eastern", " eastern list", "_aeroflot", " MSN 77", " vna", "")
_TEXTS = ("volaris fleet", "", "AEROFLOT", "Vietnam")


def _pick(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values) + 1).cast("int"))


def operator_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumns({"file": F.concat(_pick(_FILES), _pick(_NAMES), F.lit(".pdf")), "text": _pick(_TEXTS)})
    return c.select("c_custkey", hints.operator_hint(F.col("file"), F.col("text")).alias("hint"))


def format_from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one format, by its predicate and its table function, both called from SQL."""
    table_functions.register(spark)
    docs = catalogue.printed(spark, sf_dir)
    docs.createOrReplaceTempView("quirelake_printed")
    found = spark.sql("""
      SELECT * FROM read_format(TABLE(
        SELECT doc_id, CAST(1 AS BIGINT) AS line_no, text AS line FROM quirelake_printed WHERE is_format(text, 'AMOS')
      ) PARTITION BY (doc_id) ORDER BY (line_no), 'AMOS')""")
    return found.select("doc_id", "line_no", F.concat_ws("|", *[F.col(c) for c in found.columns[2:]]).alias("cells"))


QUERIES = {f.__name__: f for f in (valid_intervals, state_as_of, operator_hints, format_from_sql)}

_SPANS = """e AS (SELECT DISTINCT client_id, segment AS item, valid_at AS at_, CASE WHEN op IN ('I', 'U') THEN 1 ELSE 0 END AS kind, seq, change_id FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL AND op IN ('I', 'U', 'D')),
  n AS (SELECT *, lead(at_) OVER w AS next_at, lead(kind) OVER w AS next_kind, coalesce(lag(kind) OVER w, 0) AS last_kind FROM e WINDOW w AS (PARTITION BY client_id, item ORDER BY at_, kind, seq, change_id)),
  s AS (SELECT row_number() OVER () AS no, client_id, item, CASE WHEN kind = 1 THEN at_ END AS valid_from, CASE WHEN kind = 0 THEN at_ ELSE next_at END AS valid_to,
    CASE WHEN kind = 0 THEN 'no_install' WHEN next_at IS NULL THEN 'open' WHEN next_kind = 1 THEN 'no_removal' ELSE 'closed' END AS state FROM n WHERE kind = 1 OR last_kind = 0),
  r AS (SELECT * FROM s WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)),
  o AS (SELECT DISTINCT a.no FROM r a JOIN r b ON a.client_id = b.client_id AND a.no <> b.no AND (b.valid_to IS NULL OR b.valid_to > a.valid_from) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)),
  i AS (SELECT client_id, item, valid_from, valid_to, state, o.no IS NOT NULL AS "overlaps" FROM s LEFT JOIN o USING (no))"""


def _sql_pick(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][c_custkey % {len(values)} + 1]"


def _sql_named(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(upper({c}), '{w}') THEN '{n}' END" for w, n in hints.NAME_HINTS if n) + "], lambda x: x IS NOT NULL)"


_USED = ("VH", "B", "N", "VP")
SQL = {
    "valid_intervals": f"WITH {_SPANS} SELECT * FROM i",
    "state_as_of": f"""WITH {_SPANS} SELECT item, count(*) AS intervals, count(*) FILTER ("overlaps") AS overlapping FROM i
      WHERE valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}') GROUP BY item""",
    "operator_hints": f"""WITH c AS (SELECT c_custkey, {_sql_pick(_FILES)} || {_sql_pick(_NAMES)} || '.pdf' AS file, {_sql_pick(_TEXTS)} AS text FROM customer),
      p AS (SELECT *, regexp_extract(file, '\\b([A-Z]{{1,2}})-?([A-Z0-9]{{3,4}})\\b', 1) AS prefix FROM c), h AS (SELECT c_custkey, list_concat(list_concat({_sql_named('file')}, CASE prefix {" ".join(f"WHEN '{k}' THEN ['reg:{k}={hints.COUNTRIES[k]}']" for k in _USED)} ELSE []::VARCHAR[] END), {_sql_named('text')}) AS hits FROM p)
      SELECT c_custkey, array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i), ' · ') AS hint FROM h""",
    "format_from_sql": f"SELECT doc_id, line_no, cells FROM ({catalogue.SQL['format_records']}) WHERE variant = 'AMOS'",
}
