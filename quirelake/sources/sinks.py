"""Writing results: partitioned text tables, append-only logs, and small reports put together by the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import blank

# Known columns in the order they are shown, by sheet.
COLUMN_ORDER = {
    "OCCM": ["ATA", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "POSITION", "FIN", "INSTALL_DATE", "REMARKS"],
    "HT": ["ATA", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "POSITION", "FIN", "MPD_TASK", "INTERVAL", "LAST_DONE_DATE", "NEXT_DUE_DATE", "REMAINING"],
    "LLP": ["ATA", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "POSITION", "CYCLES_LIMIT", "CYCLES_TSN", "CYCLES_REMAINING"],
}


def canonical_order(columns: Sequence[str], sheet: str) -> list[str]:
    """Known columns first, then others as they stood, internal ones last."""
    known = [c for c in COLUMN_ORDER.get(sheet, []) if c in columns]
    return known + [c for c in columns if c not in known and not c.startswith("_")] + [c for c in columns if c.startswith("_")]


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as text, null as the empty one."""
    return df.select(*[blank(F.col(f"`{c}`")).alias(c) for c in df.columns])


def write_by_file(df: DataFrame, path: str, sheet: str, file_column: str = "source_file") -> None:
    """A folder of CSV for each source file, columns in the sheet's order: one write for all, whatever their number.

    Rows are dealt by file first, a hot one's split over several tasks by adaptive execution, so that files are few.
    """
    ordered = df.select(*[F.col(f"`{c}`") for c in canonical_order(df.columns, sheet)])
    as_text(ordered).hint("rebalance", F.col(file_column)).write.mode("overwrite").partitionBy(file_column).csv(path, header=True, emptyValue="")


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log; earlier ones are never touched."""
    df.write.mode("append").parquet(path)


def write_table(df: DataFrame, name: str, by: str = "sheet_type") -> None:
    """The fact as a managed table, pruned by sheet."""
    df.write.mode("overwrite").partitionBy(by).saveAsTable(name)


def csv_cell(c: Column) -> Column:
    """A cell quoted only where it has a quote, comma or line feed."""
    text = blank(c)
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def rollup_json(df: DataFrame, key: str, sample: int = 8) -> DataFrame:
    """(key, value): of each key its rows' number and the first of them, as JSON; rows are ranked, not gathered."""
    from pyspark.sql import Window

    columns = [c for c in df.columns if c != key][:8]
    w = Window.partitionBy(key)
    few = df.withColumns({"_no": F.row_number().over(w.orderBy(*columns)), "_n": F.count("*").over(w)}).filter(F.col("_no") <= sample)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_no", F.struct(*columns).alias("r")))), lambda x: x["r"])
    return few.groupBy(key).agg(F.to_json(F.struct(F.max("_n").alias("rows"), rows.alias("sample"))).alias("value"))


def result_envelope(df: DataFrame, sheet_type: str, variant: str, most: int = 10_000) -> str:
    """One document's result for a caller: columns, rows and counts. A document's rows are few; more are an error."""
    rows = as_text(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them instead")
    flagged = sum(bool(r["_issues"]) for r in rows) if "_issues" in df.columns else 0
    summary = {"total": len(rows), "clean": len(rows) - flagged, "flagged": flagged, "imputed": sum("_imputed:" in r["_issues"] for r in rows) if "_issues" in df.columns else 0}
    columns = canonical_order(df.columns, sheet_type)
    return json.dumps({"ok": True, "sheet_type": sheet_type, "variant": variant, "columns": columns, "rows": [{c: r[c] for c in columns} for r in rows], "summary": summary}, ensure_ascii=False)
