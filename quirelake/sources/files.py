"""Reading documents and tables of text. All cells are text; what is missing is the empty string."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.functions.text import blank, strip


def scan_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, filename, size_kb, status, content) of files at any depth, whatever the suffix's case.

    An empty file is a placeholder, not an error. Spark's reader passes these over, so they come from a listing.
    """
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    found = files.select("path", "length", "content")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing, empty = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while listing.hasNext():
        f = listing.next()
        if not f.getLen() and f.getPath().getName().lower().endswith(f".{suffix.lower()}"):
            empty.append((f.getPath().toString(), 0, b""))
    if empty:
        found = found.unionByName(spark.createDataFrame(empty, "path string, length long, content binary"))
    status = F.when(F.col("length") == 0, "NotDownloaded").otherwise("ok")
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.floor(F.col("length") / 1024).cast("int").alias("size_kb"), status.alias("status"), "content")


def read_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text): the pages that reader gives of each file's content; a file it can't read has none, page 0.

    reader is any function of bytes, such as one around a PDF or OCR library; it runs on the executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages = reader(bytes(content))
                except Exception as e:  # one broken file must not end the scan; its row says so
                    rows.append((path, 0, "", f"{type(e).__name__}: {e}"[:200]))
                    continue
                rows += [(path, i, text or "", "") for i, text in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A CSV or TSV with a header, NUL bytes taken out, every cell text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    table = spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=True, encoding="UTF-8", enforceSchema=False)
    return table.select(*[F.replace(blank(F.col(f"`{c}`")), F.lit("\u0000"), F.lit("")).alias(c) for c in columns])


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, value, label) of a JSON object of two-element arrays."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("source_file", "pair")).select("source_file", F.get("pair", 0).alias("value"), F.get("pair", 1).alias("label"))


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return df.select(key, F.posexplode(F.split(blank(F.col(text)), "\n")).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def head_text(pages: DataFrame, key: str, upto: int = 3) -> DataFrame:
    """The first pages of each document, joined by line feeds: at most `upto` pages meet, whatever the document's length."""
    few = pages.filter(F.col("page") <= upto).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return few.select(key, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("head"))


def header_pages(pages: DataFrame, key: str, most_pages: int = 2, enough: int = 1500) -> DataFrame:
    """The pages of a header: further ones only while those before have `enough` characters or fewer."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.filter(F.col("page") <= most_pages).withColumn("_before", before).filter(F.col("_before") <= enough).drop("_before")


def page_classes(pages: DataFrame, key: str) -> DataFrame:
    """(key, pages, text_pages, scanned_pages): more than 1000 characters is text, fewer than 200 a scan."""
    n = F.length(blank(F.col("text")))
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(n > 1000).alias("text_pages"), F.count_if(n < 200).alias("scanned_pages"))


def cells(html: Column, tag: str) -> Column:
    """The contents of a page's elements of a tag, markup taken out and blanks stripped."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(inner, lambda x: strip(F.regexp_replace(x, "<[^>]*>", "")))


def table_rows(rows: Column, columns: list[str], gate: tuple[str, str] = (r"^\d{2}$", r"^\d{2,3}$")) -> Column:
    """Of an array of cell arrays, the data rows as maps of columns: both gate cells match; cells are padded or cut."""
    is_row = F.filter(rows, lambda r: F.coalesce(F.get(r, 0), F.lit("")).rlike(gate[0]) & F.coalesce(F.get(r, 1), F.lit("")).rlike(gate[1]))
    names = F.array(*[F.lit(c) for c in columns])
    return F.transform(is_row, lambda r: F.map_from_arrays(names, F.slice(F.concat(r, F.array_repeat(F.lit(""), len(columns))), 1, len(columns))))
