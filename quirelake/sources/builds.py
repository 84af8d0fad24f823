"""Builds of several tables that show all at once: staged versions, one pointer, views bound to what it points to."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


@dataclass(frozen=True)
class Build:
    """Tables under one root. A build writes them all into a version's folder of its own and then swaps the pointer, by
    one rename; a build that fails or dies before leaves the pointer, and so every reader, where they were.

    A reader that has taken a version keeps it while it lasts: `expire` deletes only what the pointer has left behind,
    the newest `keep` versions excepted, and leftovers of builds that died.
    """

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _text(self, path: str) -> str | None:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def current(self) -> dict | None:
        """The pointer: version, its tables, and the version before it; null before the first build."""
        text = self._text(f"{self.root}/{POINTER}")
        return json.loads(text) if text else None

    @contextmanager
    def version(self) -> Iterator[Callable[[str, DataFrame], None]]:
        """with build.version() as put: put(name, df) ...: all tables, or none of them."""
        name, tables = f"v-{uuid.uuid4().hex}", []
        before = self.current()

        def put(table: str, df: DataFrame) -> None:
            df.write.mode("errorifexists").parquet(f"{self.root}/{name}/{table}")
            tables.append(table)

        yield put
        self._swap({"version": name, "tables": tables, "number": (before or {}).get("number", 0) + 1})

    def _swap(self, pointer: dict) -> None:
        staged = f"{self.root}/_{POINTER}-{uuid.uuid4().hex}"
        fs, at = self._fs(staged)
        out = fs.create(at, False)
        out.write(json.dumps(pointer).encode())
        out.close()
        jvm = self.spark._jvm
        rename = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        rename[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(at, jvm.org.apache.hadoop.fs.Path(f"{self.root}/{POINTER}"), rename)

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """A table of the version pointed to now, or of one taken before."""
        return self.spark.read.parquet(f"{self.root}/{version or self.current()['version']}/{table}")

    def views(self, queries: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] | None = None, prefix: str = "") -> str:
        """Temporary views of all tables and of queries over them, bound to one version, which is returned."""
        now = self.current()
        for table in now["tables"]:
            self.read(table, now["version"]).createOrReplaceTempView(f"{prefix}{table}")
        for name, query in (queries or {}).items():
            query(lambda t: self.read(t, now["version"])).createOrReplaceTempView(f"{prefix}{name}")
        return now["version"]

    def expire(self, keep: int = 1) -> list[str]:
        """Deletes versions that are neither pointed to nor of the newest `keep` others; gives their names."""
        now = self.current()
        fs, at = self._fs(self.root)
        found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v-")), reverse=True)
        gone = [name for _, name in found if not now or name != now["version"]][keep:]
        for name in gone:
            fs.delete(self._fs(f"{self.root}/{name}")[1], True)
        return gone


#: Files that one write's counters tell apart, at most: each has its own numbers in the write's metrics.
MOST_FILES = 1000


def written_with_counts(df: DataFrame, path: str, file: str, files: list[str], counts: dict[str, Column]) -> list[dict]:
    """Writes df and counts, for each of the files its rows are of, how many meet each condition, in the pass that writes.

    A row a file, in the order given, and one for all other files (file is null); no second scan, no second job. The
    numbers are observed metrics of the write itself. More than MOST_FILES files are an error: count them by a query.
    """
    if len(files) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    own = [*[F.col(file).eqNullSafe(F.lit(f)) for f in files], F.col(file).isNull() | ~F.col(file).isin(files) if files else F.lit(True)]
    conditions = {"rows": F.lit(True)} | counts
    seen = Observation()
    metrics = [F.count(F.when(is_own & c, 1)).alias(f"{i}_{j}") for i, is_own in enumerate(own) for j, c in enumerate(conditions.values())]
    df.observe(seen, *metrics).write.mode("overwrite").parquet(path)
    got = seen.get
    return [{"file": f, **{name: got[f"{i}_{j}"] for j, name in enumerate(conditions)}} for i, f in enumerate([*files, None])]


#: Characters that a text must have for a second reader to be tried.
READABLE = 50


def read_with_fallback(contents: DataFrame, first: Callable[[bytes], str], second: Callable[[bytes], str], route: Callable[[DataFrame], DataFrame], staged: str) -> DataFrame:
    """(path, text, reader, sheet_type, variant, diagnosis) of contents (path, content).

    The second reader sees only documents that the first one's text leaves Unknown with READABLE characters and more;
    where its text routes no better, the first one's stays. The first pass is written at `staged`: neither reader runs
    twice, and none runs inside a condition, where Spark would run it for all rows. A reader's error is an empty text;
    null contents are an empty text.
    """
    spark = contents.sparkSession

    def reading(read: Callable[[bytes], str]):
        def run(batches):
            for batch in batches:
                texts = []
                for c in batch["content"]:
                    try:
                        texts.append(read(bytes(c)) if c is not None else "")
                    except Exception:  # a broken file is a file without text
                        texts.append("")
                batch["text"] = texts
                yield batch[["path", "text"]]

        return run

    route(contents.select("path", "content").mapInPandas(reading(first), "path string, text string")).write.mode("overwrite").parquet(staged)
    done = spark.read.parquet(staged)
    again = (F.col("sheet_type") == "Unknown") & (F.length(F.trim("text")) >= READABLE)
    unknown = contents.select("path", "content").join(done.filter(again).select("path"), "path", "left_semi")
    better = route(unknown.mapInPandas(reading(second), "path string, text string")).filter("sheet_type <> 'Unknown'")
    named = lambda df, who: df.select("path", "text", F.lit(who).alias("reader"), "sheet_type", "variant", "diagnosis")
    columns = ("text", "reader", "sheet_type", "variant", "diagnosis")
    found = named(better, "second").select("path", F.struct(*columns).alias("_b"))
    both = named(done, "first").join(found, "path", "left")
    return both.select("path", *[F.when(F.col("_b").isNull(), F.col(c)).otherwise(F.col(f"_b.{c}")).alias(c) for c in columns])
