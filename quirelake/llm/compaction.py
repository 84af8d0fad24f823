"""Sharded storage with size-tiered compaction.

An arrival is appended as small immutable shards, as its tasks wrote them. Shards of similar size, those of one tier,
are merged, FAN to MOST at a time, into one of at most the target size, tier by tier; a shard of half the target and
more is left alone. No merge shuffles: a merged shard is the concatenation of its inputs by one task.

What the store holds is the newest manifest: a file that lists the shards, created under the next version only where
none is there, which one of several writers can do; its last line says that it is whole. A reader sees one version or
the next; a writer that finds its version taken reads anew and tries again, and a compaction drops those of its merges
whose inputs another one has merged; a job that dies leaves files that no manifest names. Shards that a commit drops
are deleted after it, unless older versions are to stay readable: readers of these then fail and start anew.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import fresh_path, hadoop_fs

TARGET = 128 << 20
#: Shards of up to so many bytes are of tier 0; each tier is FAN times as large.
SMALLEST = 1 << 20
FAN = 4
#: Shards of one merge at most.
MOST = 32
#: Seconds after which a manifest that is not whole is taken for that of a writer that has died.
DEAD = 600
#: What a whole manifest ends in.
WHOLE = "\nwhole\n"
#: Merges of one Spark job.
AT_ONCE = 64


@dataclass(frozen=True)
class Shard:
    name: str
    size: int
    first: int  # the arrivals that it holds rows of
    last: int


def tier(size: int) -> int:
    return 0 if size <= SMALLEST else math.ceil(math.log(size / SMALLEST, FAN) - 1e-9)


def merges(shards: list[Shard], target: int, fan: int = FAN) -> list[list[Shard]]:
    """Runs to merge now: of each tier, in order of arrival, fan to MOST shards of at most target together."""
    out: list[list[Shard]] = []
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if 2 * s.size < target:
            tiers.setdefault(tier(s.size), []).append(s)
    for _, own in sorted(tiers.items()):
        run: list[Shard] = []
        for s in sorted(own, key=lambda s: (s.first, s.name)):
            if run and (len(run) == MOST or sum(x.size for x in run) + s.size > target):
                out.append(run)
                run = []
            run.append(s)
        if len(run) >= fan:
            out.append(run)
    return [r for r in out if len(r) > 1]


class ShardStore:
    """Rows of one schema in a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target

    # manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}.json"

    def _versions(self) -> list[int]:
        fs, at = hadoop_fs(self.spark, f"{self.root}/manifests")
        return sorted(int(f.getPath().getName()[1:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _text(self, version: int) -> str | None:
        """A whole manifest's text; None while it is being written."""
        rows = self.spark.read.text(self._manifest(version), wholetext=True).collect()
        text = rows[0][0] if rows else ""
        return text.removesuffix(WHOLE) if text.endswith(WHOLE) else None

    def version(self) -> int:
        """The newest whole version; 0 before the first commit."""
        return next((v for v in reversed(self._versions()) if self._text(v) is not None), 0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        return [Shard(**s) for s in json.loads(self._text(version) or "")["shards"]]

    def _placed(self, path: str, text: bytes) -> bool:
        """Puts a whole file in place, by one step that fails where there is one: a link on local file systems, elsewhere a
        rename without overwriting, which HDFS does in one step."""
        fs, at = hadoop_fs(self.spark, path)
        _, staged = hadoop_fs(self.spark, f"{self.root}/staged-{uuid.uuid4().hex}")
        fs.mkdirs(at.getParent())
        out = fs.create(staged, False)
        try:
            out.write(bytearray(text))
        finally:
            out.close()
        try:
            if fs.getScheme() == "file":
                os.link(staged.toUri().getPath(), at.toUri().getPath())
            else:
                jvm = self.spark._jvm
                none = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, at, none)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            fs.delete(staged, False)
        return True

    def commit(self, base: int, shards: list[Shard]) -> bool:
        """Makes shards the version after base; False if another writer has made one.

        Manifests appear whole, in one step. One that is not whole is of another writer that died; the one writer that can
        place a mark beside it takes it away, and looks again before it does. The mark stays, so no version's manifest
        is ever taken away twice. A store whose rename is no single step must not have two writers.
        """
        manifest = self._manifest(base + 1)
        fs, at = hadoop_fs(self.spark, manifest)
        if fs.exists(at) and self._text(base + 1) is None and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > DEAD:
            if self._placed(f"{manifest}.dead", b"") and self._text(base + 1) is None:
                fs.delete(at, False)
        text = json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]}) + WHOLE
        return self._placed(manifest, text.encode())

    def _changed(self, change) -> None:
        """Applies change to the newest list until it is committed."""
        pause = 0.05
        while True:
            base = self.version()
            if self.commit(base, change(self.shards(base))):
                return
            time.sleep(pause)
            pause = min(2 * pause, 5.0)

    # rows

    def _files(self, folder: str) -> list[tuple[str, int]]:
        fs, at = hadoop_fs(self.spark, folder)
        if not fs.exists(at):
            return []
        return sorted((f.getPath().toString(), f.getLen()) for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet") and f.getLen())

    def _adopted(self, folder: str, first: int, last: int) -> list[Shard]:
        """The files of a folder as shards."""
        return [Shard(path.removeprefix(self._prefix()), size, first, last) for path, size in self._files(folder)]

    def _prefix(self) -> str:
        fs, at = hadoop_fs(self.spark, self.root)
        return fs.makeQualified(at).toString() + "/"

    def append(self, arrivals: DataFrame, arrival: str) -> None:
        """Appends rows, the column `arrival` (a whole number) telling which arrival they are of; it is not kept.

        Each arrival is committed by itself, in order; rows of a null arrival are one before all that the store has.
        An arrival without rows changes nothing. Other values than whole numbers are an error.
        """
        folder = f"{self.root}/arrived-{uuid.uuid4().hex}"
        arrivals.write.partitionBy(arrival).parquet(folder)
        fs, at = hadoop_fs(self.spark, folder)
        values = {n.partition("=")[2]: n for n in (f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if "=" in n}
        null = values.pop("__HIVE_DEFAULT_PARTITION__", None)
        if odd := [v for v in values if not v.removeprefix("-").isdigit()]:
            fs.delete(at, True)
            raise ValueError(f"arrivals that are no whole numbers: {sorted(odd)[:3]}")
        named = {int(v): n for v, n in values.items()}
        if null:
            named[min([0, *named, *(s.first for s in self.shards())]) - 1] = null
        for no, name in sorted(named.items()):
            new = self._adopted(f"{folder}/{name}", no, no)
            self._changed(lambda old, new=new: old + new)

    def compact(self, keep_versions: bool = False) -> int:
        """Merges until no tier has a run to merge; returns the number of merges that were committed."""
        done = 0
        while runs := merges(self.shards(), self.target)[:AT_ONCE]:
            folder, number = f"{self.root}/merged-{uuid.uuid4().hex}", f"_merge_{uuid.uuid4().hex}"  # no rows have such a column
            try:
                parts = [self._read(run).coalesce(1).withColumn(number, F.lit(i)) for i, run in enumerate(runs)]
                reduce(DataFrame.union, parts).write.partitionBy(number).parquet(folder)
            except (PySparkException, Py4JJavaError):
                if {s.name for run in runs for s in run} <= {s.name for s in self.shards()}:
                    raise
                # a rival has merged and deleted some of these shards meanwhile
                fs, at = hadoop_fs(self.spark, folder)
                fs.delete(at, True)
                continue
            made = {i: self._adopted(f"{folder}/{number}={i}", min(s.first for s in run), max(s.last for s in run)) for i, run in enumerate(runs)}
            kept: dict[int, list[Shard]] = {}

            def merged(old: list[Shard], runs=runs, made=made, kept=kept) -> list[Shard]:
                there = {s.name for s in old}
                kept.clear()
                kept.update({i: run for i, run in enumerate(runs) if {s.name for s in run} <= there})
                gone = {s.name for run in kept.values() for s in run}
                return [s for s in old if s.name not in gone] + [s for i in kept for s in made[i]]

            self._changed(merged)
            # a rival's merge of the same shards stands: ours is dropped
            unused = [s for i, own in made.items() if i not in kept for s in own]
            for s in unused + [s for run in kept.values() for s in run] * (not keep_versions):
                fs, at = hadoop_fs(self.spark, f"{self.root}/{s.name}")
                fs.delete(at, False)
            done += len(kept)
        return done

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{s.name}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, with `shard`, the name of the file that holds them; None if it has no shards."""
        shards = self.shards(version)
        if not shards:
            return None
        return self._read(shards).withColumn("shard", F.replace(F.col("_metadata.file_path"), F.lit(self._prefix()), F.lit("")))


def sharded(docs: DataFrame, arrivals: int = 8, target: int = TARGET) -> DataFrame:
    """docs stored and compacted: all its columns, and (shard_no, shard_rows, version) of where each row lies.

    Rows arrive by hash of all their columns. Nulls, empty and very long texts and repeated rows are rows like others;
    an empty table has no rows. shard_no numbers the shards of the version by the arrivals they hold.
    """
    spark = docs.sparkSession
    # columns are stored by place, so no name can clash with this operator's own
    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    store = ShardStore(spark, fresh_path(spark, "shards"), target)
    store.append(kept.withColumn("_arrival", F.pmod(F.xxhash64(*kept.columns), F.lit(arrivals)).cast("int")), "_arrival")
    store.compact()
    rows = store.read()
    if rows is None:
        return docs.limit(0).withColumns({"shard_no": F.lit(0).cast("int"), "shard_rows": F.lit(0).cast("long"), "version": F.lit(0).cast("int")})
    version = store.version()
    names = [s.name for s in sorted(store.shards(version), key=lambda s: (s.first, s.last, s.name))]
    counts = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    known = spark.createDataFrame([(s, i, counts.get(s, 0)) for i, s in enumerate(names)], "shard string, shard_no int, shard_rows long")
    out = rows.join(F.broadcast(known), "shard").withColumn("version", F.lit(version))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], "shard_no", "shard_rows", "version")
