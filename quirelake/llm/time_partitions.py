"""Adaptive time partitions: calendar nodes split where they are overfull, small siblings put together, a file a part.

One pass counts rows by hour. The driver walks down from the years: a node of more than `limit` rows is split into all its
months, days or hours, the others join their directly preceding sibling's run while the run stays within the limit. The map
from calendar nodes to leaves is broadcast; a leaf of more than limit rows (an overfull hour, or the rows without a moment)
is cut into parts by row numbers; a direct repartition gives each file one task, which sorts and writes it.

Bounds. The limit is a share of the table (1 + rows/800 in the query), so fewer than 800 nodes of a level can be above it:
what the driver collects and broadcasts is the years between the first and the last moment, at most 12, 31 and 24 children
of each of these nodes, and a few numbers a file, of which there are at most some thousands. None of it grows with the
rows. An overfull leaf, though it were the whole table, is never one task's: its rows are range-partitioned by their whole
order (identical rows by their place in the input), counted by range, and numbered within a range from its first number. A
file is at most `limit` rows in one task, which sorts with spilling and writes as it goes.

A folder holds `leaf=.../part=N/one file`, which Spark reads as one table with partitions. `lay_out` may be called again on
a folder, with more rows: files whose leaf, part and rows recur stay, all others are written anew and what no longer
belongs is deleted. It compares with what is stored, so a call that was broken off is mended by calling again. Executors
lost on the way cost only their tasks: Spark's commit protocol moves a file in when its task has won.

Rows by their defined results:
- Rows without a moment are one leaf, `null`, ordered like the others by the rest of the order.
- Nulls of order columns come first. Rows of one place in the order follow each other by a hash of all their columns;
  identical rows are kept, each.
- A null id stands as an empty string in ids_sha256.
- Two files have the same rows if number, leaf, part and 128 bits of summed row hashes agree.
- An empty table has no leaves and no files. Columns of whatever names are kept in the files; partition columns and the
  helper columns avoid them.
"""

from __future__ import annotations

import calendar
import hashlib
import itertools
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import hadoop_fs, shared_dir, written

#: A calendar node is one number: year * 10^6 + month * 10^4 + day * 10^2 + hour + 1; what a level leaves out is 0.
YEAR, MONTH, DAY, HOUR = 10**6, 10**4, 10**2, 1
BELOW = {YEAR: MONTH, MONTH: DAY, DAY: HOUR}
#: Ranges that the rows of overfull leaves are dealt over for numbering, at most: two for each 1/800 of a table.
MOST_RANGES = 1600
#: Neighbouring files share a task while they are of no more rows than this together, and no more files; others have their own.
TASK_ROWS, TASK_FILES = 65536, 16
NO_MOMENT = "null"


def node_of(moment: Column) -> Column:
    """The hour's node; null without a moment."""
    return F.year(moment).cast("long") * YEAR + F.month(moment) * MONTH + F.dayofmonth(moment) * DAY + F.hour(moment) + 1


def _up(node: Column, unit: int) -> Column:
    return node - F.pmod(node, F.lit(unit))


@dataclass(frozen=True)
class Leaf:
    label: str
    nodes: tuple[int, ...]
    rows: int


def node_counts(hours: DataFrame, limit: int, of: tuple[str, ...]) -> dict[int, tuple[int, ...]]:
    """Counts of all years and of the children of each overfull node, from counts by hour (node and the columns of).

    A node is overfull by the largest of its counts, so a tree of any of the columns finds its nodes here.
    """
    spark = hours.sparkSession
    found: dict[int, tuple[int, ...]] = {}
    above: list[int] | None = None
    parent = 0
    for unit in (YEAR, MONTH, DAY, HOUR):
        level = hours.filter(F.col("node").isNotNull())
        if above is not None:
            split = F.broadcast(spark.createDataFrame([(a,) for a in above], "above long"))  # fewer than rows / limit
            level = level.join(split, _up(F.col("node"), parent) == F.col("above"), "left_semi")
        rows = level.groupBy(_up(F.col("node"), unit).alias("node")).agg(*[F.sum(c).alias(c) for c in of]).collect()
        found |= {r[0]: tuple(r[1:]) for r in rows}
        above, parent = [r[0] for r in rows if max(r[1:]) > limit], unit
        if not above:
            break
    return found


def _children(node: int, unit: int) -> list[int]:
    """All calendar children of a node, in time order."""
    if unit == YEAR:
        return [node + m * MONTH for m in range(1, 13)]
    if unit == MONTH:
        return [node + d * DAY for d in range(1, calendar.monthrange(node // YEAR, node // MONTH % 100)[1] + 1)]
    return [node + h for h in range(1, 25)]


def _name(node: int, unit: int) -> str:
    if unit == YEAR:
        return f"{node // YEAR:04d}"
    return f"{node % 100 - 1:02d}" if unit == HOUR else f"{node // unit % 100:02d}"


def leaves(counts: dict[int, int], limit: int) -> list[Leaf]:
    """Next fit over the calendar tree: see the module's head. counts: of the nodes that the tree reaches; a missing one is 0."""
    found: list[Leaf] = []

    def walk(parents: str, siblings: list[int], unit: int) -> None:
        run: list[int] = []
        held = 0

        def close() -> None:
            if held:
                found.append(Leaf(f"{parents}{_name(run[0], unit)}-{_name(run[-1], unit)}", tuple(n for n in run if counts.get(n)), held))

        for node in siblings:
            n = counts.get(node, 0)
            if run and (n > limit or held + n > limit):
                close()
                run, held = [], 0
            if n <= limit:
                run, held = [*run, node], held + n
            elif unit == HOUR:
                found.append(Leaf(f"{parents}{_name(node, unit)}-{_name(node, unit)}", (node,), n))
            else:
                walk(f"{parents}{_name(node, unit)}/", _children(node, unit), BELOW[unit])
        close()

    years = sorted(n for n, rows in counts.items() if n % YEAR == 0 and rows)
    if years:
        walk("", list(range(years[0], years[-1] + 1, YEAR)), YEAR)
    return found


def _free(name: str, taken: list[str]) -> str:
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def _row_hash(values: list[Column], kinds: list[T.DataType], seed: int) -> Column:
    """A hash of all columns; maps and variants, which hashes refuse, as JSON."""
    held = [F.to_json(F.struct(c.alias("x"))) if {"map", "variant"} & set(re.findall("[a-z]+", k.simpleString())) else c for c, k in zip(values, kinds, strict=True)]
    return F.xxhash64(F.lit(seed), *held)


def _slug(label: str) -> str:
    return label.replace("/", ".")


@dataclass(frozen=True)
class StoredFile:
    leaf: str
    part: int
    n_rows: int
    n_new: int
    rewritten: bool


def _tasks(rows: list[int]) -> list[int]:
    """The task of each file in order: next fit."""
    out, task, held, files = [], 0, 0, 0
    for n in rows:
        if files and (held + n > TASK_ROWS or files == TASK_FILES):
            task, held, files = task + 1, 0, 0
        held, files = held + n, files + 1
        out.append(task)
    return out


@dataclass(frozen=True)
class TimeStore:
    """A folder of adaptive time partitions of tables with the columns of schema.

    moment: an expression over the columns, made a timestamp without zone. order: further columns of the order in files.
    ident: the column whose values ids_sha256 joins.
    """

    spark: SparkSession
    folder: str
    schema: T.StructType
    moment: Column
    order: tuple[str, ...]
    ident: str

    @property
    def partitions(self) -> tuple[str, str]:
        return _free("leaf", self.schema.names), _free("part", self.schema.names)

    def read(self) -> DataFrame:
        leaf, part = self.partitions
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(leaf, T.StringType()), T.StructField(part, T.IntegerType())])).parquet(self.folder)

    @property
    def _values(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.schema.names]

    @property
    def _held(self) -> list[str]:
        """The columns' names in here, which no helper column has."""
        return [f"c{i}" for i in range(len(self.schema))]

    @property
    def _order(self) -> list[str]:
        return ["m", *[f"c{self.schema.names.index(c)}" for c in self.order], "tie"]

    def _sums(self, values: list[Column]) -> list[Column]:
        """128 bits of a set of rows with repeats: halves of two hashes, summed."""
        hashes = [_row_hash(values, [f.dataType for f in self.schema.fields], seed) for seed in (1, 2)]
        return [F.sum(half) for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))]

    def hour_counts(self, rows: DataFrame, **conditions: Column) -> DataFrame:
        """node (null: no moment) and, for each name, how many rows meet the condition; written."""
        told = rows.select(self.moment.cast("timestamp_ntz").alias("m"), *[c.alias(f"c_{k}") for k, c in conditions.items()])
        counted = told.groupBy(node_of(F.col("m")).alias("node")).agg(*[F.count(F.when(F.col(f"c_{k}"), 1)).alias(k) for k in conditions])
        return written(counted, "hour-counts")

    def _keyed(self, rows: DataFrame, is_new: Column) -> DataFrame:
        kinds = [f.dataType for f in self.schema.fields]
        own = [v.alias(c) for v, c in zip(self._values, self._held, strict=True)]
        keyed = rows.select(*own, self.moment.cast("timestamp_ntz").alias("m"), _row_hash(self._values, kinds, 0).alias("tie"), F.coalesce(is_new, F.lit(False)).alias("new"))
        return keyed.withColumn("node", node_of(F.col("m")))

    def _placed(self, rows: DataFrame, found: list[Leaf], limit: int, is_new: Column) -> DataFrame:
        """The rows with file: the number of their file, counted over the parts of all leaves in order."""
        first, at = [], 0
        for x in found:
            first.append(at)
            at += -(-x.rows // limit)
        # children of overfull nodes and years: bounded, see the module's head
        table = F.broadcast(self.spark.createDataFrame([(n, first[i], x.rows > limit) for i, x in enumerate(found) for n in x.nodes], "at long, first int, big boolean"))
        placed = self._keyed(rows, is_new)
        units = (HOUR, DAY, MONTH, YEAR)
        for unit in units:  # exactly one of an hour's four nodes is a leaf's
            own = table.select(F.col("at").alias("up"), F.col("first").alias(f"first{unit}"), F.col("big").alias(f"big{unit}"))
            placed = placed.withColumn("up", _up(F.col("node"), unit)).join(own, "up", "left").drop("up")
        null = next((i for i, x in enumerate(found) if x.label == NO_MOMENT), None)
        no = (F.lit(None).cast("int"), F.lit(False)) if null is None else (F.lit(first[null]), F.lit(found[null].rows > limit))
        kept = ["new", "tie", "m", *self._held]
        placed = placed.select(*kept, F.coalesce(*[F.col(f"first{u}") for u in units], no[0]).alias("file"), F.coalesce(*[F.col(f"big{u}") for u in units], no[1]).alias("big"))
        large = sum(x.rows for x in found if x.rows > limit)
        if not large:
            return placed.drop("big")
        return placed.filter(~F.col("big")).drop("big").unionByName(self._numbered(placed.filter("big").drop("big"), large, limit))

    def _numbered(self, rows: DataFrame, n: int, limit: int) -> DataFrame:
        """Rows of overfull leaves, file moved on by the parts before theirs: numbered by ranges of the whole order."""
        ranges = min(MOST_RANGES, math.ceil(2 * n / limit))
        keys = ["file", *self._order, "place"]
        dealt = rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id())
        dealt = written(dealt, "ranges")
        of_leaf = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        before = dealt.groupBy("file", "range").agg(F.count("*").alias("n")).select("file", "range", F.coalesce(F.sum("n").over(of_leaf), F.lit(0)).alias("before"))
        within = F.row_number().over(Window.partitionBy("file", "range").orderBy(*self._order, "place"))
        # of the broadcast side there are no more rows than ranges and overfull leaves
        numbered = dealt.withColumn("within", within).join(F.broadcast(before), ["file", "range"])
        part = F.floor((F.col("before") + F.col("within") - 1) / F.lit(limit))
        return numbered.withColumn("file", (F.col("file") + part).cast("int")).drop("place", "range", "within", "before")

    def _stored(self) -> dict[tuple[str, int], tuple]:
        leaf, part = self.partitions
        rows = self.read().groupBy(leaf, part).agg(F.count("*"), *self._sums(self._values)).collect()  # a row a file
        return {(r[0], r[1]): tuple(r[2:]) for r in rows}

    def lay_out(self, rows: DataFrame, found: list[Leaf], limit: int, is_new: Column | None = None) -> list[StoredFile]:
        """Makes the folder hold rows, by the leaves found for them; see the module's head. is_new: rows that n_new counts."""
        fs, at = hadoop_fs(self.spark, self.folder)
        fs.mkdirs(at)
        before = self._stored()
        named = [(x.label, p) for x in found for p in range(1, 1 + -(-x.rows // limit))]
        news: dict[int, tuple[int, int]] = {}
        todo: list[int] = []
        if named:
            placed = self._placed(rows, found, limit, F.lit(False) if is_new is None else is_new)
            counted = placed.groupBy("file").agg(F.count(F.when(F.col("new"), 1)), F.count("*"), *self._sums([F.col(c) for c in self._held])).collect()  # a row a file
            now = {r[0]: tuple(r[2:]) for r in counted}
            news = {r[0]: (r[2], r[1]) for r in counted}
            todo = [i for i, (label, p) in enumerate(named) if before.get((_slug(label), p)) != now[i]]
            if todo:
                self._write(placed, [(i, k, _slug(named[i][0]), named[i][1]) for i, k in zip(todo, _tasks([now[i][0] for i in todo]), strict=True)])
        leaf, part = self.partitions
        for a, b in before.keys() - {(_slug(label), p) for label, p in named}:
            fs.delete(hadoop_fs(self.spark, f"{self.folder}/{leaf}={a}/{part}={b}")[1], True)
        done = set(todo)
        return [StoredFile(label, p, *news[i], i in done) for i, (label, p) in enumerate(named)]

    def _write(self, placed: DataFrame, files: list[tuple[int, int, str, int]]) -> None:
        """The named files (number, task, leaf, part), each by one task. A partition that is there is replaced as a whole."""
        leaf, part = self.partitions
        named = F.broadcast(self.spark.createDataFrame(files, "file int, task int, leaf string, part int"))
        own = [F.coalesce("leaf", F.lit("")).alias("leaf"), F.coalesce("part", F.lit(0)).alias("part")]  # not null, so that writing keeps the order
        dealt = placed.join(named, "file").select(*self._order, "task", *own, *[c for c in self._held if c not in self._order]).repartitionById(files[-1][1] + 1, F.col("task"))
        values = [F.col(c).alias(n) for c, n in zip(self._held, self.schema.names, strict=True)]
        ordered = dealt.sortWithinPartitions("leaf", "part", *self._order).select(*values, F.col("leaf").alias(leaf), F.col("part").alias(part))
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(leaf, part).parquet(self.folder)

    def files(self, stored: list[StoredFile]) -> DataFrame:
        """A row for each file: leaf, part, columns, n_rows, n_new, rewritten, ids_sha256, path. Rows are read back from the files."""
        spark = self.spark
        leaf, part = self.partitions
        at = {tuple(x.split("=", 1)[1] for x in p.split("/")[-3:-1]): "/".join(p.split("/")[-3:]) for p in self.read().inputFiles()}
        rows = [(k, f.leaf, f.part, ",".join(self.schema.names), f.n_new, f.rewritten, f"{self.folder}/{at[_slug(f.leaf), str(f.part)]}", _slug(f.leaf)) for k, f in enumerate(stored)]
        table = spark.createDataFrame(rows, "slot int, leaf string, part int, columns string, n_new long, rewritten boolean, path string, slug string")
        read = self.read()
        ids = read.select(F.col(f"`{leaf}`").alias("slug"), F.col(f"`{part}`").alias("part"), read.metadataColumn("_metadata")["row_index"].alias("at"), F.col(f"`{self.ident}`").cast("string").alias("id"))
        tasks = _tasks([f.n_rows for f in stored]) or [0]
        where = spark.createDataFrame([(r[7], r[2], r[0], k) for r, k in zip(rows, tasks, strict=False)], "slug string, part int, slot int, task int")
        ids = ids.join(F.broadcast(where), ["slug", "part"]).select("slot", "at", "id", "task")
        dealt = ids.repartitionById(tasks[-1] + 1, F.col("task")).sortWithinPartitions("slot", "at")
        told = dealt.select("slot", "id").mapInArrow(_digests, "slot int, n_rows long, ids_sha256 string")
        return told.join(F.broadcast(table), "slot").select("leaf", "part", "columns", "n_rows", "n_new", "rewritten", "ids_sha256", "path")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by slot: how many there are and the SHA-256 of their ids, comma-joined; holds one batch."""
    now, n, h = None, 0, hashlib.sha256()
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        slots = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(slots)] if len(slots) else []
        for a, b in itertools.pairwise(cuts):
            if slots[a] != now:
                if now is not None:
                    done.append((now, n, h.hexdigest()))
                now, n, h = int(slots[a]), 0, hashlib.sha256()
            h.update(("," * (n > 0) + ",".join(x or "" for x in batch.column(1).slice(a, b - a).to_pylist())).encode())
            n += b - a
    if now is not None:
        done.append((now, n, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["slot", "n_rows", "ids_sha256"])


def with_null_leaf(found: list[Leaf], rows: int) -> list[Leaf]:
    return [*found, Leaf(NO_MOMENT, (), rows)] if rows else found


def rewritten_by_time(rows: DataFrame, moment: Column, order: tuple[str, ...], ident: str, earlier: Column, parts: int = 800) -> DataFrame:
    """Rows that are earlier laid out in a new folder, then all rows in it; a row for each file that is there in the end.

    The limit is 1 + all rows / parts for both. The folder stays.
    """
    spark = rows.sparkSession
    store = TimeStore(spark, f"{shared_dir(spark)}/by-time-{uuid.uuid4().hex}", rows.schema, moment, order, ident)
    start = F.coalesce(earlier, F.lit(False))
    hours = store.hour_counts(rows, all=F.lit(True), start=start)
    total = hours.agg(F.sum("all")).first()[0] or 0
    limit = 1 + total // parts
    counts = node_counts(hours, limit, ("all", "start"))
    null = hours.filter("node IS NULL").agg(F.sum("all"), F.sum("start")).first()
    layouts = [with_null_leaf(leaves({n: c[k] for n, c in counts.items()}, limit), null[k] or 0) for k in (0, 1)]
    store.lay_out(rows.filter(start), layouts[1], limit)
    return store.files(store.lay_out(rows, layouts[0], limit, is_new=~start))


def shifted_moment(ts: Column, click_id: Column) -> Column:
    """ts as the query's contract moves it: k = crc32 of the decimal click_id mod 128; a null click_id moves nothing, a null ts is no moment."""
    k = F.coalesce(F.crc32(click_id.cast("string").cast("binary")) % 128, F.lit(64)).cast("int")
    local = ts.cast("timestamp_ntz")
    day = F.to_date(local)
    back = local - F.make_dt_interval((k + 6) * (k + 6) * (k + 6))
    return F.when(k < 16, back).when(k > 111, F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")).otherwise(local)
