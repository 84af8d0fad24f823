"""Adaptive time partitions against a plain version in Python, file by file."""

import datetime as dt
import glob
import hashlib
import os
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm import queries, time_partitions
from quirelake.llm.time_partitions import Leaf, leaves, rewritten_by_time, shifted_moment

SF = "/root/testdata/sf0.001"
CUT = dt.datetime(2024, 4, 1)
SCHEMA = T.StructType([T.StructField("click_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("arrived_at", T.TimestampNTZType()), T.StructField("leaf", T.StringType()), T.StructField("Part", T.DoubleType()), T.StructField("file", T.MapType(T.StringType(), T.LongType())), T.StructField("c0", T.StringType()), T.StructField("node", T.LongType())])


def plain_moment(click_id, ts):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time())
    return ts


def plain_leaves(moments, limit):
    """(label, test of a moment) in time order: the contract's words, row by row."""
    if not moments:
        return []
    out = []

    def members(prefix):
        y, m, d = [*prefix, None, None, None][:3]
        if y is None:
            return range(min(x.year for x in moments), max(x.year for x in moments) + 1)
        if m is None:
            return range(1, 13)
        if d is None:
            first = dt.date(y, m, 1)
            return range(1, ((first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - first).days + 1)
        return range(24)

    def within(prefix):
        return sum((x.year, x.month, x.day, x.hour)[: len(prefix)] == prefix for x in inside[prefix[:-1]])

    inside = {(): moments}

    def walk(prefix):
        run, held = None, 0
        write = lambda a, b: "/".join([*(f"{p:02d}" for p in prefix), f"{a:02d}-{b:02d}"])

        def close():
            if run and held:
                out.append((write(*run), prefix, run))

        for x in members(prefix):
            n = within((*prefix, x))
            if n > limit:
                close()
                run, held = None, 0
                if len(prefix) == 3:
                    out.append((write(x, x), prefix, (x, x)))
                else:
                    inside[(*prefix, x)] = [m for m in inside[prefix] if (m.year, m.month, m.day, m.hour)[: len(prefix) + 1] == (*prefix, x)]
                    walk((*prefix, x))
            elif run and held + n <= limit:
                run, held = (run[0], x), held + n
            else:
                close()
                run, held = (x, x), n
        close()

    walk(())
    return out


def plain_files(rows, limit):
    """{(leaf, part): rows}; rows as (click_id, ts, arrived_at, rest)."""
    told = [(plain_moment(r[0], r[1]), r) for r in rows]
    key = lambda x: (x[0] or dt.datetime.min, x[1][2] is not None, x[1][2] or dt.datetime.min, x[1][0] is not None, x[1][0] or 0)
    out = {}
    by = [(label, [t for t in told if t[0] and (f := (t[0].year, t[0].month, t[0].day, t[0].hour))[: len(p)] == p and a <= f[len(p)] <= b]) for label, p, (a, b) in plain_leaves([m for m, _ in told if m], limit)]
    by.append(("null", [t for t in told if not t[0]]))
    for label, own in by:
        own.sort(key=key)
        for i in range(0, len(own), limit):
            out[label, i // limit + 1] = [r for _, r in own[i : i + limit]]
    return out


def sha(rows):
    return hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in rows).encode()).hexdigest()


def held(df, rows, total_columns):
    """The result and the folder against the plain version; rows: all of the table. Gives the result by file."""
    limit = 1 + len(rows) // 800 if not isinstance(total_columns, tuple) else total_columns[1]
    columns = total_columns if isinstance(total_columns, str) else total_columns[0]
    old = [r for r in rows if r[2] is not None and r[2] < CUT]
    start, final = plain_files(old, limit), plain_files(rows, limit)
    got = {(r["leaf"], r["part"]): r for r in df.collect()}
    assert sorted(got) == sorted(final)
    for k, own in final.items():
        r = got[k]
        assert (r["n_rows"], r["ids_sha256"], r["columns"]) == (len(own), sha(own), columns), k
        assert r["n_new"] == sum(x[2] is None or x[2] >= CUT for x in own)
        assert r["rewritten"] == (sorted(map(repr, start.get(k, []))) != sorted(map(repr, own))), k
        read = pq.read_table(r["path"].removeprefix("file:").replace("///", "/"), partitioning=None)
        assert ",".join(read.column_names) == columns
        assert [x["click_id"] for x in read.to_pylist()] == [x[0] for x in own]
    paths = [r["path"].removeprefix("file:").replace("///", "/") for r in got.values()]
    if paths:
        folder = paths[0].rsplit("/", 3)[0]
        assert sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True)) == sorted(paths)
        assert not [f for d, _, fs in os.walk(folder) for f in fs if not f.endswith((".parquet", ".crc")) and f != "_SUCCESS"]
    return got


def query(spark, df, parts=800):
    return rewritten_by_time(df, shifted_moment(F.col("ts"), F.col("click_id")), ("arrived_at", "click_id"), "click_id", F.col("arrived_at") < F.lit("2024-04-01 00:00:00").cast("timestamp_ntz"), parts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_the_query_against_the_plain_version(spark):
    table = pq.read_table(f"{SF}/clicks.parquet")
    rows = [(r["click_id"], r["ts"], r["arrived_at"], r["client_id"], r["kind"], r["value"], r["props"]) for r in table.to_pylist()]
    got = held(queries.op13_time_partitions(spark, SF), rows, ",".join(table.column_names))
    assert {r["rewritten"] for r in got.values()} == {True, False}
    assert max(p for _, p in got) > 1


def hot_rows():
    """An hour with half of the rows, many of one place in the order or wholly alike, nulls everywhere, a late year."""
    at = dt.datetime(2024, 1, 3, 5)
    rows = [(i % 7, at + dt.timedelta(seconds=i % 3), dt.datetime(2024, 3, 31, 23) + dt.timedelta(hours=i % 2), str(i % 5), float(i % 2), {"a": i % 2}, None, i) for i in range(90)]
    rows += [(64, at, dt.datetime(2024, 2, 1), "x", 1.0, {"a": 1}, "y", 1)] * 60
    rows += [(None, at, None, None, None, None, None, None)] * 3 + [(5, None, dt.datetime(2024, 1, 1), "n", None, None, None, i) for i in range(40)]
    rows += [(100 + i, dt.datetime(2024, 1 + i % 5, 1 + i % 28, i % 24), dt.datetime(2024, 1 + i % 5, 2), None, 0.5, {}, "", i) for i in range(80)]
    rows += [(900, dt.datetime(2031, 1, 1), dt.datetime(2024, 5, 1), "late", None, None, None, 0)]
    return rows


def test_hot_hours_ties_repeats_nulls_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(time_partitions, "TASK_FILES", 3)
    rows = hot_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    parts = 40
    held(query(spark, df, parts), rows, (",".join(SCHEMA.names), 1 + len(rows) // parts))


def test_one_group_of_copies_is_dealt_over_many_ranges(spark):
    rows = [(1, dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 2, 1), "x", 1.0, None, "y", 1)] * 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    held(query(spark, df, 10), rows, (",".join(SCHEMA.names), 31))


def test_empty_and_all_null(spark):
    assert query(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, None, None, None, None, None, None, None) for i in range(5)]
    got = held(query(spark, spark.createDataFrame(rows, SCHEMA)), rows, ",".join(SCHEMA.names))
    assert [k[0] for k in got] == ["null"] * 5


def test_a_call_that_was_broken_off_is_mended(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    store = time_partitions.TimeStore(spark, f"{time_partitions.shared_dir(spark)}/mended", df.schema, F.col("ts"), ("arrived_at", "click_id"), "click_id")
    hours = store.hour_counts(df, all=F.lit(True))
    found = leaves({n: c[0] for n, c in time_partitions.node_counts(hours, 20, ("all",)).items()}, 20)
    found = time_partitions.with_null_leaf(found, 40)
    first = store.lay_out(df, found, 20)
    assert all(f.rewritten for f in first) and store.read().count() == len(rows)
    assert not any(f.rewritten for f in store.lay_out(df, found, 20))
    gone = store.files(first).first()["path"]
    fs, at = time_partitions.hadoop_fs(spark, gone)
    fs.delete(at, False)
    again = store.lay_out(df, found, 20)
    assert sum(f.rewritten for f in again) == 1 and store.read().count() == len(rows)


def test_leaves_keep_empty_siblings_in_runs():
    y, m = time_partitions.YEAR, time_partitions.MONTH
    counts = {2000 * y: 3, 2003 * y: 7, 2004 * y: 30, 2005 * y: 1, 2004 * y + 2 * m: 10, 2004 * y + 3 * m: 10, 2004 * y + 11 * m: 10}
    assert leaves(counts, 10) == [
        Leaf("2000-2003", (2000 * y, 2003 * y), 10),
        Leaf("2004/01-02", (2004 * y + 2 * m,), 10),
        Leaf("2004/03-10", (2004 * y + 3 * m,), 10),
        Leaf("2004/11-12", (2004 * y + 11 * m,), 10),
        Leaf("2005-2005", (2005 * y,), 1),
    ]
