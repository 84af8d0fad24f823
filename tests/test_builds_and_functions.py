"""Intervals, hints, builds, counters, fallback readers and functions of SQL, against plain versions."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quirelake.operators import hints, intervals, membership
from quirelake.operators.catalogue import CATALOGUE
from quirelake.sources import builds, table_functions


def plain_intervals(events):
    """Event by event; overlaps by trying all pairs."""
    out, by = [], {}
    for slot, item, at, kind, tie in sorted(set(events), key=lambda e: (repr(e[:2]), e[2], e[3] == "in", e[4])):
        by.setdefault((slot, item), []).append((at, kind))
    for (slot, item), own in by.items():
        start = None
        for at, kind in own:
            if kind == "in":
                if start is not None:
                    out.append([slot, item, start, at, "no_removal"])
                start = at
            else:
                out.append([slot, item, start, at, "closed" if start is not None else "no_install"])
                start = None
        if start is not None:
            out.append([slot, item, start, None, "open"])
    real = lambda r: r[2] is not None and (r[3] is None or r[3] > r[2])
    for i, r in enumerate(out):
        r.append(real(r) and any(real(s) and s[0] == r[0] and (s[3] is None or s[3] > r[2]) and (r[3] is None or s[2] < r[3]) for j, s in enumerate(out) if j != i))
    return sorted(map(repr, map(tuple, out)))


def test_intervals_against_event_by_event(spark):
    rng = random.Random(5)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    events = [(rng.choice("abcdef"), rng.choice([None, "p", "q"]), day(rng.randrange(9)), rng.choice(["in", "out"]), rng.randrange(3)) for _ in range(160)]
    events += events[:10]
    df = spark.createDataFrame([*events, ("a", "p", None, "in", 1), (None, "p", day(1), "in", 1), ("a", "p", day(2), "seen", 1)], "slot string, part string, at timestamp_ntz, kind string, tie int").repartition(3)
    spans = intervals.intervals(df, ["slot"], "part", "at", F.col("kind") == "in", F.col("kind") == "out", ["tie"])
    assert sorted(repr(tuple(r)) for r in spans.collect()) == plain_intervals(events)
    when = day(4)
    want = sorted((r["slot"], r["item"] or "") for r in spans.collect() if r["valid_from"] and r["valid_from"] <= when and (r["valid_to"] is None or r["valid_to"] > when))
    assert sorted((r["slot"], r["item"] or "") for r in intervals.as_of(spans, F.lit(when).cast("timestamp_ntz")).collect()) == want
    assert intervals.intervals(df.limit(0), ["slot"], "part", "at", F.col("kind") == "in", F.col("kind") == "out", ["tie"]).count() == 0


def plain_hint(filename, text):
    hits = []
    for word, name in hints.NAME_HINTS:
        if name and word in (filename or "").upper() and name not in hits:
            hits.append(name)
    found = re.search(hints.REGISTRATION, filename or "")
    if found and found[1] in hints.COUNTRIES:
        hits.append(f"reg:{found[1]}={hints.COUNTRIES[found[1]]}")
    for word, name in hints.NAME_HINTS:
        if name and word in (text or "").upper() and name not in hits:
            hits.append(name)
    return " · ".join(hits)


def test_hints(spark):
    rows = [(None, None), ("", "x"), ("VH-ABC China Eastern.pdf", "vna"), ("list B-2345 eastern", "Aeroflot"), ("MSN 1234.pdf", "volaris Volaris"), ("aeroflot_VP-BDK", "AEROFLOT"), ("XX-1234 N-123A", ""), ("D-AB12", None), ("9V-SKA", "vietnam")]
    got = spark.createDataFrame(rows, "f string, t string").select("f", "t", hints.operator_hint(F.col("f"), F.col("t")).alias("h")).collect()
    assert [r["h"] for r in got] == [plain_hint(r["f"], r["t"]) for r in got]
    assert got[2]["h"] == "China Eastern · China Eastern (?) · reg:VH=Australia · Vietnam Airlines"


def test_a_build_shows_all_its_tables_at_once(spark, tmp_path):
    build = builds.Build(spark, f"file://{tmp_path}/fact")
    assert build.current() is None
    with build.version() as put:
        put("files", spark.range(3))
        put("rows", spark.range(5))
    first = build.views({"both": lambda read: read("files").unionByName(read("rows"))}, prefix="t_")
    old = build.read("rows")
    assert spark.sql("select count(*) from t_both").first()[0] == 8
    with pytest.raises(RuntimeError), build.version() as put:
        put("files", spark.range(30))
        raise RuntimeError("killed half-way")
    assert build.current()["version"] == first and build.read("files").count() == 3
    with build.version() as put:
        put("files", spark.range(30))
        put("rows", spark.range(50))
    assert build.read("rows").count() == 50 and build.current()["number"] == 2
    assert old.count() == 5 and spark.sql("select count(*) from t_both").first()[0] == 8  # bound to what they were made of
    assert not build.expire(keep=2)
    assert len(build.expire(keep=1)) == 1 and not build.expire(keep=1)
    build.expire(keep=0)
    assert build.read("rows").count() == 50


def test_counters_of_the_pass_that_writes(spark, tmp_path):
    rows = [(f"f{i % 3}" if i % 7 else None, "x" if i % 2 else "") for i in range(100)]
    df = spark.createDataFrame(rows, "file string, issue string").repartition(4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    got = builds.written_with_counts(df, f"file://{tmp_path}/out", "file", ["f0", "f1"], {"flagged": F.col("issue") != ""})
    jobs = len(tracker.getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("plain", "plain")
    df.write.mode("overwrite").parquet(f"file://{tmp_path}/plain")
    assert jobs == len(tracker.getJobIdsForGroup("plain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = [{"file": f, "rows": sum(r[0] == f for r in rows), "flagged": sum(r[0] == f and r[1] != "" for r in rows)} for f in ("f0", "f1")]
    want.append({"file": None, "rows": sum(r[0] not in ("f0", "f1") for r in rows), "flagged": sum(r[0] not in ("f0", "f1") and r[1] != "" for r in rows)})
    assert got == want and spark.read.parquet(f"file://{tmp_path}/out").count() == 100
    with pytest.raises(ValueError):
        builds.written_with_counts(df, "x", "file", [str(i) for i in range(1001)], {})


def test_the_second_reader_sees_only_what_the_first_left_unknown(spark, tmp_path):
    files = [("a", b"OCCM AMOS " + b"x" * 60), ("b", b"??" + b"y" * 60), ("c", b"short"), ("d", None), ("e", b"!" + b"z" * 60), ("f", b"raise")]
    contents = spark.createDataFrame(files, "path string, content binary").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def first(content):
        if content == b"raise":
            raise ValueError("broken")
        return content.decode()

    def second(content):
        seen.add(1)
        return "Technical OCCM by AMOS" if content.startswith(b"??") else "still nothing of note"

    got = builds.read_with_fallback(contents, first, second, CATALOGUE.route, f"file://{tmp_path}/first").collect()
    assert {r["path"]: (r["reader"], r["variant"]) for r in got} == {"a": ("first", "AMOS"), "b": ("second", "AMOS"), "c": ("first", "Unknown"), "d": ("first", "Unknown"), "e": ("first", "Unknown"), "f": ("first", "Unknown")}
    assert seen.value == 2
    assert {r["path"]: r["diagnosis"] for r in got}["b"] is None


def test_formats_from_sql(spark):
    table_functions.register(spark)
    pad = "x" * 110
    lines = [pad, "21-22 AIR CONDITIONING see below", "P1 S1 FUEL PUMP NEW / 24310 3.Jan.2019 10 5", ",RAM AIR", "", "P2 S2 VALVE 11HB X/1 3.Jan.2019 1 2"]
    docs = spark.createDataFrame([(i, f"AMOS {i}\n" + "\n".join(lines)) for i in range(3)], "doc_id long, text string")
    docs.createOrReplaceTempView("printed_docs")
    docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line").repartition(3).createOrReplaceTempView("printed_lines")
    got = spark.sql("SELECT * FROM read_format(TABLE(printed_lines) PARTITION BY doc_id ORDER BY (line_no), 'AMOS')")
    assert got.columns == ["doc_id", "line_no", "ATA", "PART_NUMBER", "SERIAL_NUMBER", "DESCRIPTION", "POS", "RELEASE_LABEL", "INST_DATE", "TSN", "CSN"]
    want = CATALOGUE.records(CATALOGUE.route(docs), "doc_id").collect()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((r["doc"], r["line_no"], *[r["record"][c] for c in got.columns[2:]])) for r in want)
    other = spark.sql("SELECT * FROM read_format(TABLE(SELECT 1 AS doc_id, CAST(1 AS BIGINT) AS line_no, '12 622A0 FAN gz/2125/01/aft' AS line) PARTITION BY (doc_id), 'B777 Annex 8 OCCM')").collect()
    assert [tuple(r) for r in other] == [(1, 1, "12", "622A0", "FAN", "21", "AFT", "GZ/2125/01/AFT")]
    assert spark.sql("SELECT count(*) FROM printed_docs WHERE is_format(text, 'AMOS') AND NOT is_format(text, 'Cathay OCCM') AND NOT is_format(NULL, 'AMOS')").first()[0] == 3
    plan = spark.sql("SELECT * FROM printed_docs WHERE is_format(text, 'AMOS')")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    for bad in ("SELECT * FROM read_format(TABLE(printed_lines) PARTITION BY (doc_id), 'none such')", "SELECT * FROM read_format(TABLE(printed_docs) PARTITION BY (doc_id), 'AMOS')", "SELECT * FROM read_format(TABLE(printed_lines) PARTITION BY (doc_id), 'Remaining Potentials')"):
        with pytest.raises(Exception, match="read_format|no format|hangs on"):
            spark.sql(bad).collect()


def test_a_filter_of_bits_set_by_executors(spark):
    values = [f"P{i}" for i in range(500)] + ["é", ""]
    bloom = membership.build_bloom(spark.createDataFrame([(v,) for v in [*values, None]], "value string").repartition(4))
    assert bytes(bloom.bits) == bytes(membership.Bloom.of(values, 503).bits)
    assert membership.Bloom.from_bytes(bloom.to_bytes(b"OWN1"), b"OWN1").bits == bloom.bits
