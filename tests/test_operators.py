"""Operators on small inputs whose results are plain to see, and on the properties they promise."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.operators import compare, forms, layout, membership, quality, similarity, slots
from quirelake.plans import forms as plans_forms
from quirelake.sources import files


def test_forward_fill(spark):
    rows = [("d", i, v, "ATA:empty" if not v else "") for i, v in enumerate(["", "21", "", "99", ""])]
    out = quality.forward_fill(spark.createDataFrame(rows, "doc string, no int, ATA string, _issues string"), "doc", ["no"]).orderBy("no").collect()
    assert [r["ATA"] for r in out] == ["", "21", "21", "99", "21"]
    assert [r["_issues"] for r in out] == ["ATA:empty", "", "_imputed:ATA", "", "_imputed:ATA"]


def test_latest_prefers_dates_then_ties(spark):
    df = spark.createDataFrame([("a", "p", "", 9), ("a", "p", "2020-01-01", 1), ("a", "p", "2020-01-01", 2)], "aircraft_key string, position string, report_date_iso string, id int")
    assert [r["id"] for r in slots.current_fit(df, ["id"]).collect()] == [2]


def test_side_by_side(spark):
    rows = [("a", "p", "OCCM", "", "x", 1), ("a", "p", "HT", "", "y", 2), ("a", "q", "HT", "", "z", 3), ("b", "p", "OCCM", "", "w", 4), ("b", "", "OCCM", "", "w", 5)]
    df = spark.createDataFrame(rows, "aircraft_key string, position string, sheet_type string, report_date_iso string, part_number string, id int")
    out = {(r[0], r[1]): r["slot_coverage"] for r in slots.side_by_side(df, ["id"], ["part_number"]).collect()}
    assert out == {("a", "p"): "both", ("a", "q"): "ht_only", ("b", "p"): "occm_only"}
    assert slots.side_by_side(df, ["id"], ["part_number"], key="b").count() == 1


def _snapshot(spark, rows):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "PART_NUMBER string, SERIAL_NUMBER string, row_seq int")


def test_diff_of_itself_is_unchanged(spark):
    df = _snapshot(spark, [("a", "1"), ("b", None), ("a", "2")])
    out = compare.diff_snapshots(df, df, ["PART_NUMBER"]).collect()
    assert {r["_change"] for r in out} == {"unchanged"} and len(out) == 2


def test_diff_counts_and_texts(spark):
    old, new = _snapshot(spark, [("a", "1"), ("b", "x"), ("c", "y")]), _snapshot(spark, [("A ", "2"), ("b", "x"), ("d", "y" * 50)])
    out = compare.in_diff_order(compare.diff_snapshots(old, new, ["PART_NUMBER"])).collect()
    assert [(r["_change"], r["_key"]) for r in out] == [("added", "D"), ("changed", "A"), ("removed", "C"), ("unchanged", "B")]
    assert out[1]["_changes"] == "PART_NUMBER:a→A ; SERIAL_NUMBER:1→2" or out[1]["_changes"] == "PART_NUMBER:a→A; SERIAL_NUMBER:1→2"


def test_diff_of_empty_snapshots(spark):
    empty = _snapshot(spark, [("a", "1")]).limit(0)
    assert compare.diff_snapshots(empty, empty, ["PART_NUMBER"]).count() == 0


def test_bloom_round_trip_and_native_places(spark):
    words = [f"PN{i}" for i in range(500)]
    bloom = membership.Bloom.of(words, len(words))
    back = membership.Bloom.from_bytes(bloom.to_bytes())
    assert all(w in back for w in words) and sum(f"X{i}" in back for i in range(5000)) < 30
    df = spark.createDataFrame([(w,) for w in words[:20]], "v string").select("v", *[membership.native_place(F.col("v"), back.m, i).alias(f"p{i}") for i in range(3)])
    assert all([r[f"p{i}"] for i in range(3)] == membership.bit_places(r["v"], back.m, 3) for r in df.collect())


def test_built_bloom_equals_plain(spark):
    words = [f"W{i}" for i in range(200)]
    master = spark.createDataFrame([(w,) for w in words], "value string").repartition(3)
    assert membership.build_bloom(master).to_bytes() == membership.Bloom.of(words, len(words)).to_bytes()


def test_membership_without_master_is_unknown(spark):
    df = spark.createDataFrame([("a",)], "v string")
    assert membership.known(df, "v", None).first()["_known"] is None


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("abc ", max_size=12), min_size=1, max_size=12))
def test_leader_clusters_against_brute_force(spark, texts):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "block int, no int, t string")
    got = {r["no"]: r["leader"] for r in similarity.leader_clusters(df, "block", "no", "t").collect()}
    leaders, want = [], {}
    for i, t in enumerate(texts):
        own = similarity._bag(t)
        want[i] = next((k for k, b in leaders if similarity._cosine(own, b) >= 0.55), i)
        if want[i] == i:
            leaders.append((i, own))
    assert got == want


def test_word_rows_and_bands(spark):
    words = [(1, 10.0, 5.0, 10.0, "21"), (1, 11.0, 30.0, 10.0, "PN1"), (1, 40.0, 31.0, 10.0, "PN2"), (1, 41.0, 4.0, 10.0, "22"), (1, 41.0, 8.0, 10.0, "b")]
    df = spark.createDataFrame(words, "page int, top double, left double, height double, text string")
    out = layout.bucketed_rows(layout.row_islands(df, ["page"]), ["page"], [("ATA", 0, 20), ("PN", 20, 50)]).orderBy("row").collect()
    assert [(r["ATA"], r["PN"]) for r in out] == [("21", "PN1"), ("22 b", "PN2")]


def test_table_rows(spark):
    html = "<table><tr><td>21</td><td>100</td><td> x </td></tr></table>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(files.cells(F.col("h"), "td")).first()[0] == ["21", "100", "x"]
    rows = spark.createDataFrame([([["21", "100"], ["head", "row"], ["9", "05", "d"]],)], "r array<array<string>>")
    assert rows.select(files.table_rows(F.col("r"), ["ATA", "ZONE", "FIN"])).first()[0] == [{"ATA": "21", "ZONE": "100", "FIN": ""}]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "a" / "y.PDF").write_bytes(b"")
    found = files.scan_files(spark, f"file://{tmp_path}").orderBy("filename")
    assert [(r["filename"], r["status"]) for r in found.collect()] == [("x.pdf", "ok"), ("y.PDF", "NotDownloaded")]

    def reader(content):
        if not content:
            raise ValueError("empty")
        return content.decode().split("\f")

    pages = files.read_pages(found, reader).orderBy("path", "page").collect()
    assert [(r["page"], r["text"]) for r in pages] == [(1, "one"), (2, "two"), (0, "")] and "empty" in pages[2]["error"]
    (tmp_path / "t.csv").write_text('a,b\n1,\n"x\ny",2\n')
    assert [tuple(r) for r in files.read_delimited(spark, f"file://{tmp_path}/t.csv", ["a", "b"]).collect()] == [("1", ""), ("x\ny", "2")]
    (tmp_path / "o.json").write_text('{"f.pdf": ["B777", "B777-200"]}')
    assert [tuple(r) for r in files.read_overrides(spark, f"file://{tmp_path}/o.json").collect()] == [("f.pdf", "B777", "B777-200")]


def test_self_check(spark):
    df = spark.createDataFrame([("1", "2", "3"), ("1", "2", "4"), ("", "2", "2"), ("a", "2", "2"), ("1,000", "1", "1001")], "a string, b string, t string")
    assert [r[0] for r in df.select(quality.row_check([F.col("a"), F.col("b")], F.col("t"))).collect()] == ["OK", "MISMATCH", "SKIPPED", "UNPARSEABLE", "OK"]


def test_token_rows_keep_every_token(spark):
    lines = [("d", 1, "  AB12 PN-1 fuel pump SN9 2020-01-02 10 20 left  over "), ("d", 2, "PN-1 SN9 2020-01-02 10 20"), ("d", 3, "2020-01-02 10 20"), ("d", 4, "AB12 PN-1 SN9 2020-01-02 10"), ("d", 5, ""), ("d", 6, None)]
    out = forms.token_rows(spark.createDataFrame(lines, "doc_id string, line_no long, line string"), plans_forms.FITTED).orderBy("line_no").collect()
    assert [tuple(r)[1:] for r in out] == [(1, "AB12", "PN-1", "fuel pump", "SN9", "2020-01-02", "10", "20", "left over"), (2, "", "PN-1", "", "SN9", "2020-01-02", "10", "20", "")]


def test_metric_lines_before_any_component_are_left_out(spark):
    lines = [("d", 1, "Hours 9 9 9 9"), ("d", 2, "24110000 P1 PN-1 fuel pump 77 2020-01-02 Days 1 ? 3 4"), ("d", 3, "Hours 5 6 7 8"), ("d", 4, "Hours 0 0 0 0"), ("d", 5, None)]
    (row,) = forms.metric_rows(spark.createDataFrame(lines, "doc_id string, line_no long, line string"), plans_forms.TIMES).collect()
    assert (row["DESCRIPTION"], row["DAYS_SINCE_NEW"], row["DAYS_SINCE_FIT"], row["HOURS_SINCE_NEW"], row["LANDINGS_SINCE_NEW"]) == ("fuel pump", "1", "", "5", "")


def _plain_ruled(dark):
    runs, merged = [], []
    for x in dark:
        if runs and x - runs[-1][-1] <= 2:
            runs[-1].append(x)
        else:
            runs.append([x])
    for x in (sum(r) // len(r) for r in runs):
        if merged and x - merged[-1] <= 15:
            merged[-1] = (merged[-1] + x) // 2
        else:
            merged.append(x)
    spans = [(j - i, -i) for i in range(len(merged)) for j in range(i + 4, len(merged)) if all(b - a < 150 for a, b in zip(merged[i:j], merged[i + 1 : j + 1], strict=True))]
    n, i = max(spans, default=(0, 0))
    return merged, (merged[-i], merged[-i + n]) if n else None


def test_ruled_lines_and_their_longest_run(spark):
    rng = random.Random(1)
    pages = [[], [5], [1, 2, 3, 30, 31, 400], list(range(0, 600, 100)), *[sorted(rng.sample(range(1500), rng.choice([8, 20, 60]))) for _ in range(30)]]
    df = spark.createDataFrame(list(enumerate(pages)), "page int, dark array<int>").withColumn("lines", forms.ruled_lines(F.col("dark")))
    for r in df.withColumn("run", forms.dense_run(F.col("lines"))).collect():
        assert (r["lines"], tuple(r["run"]) if r["run"] else None) == _plain_ruled(pages[r["page"]])


def test_codes_tasks_pages_and_confidence(spark):
    line = lambda x: tuple(spark.range(1).select(forms.date_and_task(F.lit(x)).alias("f")).first()["f"])
    assert line("24 P1 28-02-2014CLEANING 1") == ("28-02-2014", "CLEANING") and line("04-OCT-13 x") == ("04-OCT-13", "") and line("none") == ("", "")
    codes = spark.createDataFrame([(x,) for x in ("10HQ", "AB", "12", "a1", "A1", "A1B2C3D4E5F", None)], "c string").select(forms.is_position_code(F.col("c"))).collect()
    assert [r[0] for r in codes] == [True, False, False, False, True, False, False]
    assert forms.long_pages(spark.createDataFrame([("x" * 99,), ("x" * 100,), (None,)], "text string")).count() == 1
    assert forms.confident(spark.createDataFrame([(30.0,), (30.5,), (None,)], "conf double")).count() == 1
