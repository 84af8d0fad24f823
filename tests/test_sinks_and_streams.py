import json

from pyspark.sql import functions as F

from quirelake.sources import sinks
from quirelake.streaming import arrivals


def test_order_and_cells(spark):
    assert sinks.canonical_order(["_page", "X", "PART_NUMBER", "ATA"], "OCCM") == ["ATA", "PART_NUMBER", "X", "_page"]
    assert sinks.canonical_order(["REMAINING", "_issues", "FIN", "ATA"], "HT") == ["ATA", "FIN", "REMAINING", "_issues"]
    assert sinks.canonical_order(["Z", "ATA"], "other") == ["Z", "ATA"]
    df = spark.createDataFrame([('a"b', None, "c,d")], "x string, y string, z string")
    assert sinks.csv_lines(df).first()[0] == '"a""b",,"c,d"'


def test_write_by_file_and_log(spark, tmp_path):
    df = spark.createDataFrame([("f1", "a"), ("f2", "b")], "source_file string, v string")
    sinks.write_by_file(df, f"file://{tmp_path}/csv", "OCCM")
    assert sorted(p.name for p in (tmp_path / "csv").glob("source_file=*")) == ["source_file=f1", "source_file=f2"]
    for _ in range(2):
        sinks.append_log(df, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 4


def test_rollup_and_envelope(spark):
    df = spark.createDataFrame([("v", str(i), "" if i else "ATA:empty") for i in range(10)], "variant string, ATA string, _issues string")
    out = json.loads(sinks.rollup_json(df, "variant").first()["value"])
    assert out["rows"] == 10 and len(out["sample"]) == 8
    assert json.loads(sinks.result_envelope(df, "OCCM", "v"))["summary"] == {"total": 10, "clean": 9, "flagged": 1, "imputed": 0}


def test_streams(spark, tmp_path):
    schema = spark.createDataFrame([], "aircraft_key string, position string, report_date_iso string, id int").schema
    at = f"file://{tmp_path}"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")

    def run():
        rows = arrivals.arriving(spark, f"{at}/in", schema)
        arrivals.log_arrivals(rows, f"{at}/log", f"{at}/c1").awaitTermination()
        arrivals.keep_current(rows, f"{at}/now", f"{at}/c2", ["aircraft_key", "position"], "report_date_iso", ["id"]).awaitTermination()

    arrive(("a", "p", "2020-01-02", 1), ("a", "q", "", 2))
    run()
    arrive(("a", "p", "2020-01-01", 3), ("a", "q", "2019-01-01", 4))  # one is late
    run()
    assert sorted(r["id"] for r in arrivals.current(spark, f"{at}/now").collect()) == [1, 4]
    assert spark.read.parquet(f"{at}/log").count() == 4


def test_windowed_counts(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 00:01:00' ts, 'a' k union all select timestamp'2024-01-01 00:02:00', 'a' union all select timestamp'2024-01-01 01:00:00', 'b'")
    df.write.parquet(f"file://{tmp_path}/e")
    rows = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/e")
    q = arrivals.windowed_counts(rows, "ts", "k").writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").filter(F.col("k") == "a").first()["n"] == 2
