"""What queries must not do as their tables grow: join every pair, trust a filter, meet in one task."""

import pytest
from pyspark.sql import functions as F

from quirelake.operators import layout, membership
from quirelake.operators.catalogue import CATALOGUE
from quirelake.plans import documents, records
from quirelake.sources import table_functions
from quirelake.sources import tables as sources


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables of a folder that a query can be given."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_pairs_of_a_large_nation_are_counted_not_made(spark, tables):
    n = 300_000
    customer = spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"))
    supplier = spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"))
    rows = records.pair_ladder(spark, tables(customer=customer, supplier=supplier)).collect()
    assert sum(r["pairs"] for r in rows) == n * n
    assert sum(r["pairs"] for r in rows if r["status"] == "manual_override") == n // 50 * n


def test_a_filters_yes_is_looked_up(spark):
    values = spark.range(400).select(F.concat(F.lit("pn"), F.col("id").cast("string")).alias("v"), (F.col("id") < 200).alias("listed"))
    blank = spark.createDataFrame([(" ", None), (None, None)], "v string, listed boolean")
    master = membership.master_values(values.filter("listed"), ["v"])
    bloom = membership.build_bloom(master, 0.5)
    alone = values.select("listed", membership.maybe_known(F.col("v"), bloom).alias("maybe"))
    assert alone.filter("maybe and not listed").count() > 0
    told = membership.confirmed(values.unionByName(blank), "v", bloom, master, "maybe")
    assert told.count() == 402 and told.filter("not (maybe <=> listed)").count() == 0


def test_parts_follow_the_size_of_the_files(spark, tables, monkeypatch):
    at = tables(lineitem=spark.range(5000).select(F.col("id").alias("l_orderkey")).repartition(3))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sources.spread(spark, at, "lineitem", "l_orderkey").rdd.getNumPartitions() == most
    monkeypatch.setattr(sources, "PART", 500)
    dealt = sources.spread(spark, at, "lineitem", "l_orderkey")
    assert dealt.rdd.getNumPartitions() > 2 * most and dealt.count() == 5000


def test_lines_and_words_are_not_joined_with_themselves(spark):
    text = ["REG: VP-1", "21 PN-9", "wrapped one", "wrapped two", "ATA 32 GEAR", "PN only", "Page 1", "wrapped after a foot", "REG: VP-2"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, "wrapped alone"), (2, 1, "22 PN-8")], "doc_id long, line_no long, line string")
    found = layout.extract(lines, documents.PRINTED)
    assert sorted(map(tuple, found.select("doc_id", "line_no", "NO", "PART", "NOTE", "ATA", "REG").collect())) == [
        (1, 1, "21", "PN-9", "wrapped one wrapped two", "", "VP-1"), (1, 5, "", "PN", "wrapped after a foot", "32", "VP-1"), (2, 1, "22", "PN-8", "", "", ""),
    ]
    words = spark.createDataFrame([("p", 1.0, 0.0, 10.0), ("p", 30.0, 0.0, 10.0), (None, 1.0, 0.0, 10.0)], "page string, top double, left double, height double")
    rows = layout.row_islands(words, ["page"])
    assert [r["row"] for r in rows.orderBy("top").collect()] == [0, 1]
    for df in (found, rows):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_squeezed_once_for_all_signatures(spark):
    table_functions.register(spark)
    signatures = sorted({s for f in CATALOGUE.formats for s in f.signatures})
    texts = [None, "", " ", "am os", "xAMOSx", "swiss-\nas.com", *signatures, *[s.lower().replace(" ", "\t\x0b\n ") for s in signatures], *[" ".join(s) for s in signatures]]
    spark.createDataFrame(list(enumerate(texts)), "i int, text string").createOrReplaceTempView("odd_texts")
    told = spark.sql(f"SELECT {', '.join(f"is_format(text, '{f.name}')" for f in CATALOGUE.formats)} FROM odd_texts ORDER BY i").collect()
    for i, f in enumerate(CATALOGUE.formats):
        words = [s.upper().split() for s in f.signatures]
        says = lambda t: any(" ".join(w) in " ".join(t.upper().split()) or len("".join(w)) >= 8 and "".join(w) in "".join(t.upper().split()) for w in words)  # noqa: B023, E731
        assert [r[i] for r in told] == [t is not None and says(t) for t in texts], f.name
        plan = spark.sql(f"SELECT is_format(text, '{f.name}') FROM odd_texts")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") <= 2, f.name


def test_a_document_is_one_row_of_its_table_function(spark):
    table_functions.register(spark)
    text = ["AMOS", "x" * 110, "21-22 AIR CONDITIONING see below", "P1 S1 FUEL PUMP NEW / 24310 3.Jan.2019 10 5", ",RAM AIR", "", "P2 S2 VALVE 11HB X/1 3.Jan.2019 1 2", ",RAM AIR", "P2 S2 VALVE 11HB X/1 3.Jan.2019 1 2", ",LAST"]
    rows = [(1, i, t) for i, t in enumerate(text, 1)] + [(2, 1, "\n".join(text)), (3, 1, "\n".join(text[:4])), (3, 5, "\n".join(text[4:])), (4, 1, None)]
    spark.createDataFrame(rows, "doc_id long, line_no long, line string").repartition(3).createOrReplaceTempView("whole_texts")
    got = spark.sql("SELECT * FROM read_format(TABLE(whole_texts) PARTITION BY (doc_id) ORDER BY (line_no), 'AMOS')").collect()
    of = lambda doc: sorted(tuple(r)[1:] for r in got if r["doc_id"] == doc)
    assert [(r[0], r[1], r[4]) for r in of(1)] == [(4, "21-22", "FUEL PUMP,RAM AIR"), (7, "21-22", "VALVE,RAM AIR"), (9, "21-22", "VALVE,LAST")]
    assert of(1) == of(2) == of(3) and len(got) == 9
