"""Compaction and nearest neighbours; the queries of the subpackage and the pipeline's stages."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import compaction, hilbert_search

SF = "/root/testdata/sf0.001"


def test_merges_take_shards_of_a_size():
    s = [compaction.Shard(f"s{i}", 1000, i, i) for i in range(9)] + [compaction.Shard("big", 60_000_000, 0, 0), compaction.Shard("done", 90_000_000, 0, 0)]
    runs = compaction.merges(s, 128_000_000)
    assert [len(r) for r in runs] == [9] and all(x.size == 1000 for r in runs for x in r)
    many = [compaction.Shard(f"s{i}", 1000, i, i) for i in range(100)]
    assert [len(r) for r in compaction.merges(many, 128_000_000)] == [32, 32, 32, 4] and [len(r) for r in compaction.merges(many, 8000)] == [8] * 12 + [4]
    assert compaction.merges(s[:3], 128_000_000) == []


def test_store(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.read() is None
    df = spark.range(400).select("id", F.col("id").cast("string").alias("v")).coalesce(1)
    store.append(df.withColumn("a", (F.col("id") % 10).cast("int")), "a")
    assert store.version() == 10 and len(store.shards()) == 10
    before = store.shards(10)
    assert store.compact(keep_versions=True) == 1 and len(store.shards()) == 1
    assert sorted(r["id"] for r in store.read().collect()) == list(range(400)) == sorted(r["id"] for r in store.read(10).collect())
    assert not store.commit(10, before), "the version is taken"
    assert store.shards(10) == before


def test_two_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/store"

    def write(no):
        store = compaction.ShardStore(spark, root)
        for i in range(3):
            store.append(spark.range(10).select((F.col("id") + 100 * no + 10 * i).alias("id"), F.lit(i).alias("a")).coalesce(1), "a")
        return store.compact()

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, range(2)))
    store = compaction.ShardStore(spark, root)
    store.compact()
    assert sorted(r["id"] for r in store.read().collect()) == [100 * no + i for no in range(2) for i in range(30)]


def test_a_manifest_that_is_not_whole_is_no_version(spark, tmp_path, monkeypatch):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(spark.range(5).withColumn("a", F.lit(1)), "a")
    (tmp_path / "store/manifests/v00000002.json").write_text('{"version": 2, "sh')
    assert store.version() == 1 and not store.commit(1, [])
    monkeypatch.setattr(compaction, "DEAD", -1)
    assert store.commit(1, store.shards()) and store.version() == 2 and store.read().count() == 5
    assert not store.commit(1, []) and store.read().count() == 5, "a whole manifest is never taken away"
    (tmp_path / "store/manifests/v00000003.json").write_text("{")
    assert store._placed(f"{store._manifest(3)}.dead", b""), "another writer is about to take it away"
    assert not store.commit(2, []) and not list(tmp_path.glob("store/staged-*"))


def test_a_compaction_leaves_a_rival_s_merge(spark, tmp_path, monkeypatch):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(spark.range(400).coalesce(1).withColumn("a", (F.col("id") % 10).cast("int")), "a")
    rival, changed = compaction.ShardStore(spark, store.root), store._changed

    def late(change):
        monkeypatch.setattr(store, "_changed", changed)
        rival.compact()
        changed(change)

    monkeypatch.setattr(store, "_changed", late)
    assert store.compact() == 0
    assert sorted(r["id"] for r in store.read().collect()) == list(range(400))


def test_store_keeps_rows_without_arrival(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    df = spark.range(40).coalesce(1)
    for part in (df.filter("id < 20"), df.filter("id >= 20")):
        store.append(part.withColumn("a", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), "a")
    assert sorted(r["id"] for r in store.read().collect()) == list(range(40))
    assert [s.first for s in store.shards()] == [-1, 1, 2, -2, 1, 2]
    with pytest.raises(ValueError, match="whole"):
        store.append(df.withColumn("a", F.lit("x")), "a")
    store.compact()
    assert sorted(r["id"] for r in store.read().collect()) == list(range(40))


def test_sharded(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a", "z"), (3, "b", "w"), (3, "b", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _merge string")
    out = compaction.sharded(docs, arrivals=3)
    assert sorted(repr(tuple(r)[:3]) for r in out.collect()) == sorted(map(repr, rows))
    assert compaction.sharded(docs.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    n = 8
    cells = np.array([(x, y) for x in range(n) for y in range(n)])
    order = np.argsort(hilbert_search.hilbert_keys(cells, 3))
    assert sorted(hilbert_search.hilbert_keys(cells, 3).tolist()) == list(range(64))
    assert np.abs(np.diff(cells[order], axis=0)).sum(1).tolist() == [1] * 63


def plain_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)}]
    out = []
    for q, x in good:
        if q % 20 == 0:
            near = sorted((-float(np.add.accumulate(x * y)[-1]), i) for i, y in good if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 16])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(hilbert_search, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 230)]  # one vector of many rows
    rows += [(500, None), (520, [0.0] * 8), (540, [1.0, None] + [0.0] * 6), (560, [float("nan")] + [1.0] * 7), (580, [1.0]), (None, [1.0] * 8), rows[5], (600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted(tuple(r) for r in hilbert_search.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect())
    assert got == plain_nearest(rows, 20)


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in hilbert_search.nearest(df, df, 20).orderBy("query_id").collect()] == [(0, 1, 20, 0.0), (20, 1, 0, 0.0)]
    assert hilbert_search.nearest(df.limit(0), df.limit(0), 20).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert sorted(docs.columns) == sorted(columns), name
        sizes.append(docs.count())
    assert 200 >= sizes[0] >= sizes[1] == sizes[2] > 100
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert pieces.filter("n < 2048").count() <= 1 and pieces.filter("n > 2048").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["op5_nearest", "op10_ngram_join"])
def test_same_as_sql(spark, name):
    import duckdb

    from quirelake.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, there = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(there.columns)
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(r) for r in there.select(*df.columns).fetchall())


def test_rows_with_the_merges_own_column_keep_it(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", 1 << 20)
    for day in range(6):
        store.append(spark.createDataFrame([(day, f"m{day}")], "arrival int, _merge string"), "arrival")
    store.compact()
    assert sorted(r["_merge"] for r in store.read().collect()) == [f"m{d}" for d in range(6)] and len(store.shards()) < 6
