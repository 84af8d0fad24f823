"""Nearest neighbours by inner product over several shifted Hilbert orderings.

Equal vectors are one class with the ids it needs, so copies fill no window. Each curve projects the classes by a random
rotation of its own, shifts the grid, and orders the cells along a Hilbert curve; the order is cut into blocks at
quantiles of the keys. A query meets its own block and the neighbouring ones on every curve; the windows are merged and
reranked by the exact measure, which gives each query a threshold, its k-th score.

High-dimensional vectors without structure keep few neighbours together in any such order, so the windows alone can
miss most. The blocks of the first curve therefore have a ball each, and a query goes on to every one of them whose
ball could hold a score above its threshold: with structure these are few, without it all of them are searched, block
by block. Results are exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import shuffle_partitions, written

CURVES, PROJECTED, BITS = 4, 8, 7
#: Classes of a block, about; and the most blocks of a curve, which then get larger, and are split by hash.
BLOCK, MOST_BLOCKS = 1024, 4096
#: Scores of the matrix product may differ by rounding from the exact sum in order.
SLACK = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of unsigned coordinates) along the Hilbert curve, after Skilling's transform."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.view(np.int64)


def curve_keys(vectors: np.ndarray, curve: int, seed: int) -> np.ndarray:
    """Keys of directions: a random rotation's first coordinates, on a grid shifted for each curve."""
    rng = np.random.default_rng([seed, curve])
    d = vectors.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0][:, : min(PROJECTED, d)]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scaled = unit @ rotation * np.sqrt(d) / 8 + 0.5 + rng.uniform(-0.05, 0.05, rotation.shape[1])
    return hilbert_keys(np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order."""
    return np.add.accumulate(query[None, :] * vectors, axis=1)[:, -1]


def _matrix(blobs) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f8") for b in blobs])


def _best(query: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, classes: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """Of each query the k best classes that score its bound or more: (row of query, class, score)."""
    rough = query @ vectors.T
    slack = SLACK * (1 + np.abs(rough).max())
    some = np.flatnonzero(rough.max(1) >= bounds - slack)
    query, bounds, rough = query[some], bounds[some], rough[some]
    if not len(some):
        return
    k = min(k, rough.shape[1])
    least = np.maximum(np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k], bounds) - slack
    for i in range(len(query)):
        at = np.flatnonzero(rough[i] >= least[i])
        scores = exact_scores(query[i], vectors[at])
        for j in np.lexsort((classes[at], -scores))[:k]:
            if scores[j] >= bounds[i]:
                yield int(some[i]), int(classes[at[j]]), float(scores[j])


FOUND = "query long, cls long, score double"


def _search(k: int):
    def run(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(candidates) and len(queries):
            vectors, classes = _matrix(candidates["vec"]), candidates["cls"].to_numpy()
            for ids, bounds, blob in zip(queries["ids"], queries["bounds"], queries["vecs"], strict=True):
                own = np.frombuffer(ids, "<i8")
                found = _best(np.frombuffer(blob, "<f8").reshape(len(own), -1), np.frombuffer(bounds, "<f8"), vectors, classes, k)
                out += [(own[i], c, s) for i, c, s in found]
        return pd.DataFrame(out, columns=["query", "cls", "score"])

    return run


def _blocks_of(keys: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Of each curve the keys where its blocks begin: MOST_BLOCKS numbers at most."""
    blocks = max(1, min(MOST_BLOCKS, round(n / BLOCK)))
    at = [i / blocks for i in range(1, blocks)]
    if not at:
        return {c: np.empty(0, np.int64) for c in range(CURVES)}
    rows = keys.groupBy("curve").agg(F.percentile_approx("key", at, 100 * blocks).alias("b")).collect()
    return {r["curve"]: np.unique(np.array(r["b"], np.int64)) for r in rows}


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query (vec_id, embedding) its k nearest rows of vectors, without its own.

    Nearness is the inner product, larger first, then the smaller vec_id. A query with fewer candidates gets all.
    Vectors that are null, empty, zero, hold null or non-finite components, or have another length than most, take no
    part, nor do rows whose vec_id is null. A row that is repeated counts once; of
    several rows with one vec_id, the one of the least vector asks. A query is not answered with rows of its
    own vec_id. Without vectors there are no rows. Other columns are not read.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))

    rows, asked = sound(vectors), sound(queries)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = rows.filter(F.size("v") == width["d"]), asked.filter(F.size("v") == width["d"])

    # classes of equal vectors, each with the least ids that a query can need
    in_class = Window.partitionBy("name", "v").orderBy("vec_id")
    kept = rows.distinct().withColumn("name", F.xxhash64("v")).withColumn("no", F.row_number().over(in_class)).filter(F.col("no") <= k + 1)
    classes = written(kept.groupBy("name", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cls"), "v", "ids"), "classes")
    n = classes.count()

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = np.array(batch["v"].tolist(), float).reshape(len(batch), -1)
            for c in range(CURVES):
                yield pd.DataFrame({"id": batch["id"], "curve": np.int32(c), "key": curve_keys(m, c, seed) if len(m) else [], "vec": [x.tobytes() for x in m.astype("<f8")]})

    shape = "id long, curve int, key long, vec binary"
    on_curves = written(classes.select(F.col("cls").alias("id"), "v").mapInPandas(keyed, shape), "curves")
    bounds = _blocks_of(on_curves, n)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block = np.zeros(len(batch), np.int64)
            for c in range(CURVES):
                own = (batch["curve"] == c).to_numpy()
                block[own] = np.searchsorted(bounds[c], batch["key"].to_numpy()[own], side="right")
            yield batch.assign(block=block.astype(np.int32))[["id", "curve", "block", "vec"]]

    blocked = on_curves.mapInPandas(placed, "id long, curve int, block int, vec binary")
    # many keys alike make a large block: it is split by hash, and its queries meet every part
    sizes = {(r["curve"], r["block"]): -(-r["count"] // (4 * max(BLOCK, n // MOST_BLOCKS))) for r in blocked.groupBy("curve", "block").count().collect()}
    parts = spark.createDataFrame([(c, b, p) for (c, b), p in sizes.items()], "curve int, block int, parts int")
    candidates = written(blocked.join(F.broadcast(parts), ["curve", "block"]).select("curve", "block", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("cls"), "vec"), "blocks")

    def sent(rows: list[tuple[int, int, int]], ids: np.ndarray, m: np.ndarray, least: np.ndarray) -> Iterator[pd.DataFrame]:
        """(curve, block, row): queries of a batch by block and part, with the least scores that they still need."""
        if rows:
            table = pd.DataFrame(rows, columns=["curve", "block", "row"])
            out = []
            for (c, b), own in table.groupby(["curve", "block"]):
                i = own["row"].to_numpy()
                out += [(c, b, p, ids[i].astype("<i8").tobytes(), least[i].astype("<f8").tobytes(), m[i].astype("<f8").tobytes()) for p in range(sizes.get((c, b), 0))]
            yield pd.DataFrame(out, columns=["curve", "block", "part", "ids", "bounds", "vecs"])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = np.array(batch["v"].tolist(), float).reshape(len(batch), -1)
            if not len(m):
                continue
            todo = []
            for c in range(CURVES):
                at = np.searchsorted(bounds[c], curve_keys(m, c, seed), side="right")
                todo += [(c, int(b) + s, i) for i, b in enumerate(at) for s in (-1, 0, 1)]
            yield from sent(todo, batch["vec_id"].to_numpy(), m, np.full(len(m), -np.inf))

    # of several rows with a query's vec_id, the one of the least vector asks
    asked = written(asked.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    many = max(1, min(shuffle_partitions(spark), asked.count() // 64))
    spread = asked.repartition(many)
    sending = "curve int, block int, part int, ids binary, bounds binary, vecs binary"
    keys = ["curve", "block", "part"]

    def searched(queries: DataFrame) -> DataFrame:
        return candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(k + 1), FOUND)

    near = written(_merged(searched(spread.mapInPandas(windows, sending)), k + 1).select("query", "cls", "score"), "windows")

    # the first curve's blocks as balls
    def balls(group: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(group["vec"])
        center = m.mean(0)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "center": [center.tolist()], "radius": [float(np.linalg.norm(m - center, axis=1).max())]})

    found = candidates.filter("curve = 0").groupBy("block", "part").applyInPandas(balls, "block int, center array<double>, radius double").collect()
    numbers = np.array([r["block"] for r in found], np.int64)
    centers, radii = np.array([r["center"] for r in found]), np.array([r["radius"] for r in found])
    thresholds = near.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
    pending = spread.join(thresholds, F.col("vec_id") == F.col("query"), "left").select("vec_id", "v", "least")

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = np.array(batch["v"].tolist(), float).reshape(len(batch), -1)
            if not len(m):
                continue
            least = batch["least"].fillna(-np.inf).to_numpy()
            at = np.searchsorted(bounds[0], curve_keys(m, 0, seed), side="right")
            most = m @ centers.T + np.linalg.norm(m, axis=1)[:, None] * radii[None, :]
            go = most + SLACK >= least[:, None]
            seen = np.abs(numbers[None, :] - at[:, None]) <= 1
            todo = sorted({(0, int(numbers[b]), int(i)) for i, b in zip(*np.nonzero(go & ~seen), strict=True)})
            yield from sent(todo, batch["vec_id"].to_numpy(), m, least)

    both = near.unionByName(searched(pending.mapInPandas(rest, sending)))
    best = _merged(both, k + 1).select("query", "cls", "score")
    # a class stands for its rows
    answers = best.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
