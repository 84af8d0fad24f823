"""Likeness of texts by bags of character trigrams, and leader clustering."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigram_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def trigram_bags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, n)."""
    t = trigram_text(F.col(text))
    grams = F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return df.select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def trigram_cosine(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, cosine) of each row of left with each of right that shares a trigram: a join on the trigrams."""

    def bag(df: DataFrame, name: str) -> DataFrame:
        grams = trigram_bags(df, key, text)
        norm = grams.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"norm_{name}"))
        return grams.join(norm, key).select(F.col(key).alias(name), "gram", F.col("n").alias(f"n_{name}"), f"norm_{name}")

    pairs = bag(left, "a").join(bag(right, "b"), "gram").groupBy("a", "b", "norm_a", "norm_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("dot"))
    return pairs.select("a", "b", (F.col("dot") / (F.col("norm_a") * F.col("norm_b"))).alias("cosine"))


def _bag(text: str) -> tuple[Counter, float]:
    s = " ".join((text or "").split()).lower()
    own = Counter(s[i : i + 3] for i in range(len(s) - 2))
    return own, math.sqrt(sum(n * n for n in own.values()))


def _cosine(a: tuple[Counter, float], b: tuple[Counter, float]) -> float:
    if not a[1] or not b[1]:
        return 0.0
    small, large = (a[0], b[0]) if len(a[0]) <= len(b[0]) else (b[0], a[0])
    return sum(n * large[g] for g, n in small.items()) / (a[1] * b[1])


def leader_clusters(df: DataFrame, block: str, order: str, text: str, threshold: float = 0.55) -> DataFrame:
    """df's (block, order, leader): within a block, in order, a row joins the first leader it is alike to, or leads.

    The result depends on the order, so a block is one task's work; a block is a set of like documents, such as those
    of one bucket of unrecognised forms, not the corpus.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        leaders: list[tuple] = []
        found = []
        for key, t in zip(group[order], group[text], strict=True):
            own = _bag(t)
            hit = next((k for k, b in leaders if _cosine(own, b) >= threshold), None)
            if hit is None:
                leaders.append((key, own))
                hit = key
            found.append(hit)
        return pd.DataFrame({block: group[block], order: group[order], "leader": found})

    types = dict(df.dtypes)
    return df.select(block, order, text).groupBy(block).applyInPandas(run, f"{block} {types[block]}, {order} {types[order]}, leader {types[order]}")


def representatives(similar: DataFrame, clusters: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(leader, key, mean): the k members of each cluster with the highest mean cosine to the others.

    similar: (a, b, cosine) within clusters; pairs that share nothing count 0.
    """
    from pyspark.sql import Window

    size = clusters.groupBy("leader").agg(F.count("*").alias("size"))
    total = similar.filter("a <> b").groupBy("a").agg(F.sum("cosine").alias("s"))
    mean = F.coalesce(F.col("s") / F.greatest(F.col("size") - 1, F.lit(1)), F.lit(0.0))
    scored = clusters.join(size, "leader").join(total, clusters[key] == total["a"], "left").withColumn("mean", mean)
    w = Window.partitionBy("leader").orderBy(F.desc("mean"), F.desc(key))
    return scored.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= k).select("leader", key, "mean")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """clusters, singletons, largest and the upper median of the sizes in descending order."""
    sizes = clusters.groupBy("leader").agg(F.count("*").alias("size"))
    ordered = F.sort_array(F.collect_list("size"), asc=False)
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest"), ordered.alias("o")).select(
        "clusters", "singletons", "largest", F.get("o", F.floor(F.size("o") / 2).cast("int")).alias("median")
    )
