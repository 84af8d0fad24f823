"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws.

A source's documents fall by hash into blocks of about the same number of words. Its target, in whole words, is met
exactly: the blocks in a permuted order, all of them as often as the target holds the source whole, then the first of
them up to the target; in the block where it is reached, documents in a permuted order up to it, the last one cut.
The draws of all sources are then dealt to the output shards by a binary tree: at each node the sources' numbers are
split between the two halves by one multivariate hypergeometric draw, so that each shard has its exact size and no
order of the sources shows. A shard takes the next draws of each source's permuted sequence, which are disjoint by
construction, and orders its rows by hash.

What the driver holds is a few numbers for each block, of which there are BLOCKS_PER_SHARD for each shard, and for
each source. Shards, where their number is not given, follow from the words alone, up to MOST_SHARDS, and all is seeded:
reruns agree, whatever the session's settings.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import with_columns_of, written

WEIGHTS = (5.0, 2.0, 1.0)
#: All targets together, in words of all documents; and a source's most, in its own.
SHARE, MOST = 1.5, 2.0
#: Blocks that a shard is made of, about.
BLOCKS_PER_SHARD = 16
#: Words of a shard, about; and shards at most, which then are larger.
SHARD_WORDS, MOST_SHARDS = 1 << 20, 4096
#: Most rows of the plan that is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Of sources in order: shares of share * sum(sizes) by repeating weights, none above most times its size.

    What a source cannot take is shared by weight among the others until none is above.
    """
    n = len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    out, open_ = [0.0] * n, list(range(n))
    left = share * float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        full = [i for i in open_ if left * w[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if out[i] == 0 and i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, capacities: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The splitting tree: (shards, sources) numbers with the given sums both ways."""
    if len(capacities) == 1:
        return quotas[None, :]
    half = len(capacities) // 2
    left = rng.multivariate_hypergeometric(quotas, int(capacities[:half].sum()), method="marginals")
    return np.concatenate([split_quotas(left, capacities[:half], rng), split_quotas(quotas - left, capacities[half:], rng)])


def plan(sizes: list[int], goal: list[float], words: dict, shards: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    """Draws (source, block, turn, shard) of whole blocks, and (source, block, turn, shard, words) of cut ones."""
    rng = np.random.default_rng(seed)
    sequences, cut = [], {}
    by_source: dict[int, list[int]] = {i: [] for i in range(len(sizes))}
    for s, block in sorted(words):
        by_source[s].append(block)
    for s, size in enumerate(sizes):
        blocks, want, turn, own = by_source[s], round(goal[s]), 0, []
        while want > 0 and size > 0:
            order = rng.permutation(len(blocks))
            for i in order:
                n = words[s, blocks[i]]
                if want <= 0:
                    break
                if n:
                    own.append((blocks[i], turn))
                    if n > want:
                        cut[s, blocks[i], turn] = want
                    want -= n
            turn += 1
        sequences.append(own)
    quotas = np.array([len(x) for x in sequences], np.int64)
    total = int(quotas.sum())
    capacities = np.full(shards, total // shards, np.int64)
    capacities[: total % shards] += 1
    counts = split_quotas(quotas, capacities, rng) if len(quotas) else np.zeros((shards, 0), np.int64)
    whole, parts, at = [], [], np.zeros(len(sizes), np.int64)
    for shard in range(shards):
        for s in np.flatnonzero(counts[shard]):
            for block, turn in sequences[s][at[s] : at[s] + counts[shard, s]]:
                key = (int(s), int(block), turn)
                (parts.append((*key, shard, int(cut[key]))) if key in cut else whole.append((*key, shard)))
            at[s] += counts[shard, s]
    return whole, parts


def _with_size(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumns({"size": word_count(text), "row_hash": F.xxhash64(F.col("doc_id").cast("long"), text)})


def _planned(rows: DataFrame, shards: int | None, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """Of rows (source, row_hash, size): the sources with their targets, each block's takings, and how many shards there are.

    The first table has a row for each source; the second, for each block, an array of (turn, shard, words), words
    null where the whole block is taken, and the least of these words as `cut`.
    """
    spark = rows.sparkSession
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in found]
    goal = targets(sizes)
    shards = shards or min(MOST_SHARDS, max(1, round(sum(goal) / SHARD_WORDS)))
    per_block = max(1.0, SHARE * sum(sizes) / (shards * BLOCKS_PER_SHARD))
    fields = "source_name string, source_no int, n_blocks long, source_size long, target double"
    sources = spark.createDataFrame([(r["source"], i, max(1, round(r["n"] / per_block)), r["n"], goal[i]) for i, r in enumerate(found)], fields)
    blocked = _in_blocks(rows, sources, len(found))
    words = {(r["source_no"], r["block"]): r["n"] for r in blocked.groupBy("source_no", "block").agg(F.sum("size").alias("n")).collect()}
    whole, parts = plan(sizes, goal, words, shards, seed)
    taken: dict[tuple[int, int], list[tuple]] = {}
    for s, block, turn, shard, *want in [*whole, *parts]:
        taken.setdefault((s, block), []).append((turn, shard, want[0] if want else None))
    fields = "source_no int, block long, turns array<struct<turn:int,shard:int,words:long>>"
    blocks = spark.createDataFrame([(s, b, sorted(t, key=lambda x: x[0])) for (s, b), t in taken.items()], fields)
    return sources, blocks, shards


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _in_blocks(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    named = rows.join(_small(sources, n_sources), F.col("source").eqNullSafe(F.col("source_name")))
    return named.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "row_hash"), F.col("n_blocks"))).drop("source_name", "n_blocks")


def _taken(rows: DataFrame, narrow: DataFrame, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    """rows (source, row_hash, size, ...) with source_size, target and takings, an array of (turn, shard, words); and the shards."""
    sources, blocks, shards = _planned(narrow, shards, seed)
    n_blocks = blocks.count()
    named = _in_blocks(rows, sources, sources.count()).join(_small(blocks, n_blocks), ["source_no", "block"], "left")
    is_cut = F.coalesce(F.exists("turns", lambda t: t["words"].isNotNull()), F.lit(False))
    whole = named.filter(~is_cut).withColumn("before", F.lit(0).cast("long"))
    # at most one block of a source is cut; its documents in a permuted order
    order = Window.partitionBy("source_no", "block").orderBy(F.xxhash64(F.lit(seed), "row_hash"), "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    cut = named.filter(is_cut).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))

    def words(t: Column) -> Column:
        left = F.when(t["words"].isNull(), F.col("size")).otherwise(t["words"] - F.col("before"))
        return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")

    takings = F.transform(F.coalesce("turns", F.array().cast("array<struct<turn:int,shard:int,words:long>>")), lambda t: F.struct(t["turn"].alias("turn"), t["shard"].alias("shard"), words(t).alias("words")))
    both = whole.unionByName(cut).withColumn("takings", F.filter(takings, lambda t: t["words"] > 0))
    return both.drop("turns", "before", "source_no", "block"), shards


def _narrow(docs: DataFrame) -> DataFrame:
    rows = with_columns_of(docs, doc_id=T.LongType(), text=T.StringType(), source=T.StringType())
    return written(_with_size(rows).drop("text"), "sizes")


def taken(docs: DataFrame, shards: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, takings) of every row of docs (doc_id, text, source): what a mix takes of it.

    takings has a (turn, shard, words) for each time; words is the size but for one document of a source. A null text
    has size 0, as an empty one; such documents, and sources without a word, are never taken. A null source is a source
    of its own, the last. Repeated rows are documents each, taken alike but for a block that is cut. An empty table has no rows. Other
    columns are not read.
    """
    narrow = _narrow(docs)
    return _taken(narrow, narrow, shards, seed)[0].select("doc_id", "size", "source_size", "target", "takings")


def first_words(text: Column, words: Column) -> Column:
    """text up to the end of its first words, as it is: the words and what stands before each are added up."""
    lengths = lambda parts: F.aggregate(F.slice(parts, F.lit(1), words.cast("int")), F.lit(0), lambda n, p: n + F.length(p))
    return F.substring(text, F.lit(1), lengths(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))) + lengths(F.split(text, WORD, -1)))


def mix(docs: DataFrame, shards: int | None = None, seed: int = 42) -> DataFrame:
    """The mixed rows themselves: docs' columns, a row for each taking, dealt to shards and there in a shuffled order.

    A document taken in part has the first of its words, and n_chars, if there, is set to the new length. Columns of
    docs named like this operator's own (size, row_hash, takings and so on) keep their values. See taken().
    """
    narrow = _narrow(docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").cast("string").alias("text"), F.col("row.source").cast("string").alias("source")
    )
    both, shards = _taken(_with_size(packed), narrow, shards, seed)
    rows = both.select("row", "text", "size", "row_hash", F.explode("takings").alias("t"))
    text = F.when(F.col("t.words") < F.col("size"), first_words(F.col("text"), F.col("t.words"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).repartitionById(shards, F.col("t.shard")).sortWithinPartitions("t.shard", F.xxhash64(F.lit(seed), "row_hash", "t.turn"))
    own = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("t.words") < F.col("size"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
