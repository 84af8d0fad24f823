"""Document fingerprints by locally consistent parsing.

A text's code points are parsed bottom-up. At each level runs of one name become one; deterministic coin tossing then
reduces the names: a name's label is the place and value of the lowest bit in which it differs from its left neighbour,
three times over, which leaves a few labels with no two neighbours alike. Local maxima of the labels begin phrases, of
two to a dozen names, and a phrase's name is a hash of its own names. Where a phrase begins depends on a few names on
either side alone, so equal substrings have equal phrases, but for their edges, at whatever offset they lie.

A fingerprint has the name of the whole text, the number of its distinct phrases, and the SKETCH smallest of their
hashes; phrases are those of LEVEL and above (some 30 code points and more), of a short text the highest there are.
likeness() estimates from two fingerprints the share of common phrases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import shuffle_partitions, with_columns_of
from quirelake.llm.shingles import mixed

LEVEL = 3
SKETCH = 64
#: Code points parsed at once.
SLICE = 1 << 19
_ONE = np.uint64(1)
_LENGTH = np.uint64(0xA0761D6478BD642F)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three rounds of coin tossing; a text's first name is compared with zero."""
    for _ in range(3):
        left = np.empty_like(names)
        left[1:] = names[:-1]
        left[first] = 0
        differ = names ^ left
        low = differ & (~differ + _ONE)
        place = np.bitwise_count(low - _ONE).astype(np.uint64)  # no difference: 64
        bit = (names & low) != 0
        names = place * np.uint64(2) + bit
    return names


def _phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: names of phrases, and where each text's begin. Every text has a name at least."""
    first = np.zeros(len(names), bool)
    first[starts] = True
    # runs
    keep = first.copy()
    keep[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(keep)
    run = np.diff(np.append(at, len(names))).astype(np.uint64)
    names, first = names[at], first[at]
    names = np.where(run > 1, mixed(names + run * _LENGTH), names)
    # landmarks
    label = _labels(names, first)
    n = len(names)
    begin = first.copy()
    rises = label[1:] > label[:-1]
    begin[1:] |= rises
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    begin[:-1] &= first[:-1] | last[:-1] | (label[:-1] >= label[1:])
    second = np.zeros(n, bool)
    second[1:] = first[:-1] & ~first[1:]
    begin &= ~second
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, size)
    up = np.add.reduceat(mixed(names + place.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3) + _ONE), at)
    return mixed(up + size.astype(np.uint64)), np.flatnonzero(first[at])


def _fingerprints(texts: list[str]) -> list[str]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    full = np.flatnonzero(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]]).astype(np.int64) if len(full) else np.empty(0, np.int64)
    names = mixed(codes + np.uint64(0x9E37))
    phrases: list[list[np.ndarray]] = [[] for _ in full]
    level, open_ = 0, np.arange(len(full))
    while len(open_):
        ends = np.append(starts[1:], len(names))
        alone = ends - starts == 1
        for i in range(len(open_)) if level >= LEVEL else np.flatnonzero(alone):
            phrases[open_[i]].append(names[starts[i] : ends[i]])
        # a text that has come down to one name is done
        names = names[np.repeat(~alone, ends - starts)]
        starts = np.concatenate([[0], np.cumsum((ends - starts)[~alone])])[:-1]
        open_ = open_[~alone]
        if len(open_):
            names, starts = _phrases(names, starts)
        level += 1
    out = [""] * len(texts)
    for i, own in zip(full, phrases, strict=True):
        root = own[-1][0]
        distinct = np.unique(np.concatenate(own))
        hashes = np.unique(mixed(distinct ^ np.uint64(0x2545F491)) >> np.uint64(32))[:SKETCH]
        out[i] = f"{root:016x}.{len(distinct):x}." + hashes.astype(">u4").tobytes().hex()
    return [x or "0.0." for x in out]


def fingerprints(texts: list[str]) -> list[str]:
    """Of each text; an empty one has a fingerprint of its own."""
    out: list[str] = []
    at = 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) <= SLICE):
            held += len(texts[upto])
            upto += 1
        out += _fingerprints(texts[at:upto])
        at = upto
    return out


def likeness(a: str, b: str) -> float:
    """Equal fingerprints: 1. Else an estimate of the common share of two texts' phrases, from the smallest hashes."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition(".")[2]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    # a sketch that is not full is the whole set
    both = np.union1d(x, y)[:SKETCH]
    return float(np.isin(both, x).__and__(np.isin(both, y)).sum() / len(both))


def _edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _part(table: pa.Table) -> pa.Table:
    """One range of doc_ids, and at its end the head of the next range."""
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), table["is_head"].to_pylist(), strict=True))
    rows.sort(key=lambda r: (r[2], r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    own = sum(not r[2] for r in rows)
    rows = rows[: own + 1] if own < len(rows) else rows + rows[:1]
    texts = [r[1] or "" for r in rows]
    edited = [_edited(texts[i], texts[i + 1]) for i in range(own)]
    prints, changed = fingerprints(texts), fingerprints(edited)
    columns = [
        pa.array([r[0] for r in rows[:own]], pa.int64()),
        pa.array([len(t) for t in texts[:own]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(prints[:own], pa.string()),
        pa.array(changed, pa.string()),
        pa.array([likeness(prints[i], changed[i]) for i in range(own)], pa.float64()),
        pa.array([likeness(prints[i], prints[i + 1]) for i in range(own)], pa.float64()),
    ]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in OUT.split(", ")])


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text), and of the text edited with the next row's.

    The next row is the next in descending order of doc_id, nulls last; rows of one doc_id follow in the order of their
    texts; the first follows the last, and a single row itself. A null text is empty: its fingerprint is that of the
    empty text, alike to itself alone. Repeated rows are rows each; an empty table has none. Other columns are not read.

    Rows are dealt to ranges of doc_id, of which there are a few for each shuffle partition, and each range gets a copy
    of the first row of the next one, so no order over the whole table is needed.
    """
    spark = docs.sparkSession
    rows = with_columns_of(docs, doc_id=T.LongType(), text=T.StringType())
    parts = 4 * shuffle_partitions(spark)
    bounds = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds), reverse=True)
    ranged = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(_position(F.col("doc_id"), bounds))
    numbered = rows.withColumn("part", ranged.cast("int"))
    # one row for each range: which doc_id heads it
    heads = sorted((r["part"], r["head"]) for r in numbered.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    to = [(heads[i][1], heads[i - 1][0], heads[i][0]) for i in range(len(heads))]
    heading = spark.createDataFrame(to, "head long, to_part int, of_part int")
    joined = numbered.join(F.broadcast(heading), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("part") == F.col("of_part")), "left")
    copies = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("is_head")), F.struct(F.col("to_part").alias("part"), F.lit(True).alias("is_head")))
    copies = F.filter(copies, lambda c: c["part"].isNotNull())
    dealt = joined.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.part", "c.is_head")
    return dealt.groupBy("part").applyInArrow(_part, OUT)


def _position(x: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are x or more: a search tree of comparisons."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])
    steps = len(bounds).bit_length()

    def step(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        over = (state["lo"] < state["hi"]) & (F.get(table, mid) >= x)
        hi = F.when((state["lo"] < state["hi"]) & ~over, mid).otherwise(state["hi"])
        return F.struct(F.when(over, mid + 1).otherwise(state["lo"]).alias("lo"), hi.alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), whole, step, lambda s: s["lo"])
