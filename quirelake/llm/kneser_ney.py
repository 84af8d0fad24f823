"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary texts.

A class knows its words by continuation counts: before how many different words a word stands in its texts, so a
passage that is copied a thousand times counts once. Above them are the class's own bigrams, counted by the words before
these; what their discount takes off goes to the bigrams of both classes together, and from there to the class's words.
Below the classes lies one table of continuation counts of both together, and below that the uniform distribution. A rare
expression thus gets the same backing in either class and says little; one that a class uses in many places often says
much. A text's score compares the two mean log-likelihoods per word, by a logistic curve fitted to labelled texts that
the counts leave out. The curve sees the difference over all words, and beside it what words say beyond MARGIN.

Counts are kept by the 64-bit hashes of words and bigrams in a written table that grows with the labelled texts. Workers
get the part of it that can change a score: words in more than one place, the bigrams above their discount, and the words
that such a bigram begins with, for what they leave to the words below. All other words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import lean, shuffle_partitions, small_batches, with_columns_of, written
from quirelake.llm.shingles import mixed, word_hashes

#: Words that the uniform distribution is over at least; more if more are counted.
LEAST_WORDS = 1 << 20
#: Discounts of continuation counts: of words in both classes together, in one, and of bigrams likewise.
SHARED_DISCOUNT, DISCOUNT, SHARED_BIGRAM_DISCOUNT, BIGRAM_DISCOUNT = 1.0, 2.0, 10.0, 10.0
#: A class's counts of common words differ by chance; a word tells for certain what its log-likelihoods differ by beyond this.
MARGIN = 2.5
#: Of a bigram's likelihood, the share of its own count at most: a word is never certain, nor another impossible.
MOST_KEPT = 0.95
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3

# bytes between words: all but letters, digits and those of other scripts
_BETWEEN = np.ones(256, bool)
_BETWEEN[np.r_[48:58, 65:91, 97:123, 128:256]] = False
_BEGIN = np.uint64(0x5BD1E995)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_CLASSES = ("ordinary", "toxic")
_SUMS = ["after"] + [f"{kind}{c}" for kind in ("", "after_", "over_") for c in _CLASSES]
#: Rows of the curve's texts that are summed at once.
_ROWS = 1 << 16


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    return word_hashes([(t or "").encode() for t in texts], _BETWEEN)


def _bigrams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bigram with the one before it, and that one."""
    before = np.concatenate([[_BEGIN], words[:-1]])
    return mixed(before * _STEP + words), before


class Model:
    """The log-ratio of a word's likelihoods after another in toxic and in ordinary texts."""

    def __init__(self, words: pa.Table, left: pa.Table, bigrams: pa.Table, unknown: float):
        """Log-ratios of words below the bigrams, of what first words leave to these, of bigrams, and of all other words."""
        hashed = lambda t, c: t.column(c).to_numpy().view(np.uint64)
        self.words, self.left = _Ratios(hashed(words, "word"), words), _Ratios(hashed(left, "before"), left)
        self.bigrams = _Ratios(mixed(hashed(bigrams, "before") * _STEP + hashed(bigrams, "word")), bigrams)
        self.unknown = unknown

    def ratios(self, words: np.ndarray) -> tuple[float, float]:
        """The difference of the mean log-likelihoods, and what is left of it less MARGIN for each word; no words, none."""
        if not len(words):
            return 0.0, 0.0
        pairs, before = _bigrams(words)
        known, own = self.words(words)
        paired, both = self.bigrams(pairs)
        apart = np.where(paired, both, np.where(known, own, self.unknown) + self.left(before)[1])
        told = known & ((np.abs(own) > MARGIN) | (abs(self.unknown) > MARGIN)) | paired & (np.abs(both) > MARGIN)
        telling = np.where(told, apart, self.unknown)
        telling = np.sign(telling) * np.maximum(np.abs(telling) - MARGIN, 0)
        return float(apart.mean(dtype=np.float64)), float(telling.mean(dtype=np.float64))

    def ratio(self, words: np.ndarray) -> float:
        """The second of `ratios`."""
        return self.ratios(words)[1]


class _Ratios:
    """A sorted table from hashes to log-ratios."""

    def __init__(self, keys: np.ndarray, rows: pa.Table):
        order = np.argsort(keys)
        self.keys = np.append(keys[order], ~np.uint64(0))  # ends the table, so that a search always points into it
        self.ratios = np.append(rows.column("ratio").to_numpy()[order], 0).astype(np.float32)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their log-ratios, else 0."""
        at = np.searchsorted(self.keys, keys)
        there = (self.keys[at] == keys) & (at < len(self.keys) - 1)
        return there, np.where(there, self.ratios[at], np.float32(0))


def features(ratios: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the curve sees of a text: the ratios per word, and the number of words, which tells how far to trust them."""
    whole, ratio = ratios.reshape(-1, 2).T
    n = np.maximum(words, 1)
    log, root = np.log(n), np.sqrt(n)
    telling = [ratio, log, ratio * log, ratio * root, log**2, np.maximum(ratio, 0) * root, ratio * np.abs(ratio)]
    return np.stack([*telling, whole, whole * log, whole * root], 1)


class Curve:
    """A logistic curve."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """Fitted by Newton's method with a light ridge; texts of one class alone give their share."""
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.w = np.zeros(x.shape[1] + 1)
        self.w[0] = np.log(rate / (1 - rate))
        for _ in range(60 if len(np.unique(y)) > 1 else 0):
            bend, slope = 0.1 * np.eye(len(self.w)), 0.1 * self.w
            for i in range(0, len(y), _ROWS):
                z = self._z(x[i : i + _ROWS])
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                bend, slope = bend + (z.T * (p * (1 - p))) @ z, slope + z.T @ (p - y[i : i + _ROWS])
            step = np.linalg.solve(bend, slope)
            self.w -= step
            if np.abs(step).max() < 1e-9:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.w, -30, 30)))


def _known(batch: pa.RecordBatch, labels: tuple[np.ndarray, np.ndarray]) -> tuple[list[str | None], np.ndarray]:
    """Of a batch (doc_id, text) the texts of the doc_ids that have a label, and these."""
    ids, toxic = labels
    own = batch.column(0).to_numpy()
    at = np.searchsorted(ids[:-1], own)
    there = (ids[at] == own) & (toxic[at] >= 0)
    return batch.column(1).filter(pa.array(there)).to_pylist(), toxic[at[there]].astype(np.int64)


def _counts(parts: int, labels):
    """Distinct bigrams with what precedes them, by part: all that the tables need can be counted part by part."""
    # what precedes a bigram, by half a hash whose last bit gives way to the class
    kinds = np.dtype([("word", "<u8"), ("before", "<u8"), ("pre", "<u4")])

    def changes(*columns: np.ndarray) -> np.ndarray:
        """Where a row of sorted ones differs from the one before it."""
        change = np.zeros(len(columns[0]), bool)
        change[:1] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        return change

    def distinct(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows["pre"], rows["before"], rows["word"]))]
        return rows[changes(rows["word"], rows["before"], rows["pre"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            rows = distinct(np.concatenate(held))
            part = (mixed(rows["before"] * _STEP + rows["word"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([rows[order[cuts[p] : cuts[p + 1]]].tobytes() for p in full], pa.binary())], names=["part", "blob"])

        for batch in batches:
            texts, toxic = _known(batch, labels.value)
            for words, t in zip(words_of(texts), toxic.tolist(), strict=True):
                if not len(words):
                    continue
                row = np.empty(len(words), kinds)
                row["word"], row["before"] = words, np.concatenate([[_BEGIN], words[:-1]])
                pre = np.concatenate([[_BEGIN], row["before"][:-1]]) >> np.uint64(32)
                row["pre"] = pre & np.uint64(0xFFFFFFFE) | np.uint64(t)
                held.append(row)
                size += len(row)
            if size > 1 << 20:
                yield sent()
                held.clear()
                size = 0
        if size:
            yield sent()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = distinct(np.concatenate([np.frombuffer(b, kinds) for b in group["blob"]]))
        pair = changes(rows["word"], rows["before"])
        no, toxic = np.cumsum(pair) - 1, rows["pre"] & 1
        word, before = rows["word"][pair], rows["before"][pair]
        n = [np.bincount(no[toxic == c], minlength=len(word)) for c in (0, 1)]
        over = [np.maximum(x - int(BIGRAM_DISCOUNT), 0) for x in n]
        keys, at = np.unique(np.concatenate([word, before]), return_inverse=True)
        of_word, of_before = np.split(at, 2)
        every = np.bincount(no[pair | changes(rows["pre"] >> 1)])
        above = every > min(SHARED_BIGRAM_DISCOUNT, BIGRAM_DISCOUNT)
        none = np.zeros(int(above.sum()), np.int64)

        def column(at: np.ndarray, of_keys: np.ndarray, of_bigrams: np.ndarray) -> np.ndarray:
            return np.concatenate([np.bincount(at, of_keys, len(keys)).astype(np.int64), of_bigrams])

        return pd.DataFrame({
            "bigram": np.repeat([False, True], [len(keys), len(none)]),
            "before": np.concatenate([np.zeros(len(keys), np.int64), before[above].view(np.int64)]),
            "word": np.concatenate([keys, word[above]]).view(np.int64),
            "ordinary": column(of_word, n[0] > 0, none),
            "toxic": column(of_word, n[1] > 0, none),
            "after": column(of_before, every, every[above]),
            "after_ordinary": column(of_before, n[0], n[0][above]),
            "after_toxic": column(of_before, n[1], n[1][above]),
            "over_ordinary": column(of_before, over[0], over[0][above]),
            "over_toxic": column(of_before, over[1], over[1][above]),
        })

    return run, merge


def _counted(docs: DataFrame, labels, parts: int) -> DataFrame:
    """Counts of the texts (doc_id, text) that have labels, as a written table with a row of each word and of each bigram.

    Of a word, in ordinary and in toxic texts: the kinds of words before it; the kinds of words before the bigrams that
    it begins (after; that of both classes together too), and how far these exceed the discount (over). Of a bigram above
    a discount: the kinds of words before it (after), and how far they exceed it (over).
    """
    run, merge = _counts(parts, labels)
    rows = docs.select("doc_id", "text").mapInArrow(lean(run), "part int, blob binary").groupBy("part")
    rows = rows.applyInPandas(merge, "bigram boolean, before long, word long, " + ", ".join(f"{c} long" for c in _SUMS))
    return written(rows.groupBy("bigram", "before", "word").agg(*[F.sum(c).alias(c) for c in _SUMS]), "counts")


def _model(counts: DataFrame) -> Model:
    """The driver gets the words and bigrams that can change a score."""
    words, bigrams = counts.filter("not bigram"), counts.filter("bigram")
    both = F.col("ordinary") + F.col("toxic")
    kinds = {"both": (both, SHARED_DISCOUNT), "ordinary": (F.col("ordinary"), DISCOUNT), "toxic": (F.col("toxic"), DISCOUNT)}
    over = {k: F.greatest(c - F.lit(d), F.lit(0.0)) for k, (c, d) in kinds.items()}
    got = words.agg(F.sum((both > 0).cast("long")).alias("n"), *[F.sum(c).alias(k) for k, (c, _) in kinds.items()], *[F.sum(c).alias(f"{k}_kept") for k, c in over.items()]).first()
    total = {k: max(float(got[k] or 0), 1.0) for k in kinds}
    left = {k: 1 - (got[f"{k}_kept"] or 0.0) / total[k] for k in kinds}
    below = over["both"] / total["both"] + left["both"] / max(got["n"] or 0, LEAST_WORDS)
    lower = {k: over[k] / total[k] + F.lit(left[k]) * below for k in ("ordinary", "toxic")}
    # a word in one place is like one in none, and is left out
    unknown = float(np.log(left["toxic"] / left["ordinary"]))
    apart = lambda toxic, ordinary: F.log(toxic / ordinary).cast("float")
    likely = words.select("word", (both > 1).alias("known"), *[c.alias(k) for k, c in lower.items()], apart(lower["toxic"], lower["ordinary"]).alias("ratio"))
    # of each first word, what its bigrams leave to the words below; all of it where a class has none
    firsts = words.filter(F.col("after") > 0).select(
        F.col("word").alias("before"),
        F.col("after").alias("all"),
        *[F.greatest(F.col(f"after_{c}"), F.lit(1)).alias(f"all_{c}") for c in _CLASSES],
        *[(1 - F.col(f"over_{c}") / F.greatest(F.col(f"after_{c}"), F.lit(1)) * MOST_KEPT).alias(f"left_{c}") for c in _CLASSES],
    )
    pairs = bigrams.select("before", "word", "after", *[f"over_{c}" for c in _CLASSES]).join(likely.drop("ratio", "known"), "word").join(firsts, "before")
    kept = F.greatest(F.col("after") - F.lit(SHARED_BIGRAM_DISCOUNT), F.lit(0.0)) / F.col("all") * MOST_KEPT
    full = {c: F.col(f"over_{c}") / F.col(f"all_{c}") * MOST_KEPT + F.col(f"left_{c}") * (kept + (1 - kept) * F.col(c)) for c in _CLASSES}
    pairs = pairs.select("before", "word", apart(full["toxic"], full["ordinary"]).alias("ratio"))
    return Model(
        likely.filter("known").select("word", "ratio").toArrow(),
        firsts.filter("left_ordinary < 1 or left_toxic < 1").select("before", apart(F.col("left_toxic"), F.col("left_ordinary")).alias("ratio")).toArrow(),
        pairs.toArrow(),
        unknown,
    )


def _sorted_labels(known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids and their labels, nine bytes for each; the last entry is none."""
    ids = known.column("label_id").to_numpy()
    order = np.argsort(ids)
    return np.append(ids[order], 0), np.append(known.column("toxic").to_numpy()[order], -1).astype(np.int8)


def _scored(texts: list[str | None], model: Model) -> np.ndarray:
    words = words_of(texts)
    return features(np.array([model.ratios(w) for w in words]), np.array([len(w) for w in words]))


def _curve_rows(shared, labels):
    """What the curve is fitted to, of texts that have labels: label, number of words, ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = _known(batch, labels.value)
            words = words_of(texts)
            ratios = np.array([shared.value.ratios(w) for w in words], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array([len(w) for w in words], pa.int64()), pa.array(ratios[:, 0]), pa.array(ratios[:, 1])], names=["toxic", "words", "whole", "ratio"])

    return run


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, curve = shared.value
        for batch in batches:
            score = curve(_scored(batch.column(1).to_pylist(), model))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from: crc32 of the doc_id as text, modulo 4, is 2. A null doc_id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, Curve]:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic), all of them but those held out.

    A doc_id with several labels is toxic if one says so; null labels and doc_ids are passed over. Of the remainders
    0, 1 and 3 of crc32, the first two give the counts and the last the curve. No labels: every score is a half.
    """
    spark = docs.sparkSession

    def fold(doc_id: str) -> Column:
        return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4

    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(fold("label_id") != 2)
    known = known.groupBy("label_id").agg((F.max("toxic") > 0).cast("byte").alias("toxic"))
    at = spark.sparkContext.broadcast(_sorted_labels(known.toArrow()))

    # only labels go to the workers, no text is moved
    own = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    model = _model(_counted(own.filter(fold("doc_id") < 2), at, 4 * shuffle_partitions(spark)))
    rest = own.filter(fold("doc_id") == 3).mapInArrow(lean(_curve_rows(spark.sparkContext.broadcast(model), at)), "toxic long, words long, whole double, ratio double").toPandas()
    return model, Curve(features(rest[["whole", "ratio"]].to_numpy(float), rest["words"].to_numpy()), rest["toxic"].to_numpy(float))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    score, from 0 to 1, is the higher the likelier the text is toxic; a null text counts as empty, and an empty one or
    one without words has the score of no evidence. predicted is 1 from THRESHOLD on. Repeated rows are scored each;
    an empty table has no rows. Labels, lang, source and doc_id are no inputs of a score. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = with_columns_of(docs, doc_id=T.LongType(), text=T.StringType())
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels))
    scored = rows.mapInArrow(lean(_scores(shared)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns."""
    small_batches(docs.sparkSession)
    rows = with_columns_of(docs, doc_id=T.LongType(), text=T.StringType())
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, curve = shared.value
        at = schema.names.index(text)
        for batch in batches:
            yield batch.filter(pa.array(curve(_scored(batch.column(at).to_pylist(), model)) < THRESHOLD))

    return docs.mapInArrow(lean(run), schema)
