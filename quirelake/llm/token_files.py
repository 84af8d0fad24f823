"""Token files: the ids of documents end to end, with Elias-Fano coded boundaries.

A file is made of segments, each whole in itself and at most a few megabytes; a segment is one row (shard, seq,
n_docs, n_tokens, start, payload) of a Parquet table, so that any store Spark reads can hold it, and a failed task's
rows never show. Shards follow the order of doc_id, nulls first; segments follow each other within a shard.
`start` counts the ids before the segment in its shard; the ids before a shard are summed from the other columns.

Payload, little-endian:
  magic "EFTK", version u16, bytes of an id u16, documents u64, of these without a doc_id u64, ids u64,
  least doc_id i64, low bits of boundaries u32, of doc_ids u32, byte counts of the parts u64 x 7, then the parts:
  ids | of the boundaries, then of the doc_ids less the least: low bits, high bits in unary, samples: the place of every
  64th one of these
The boundaries (0, ..., ids) are monotone: n + 1 values under u take about n * (2 + log2(u / n)) bits, against 64 n
for a table, and so are the doc_ids. select(i) starts at a sample and counts ones from there; what is read back comes
from it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.chunk_tokenizer import ChunkTokenizer
from quirelake.llm.common import fresh_path, shuffle_partitions, small_batches, with_columns_of

_HEAD = struct.Struct("<4sHHQQQqII7Q")
_EVERY = 64
#: Ids of a segment; one document more may go over it.
SEGMENT_IDS = 1 << 18

SEGMENT = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
DECODED = "doc_id long, at long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A monotone sequence of whole numbers with select()."""

    def __init__(self, low: np.ndarray, high: np.ndarray, samples: np.ndarray, n: int, low_bits: int):
        self.low, self.high, self.samples, self.n, self.low_bits = low, high, samples, n, low_bits

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::_EVERY].astype("<u4"), n, low_bits)

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        span = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return span >> (first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from a sample and the few bytes after it."""
        at, left = int(self.samples[i // _EVERY]), i % _EVERY
        byte, skip = divmod(at, 8)
        word = int(self.high[byte]) >> skip << skip
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every value in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)) << self.low_bits
        if not self.low_bits:
            return high
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (low.astype(np.int64) << np.arange(self.low_bits)).sum(1)


def encode_segment(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """doc_ids ascending, nulls first; bounds: where each document's ids begin, and their number."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    both = EliasFano.of(bounds.astype(np.uint64)), EliasFano.of(np.array([x - least for x in known], np.uint64))
    parts = [ids.astype(f"<u{width}").tobytes(), *(x.tobytes() for ef in both for x in (ef.low, ef.high, ef.samples))]
    return _HEAD.pack(b"EFTK", 2, width, len(doc_ids), len(doc_ids) - len(known), len(ids), least, both[0].low_bits, both[1].low_bits, *map(len, parts)) + b"".join(parts)


def decode_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, EliasFano]:
    magic, version, width, n, nulls, _, least, low_bits, id_bits, *sizes = _HEAD.unpack_from(payload)
    if magic != b"EFTK" or version != 2:
        raise ValueError("not a segment of a token file")
    at = np.concatenate([[_HEAD.size], _HEAD.size + np.cumsum(sizes)])
    part = lambda i, kind: np.frombuffer(payload, kind, (at[i + 1] - at[i]) // np.dtype(kind).itemsize, at[i])
    bounds, known = (EliasFano(part(i, np.uint8), part(i + 1, np.uint8), part(i + 2, "<u4"), m, bits) for i, m, bits in ((1, n + 1, low_bits), (4, n - nulls, id_bits)))
    return [None] * nulls + [least + known.select(i) for i in range(n - nulls)], part(0, f"<u{width}"), bounds


def _segments(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, shard = ChunkTokenizer.of(tokenizer_path), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        seq = start = waiting = 0

        def segment() -> pa.RecordBatch:
            nonlocal seq, start
            ids, bounds = np.concatenate(held), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            row = [shard, seq, len(doc_ids), len(ids), start, encode_segment(doc_ids, ids, bounds)]
            seq, start = seq + 1, start + len(ids)
            for x in (doc_ids, held, lengths):
                x.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=SEGMENT.names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            ids, at = tokenizer.encode([x or "" for x in batch.column(1).to_pylist()])
            for i, key in enumerate(keys):
                doc_ids.append(key)
                held.append(np.append(ids[at[i] : at[i + 1]], np.int32(end_id)))
                lengths.append(len(held[-1]))
                waiting += lengths[-1]
                if waiting >= SEGMENT_IDS:
                    yield segment()
                    waiting = 0
        if doc_ids:
            yield segment()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> None:
    """Tokenizes every text of docs (doc_id, text) and writes segments in ascending order of doc_id.

    A null text is empty: its document has the end id alone. A null doc_id comes before all others. Rows of equal
    doc_id are kept, in the order of their texts. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = with_columns_of(docs, doc_id=T.LongType(), text=T.StringType())
    (
        rows.repartitionByRange(partitions or shuffle_partitions(spark), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(_segments(tokenizer_path, end_id), SEGMENT)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
            doc_ids, ids, ef = decode_segment(payload.as_py())
            bounds = np.array([ef.select(i) for i in range(ef.n)], np.int64)
            crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.as_py()] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + start.as_py()), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at path.

    One number for each shard goes through the driver; shards are as many as the tasks that wrote them.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    bases = spark.createDataFrame([(s, b) for (s, _), b in zip(totals, before, strict=False)], "shard int, base long")
    docs = segments.select("shard", "start", "payload").mapInArrow(_decoded, f"shard int, {DECODED}")
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes token files to the shared folder and returns what is read back from them."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path)
