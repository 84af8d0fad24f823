"""Bounded-space online packing of tokenized documents into sequences of a fixed length.

Each partition keeps a fixed number of open windows. An arriving document longer than a window fills whole windows of
its own; its rest goes to the open window with the least room that holds it. When none does and no further window may
be opened, the fullest is topped up with the first of the rest's ids and emitted, and what remains is placed again, so
an emitted sequence has no padding. When a partition ends, its open windows are poured into the fullest of them; one
partly filled window at most is left, and those of many partitions are merged in the same way, in groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.chunk_tokenizer import ChunkTokenizer
from quirelake.llm.common import lean, small_batches, with_columns_of, written

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("open", T.BooleanType()),
    ]
)
#: Windows a partition keeps open.
OPEN_WINDOWS = 64
#: Left-over windows merged by one task.
MERGED_TOGETHER = 256
#: Sequence ids: the partition or merge group above, a running number below; merged ones have this bit.
_RUN_BITS, _MERGED = 32, 1 << 62

Piece = tuple  # (doc_id, start, ids, doc_tokens)


def padded_length(used: int, size: int) -> int:
    """A sequence is padded to the full size, unless its length is a power of two."""
    return used if used & (used - 1) == 0 else size


class OpenWindows:
    """The open windows of one partition. put() returns the windows that it completes."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.windows: dict[int, list[Piece]] = {}
        self.rooms: list[tuple[int, int]] = []  # ascending
        self.opened = 0

    def put(self, piece: Piece) -> list[list[Piece]]:
        doc_id, start, ids, total = piece
        done = []
        while len(ids) >= self.size:
            done.append([(doc_id, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            at = bisect_left(self.rooms, (len(ids), -1))
            if at < len(self.rooms):
                room, key = self.rooms.pop(at)
                part = len(ids)
            elif len(self.windows) < self.most:
                self.opened += 1
                room, key, part = self.size, self.opened, len(ids)
                self.windows[key] = []
            else:
                room, key = self.rooms.pop(0)
                part = room
            self.windows[key].append((doc_id, start, ids[:part], total))
            start, ids = start + part, ids[part:]
            if room == part:
                done.append(self.windows.pop(key))
            else:
                insort(self.rooms, (room - part, key))
        return done

    def close(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Pours the emptiest windows into the fullest: complete ones, and the pieces of one that is not."""
        left = [self.windows[key] for _, key in self.rooms]
        self.windows, self.rooms = {}, []
        return poured([p for window in left for p in window], self.size)


def poured(pieces: list[Piece], size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Fills one window after another, cutting pieces where a window ends."""
    done, window, room = [], [], size
    for doc_id, start, ids, total in pieces:
        while len(ids):
            window.append((doc_id, start, ids[:room], total))
            taken = min(room, len(ids))
            start, ids, room = start + taken, ids[taken:], room - taken
            if not room:
                done.append(window)
                window, room = [], size
    return done, window


def _rows(windows: list[list[Piece]], first_id: int, open_: bool) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in PIECE.names}
    for i, window in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in window:
            for name, x in zip(PIECE.names, (doc_id, start, len(ids), total, first_id + i, offset, np.asarray(ids, "<u4").tobytes(), open_), strict=True):
                out[name].append(x)
            offset += len(ids)
    return out


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_())])


def _packer(tokenizer_path: str, end_id: int, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, windows = ChunkTokenizer.of(tokenizer_path), OpenWindows(size, most)
        next_id = TaskContext.get().partitionId() << _RUN_BITS
        for batch in batches:
            keys = batch.column(0).to_pylist()
            ids, at = tokenizer.encode([x or "" for x in batch.column(1).to_pylist()])
            done = []
            for i, key in enumerate(keys):
                own = np.append(ids[at[i] : at[i + 1]], np.int32(end_id))
                done += windows.put((key, 0, own, len(own)))
            if done:
                yield pa.RecordBatch.from_pydict(_rows(done, next_id, False), _ARROW)
                next_id += len(done)
        done, rest = windows.close()
        if done:
            yield pa.RecordBatch.from_pydict(_rows(done, next_id, False), _ARROW)
        if rest:
            yield pa.RecordBatch.from_pydict(_rows([rest], next_id + len(done), True), _ARROW)

    return run


def _merger(size: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        pieces = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in rows]
        done, rest = poured(pieces, size)
        return pa.Table.from_pydict(_rows(done + [rest] * bool(rest), _MERGED | int(key[0].as_py()) << _RUN_BITS, False), _ARROW)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 2048, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `size` ids.

    Returns a row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian u32).
    A null or empty text is a document of the end id alone; a null doc_id stays null; repeated rows are packed each for
    itself; an empty table has no piece. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = with_columns_of(docs, doc_id=T.LongType(), text=T.StringType())
    # written once: sequences are made in one pass, and the left-over windows are read again
    pieces = written(rows.mapInArrow(lean(_packer(tokenizer_path, end_id, size, open_windows)), PIECE), "packed", ("open",))
    whole = pieces.filter(~F.col("open")).drop("open")
    group = F.floor(F.shiftright("sequence_id", _RUN_BITS) / MERGED_TOGETHER).cast("long")
    merged = pieces.filter("open").withColumn("merge_group", group).groupBy("merge_group").applyInArrow(_merger(size), PIECE)
    return whole.unionByName(merged.drop("open"))

