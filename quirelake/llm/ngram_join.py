"""Exact Jaccard self-join of documents on word shingles, as a join in a metric space.

Distance is 1 - Jaccard, a metric on sets; documents link within EPS = 0.2. Distances of texts crowd at 1, where the
triangle inequality separates nothing, so the space is first cut into *regions* by shared rare shingles: the shorter of
two documents that link has one of their common shingles among the first ninth of its set, the longer one among its
first fifth, in every total order. Every shingle of every document is counted, and the order puts rare ones first; it
only decides how large regions get, never the result.

A region that does not fit a task is split by pivots, recursively. Each member is measured against all pivots of its
region; it is at home in the Voronoi cell of the nearest, and by the triangle inequality meets members at home in
another cell only if that one's pivot is within 2 * EPS of its nearest one's distance, so copies go to just these cells.
Cells are regions again, until they fit. A region that no pivots separate (near copies of one text) is cut into blocks by
hash, and each two blocks are a region, but for those whose members the pivots have already linked with each other.

A region that fits is joined by one task. Sketches go first: the numbers of a set's shingles by remainder of their hash.
The L1 distance of two sketches is at most the sets' symmetric difference, which a link bounds by a ninth of the sizes'
sum, so a sketch that is further away rules a link out, exactly. Whoever has a plausible partner goes on with the whole
set; in a region, members are measured against all others until everyone outside the largest linked group has been. What
comes out are the links of spanning forests, whose connected components are the result, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import lean, shuffle_partitions, small_batches, with_columns_of, written
from quirelake.llm.shingles import mixed, set_id, shingle_sets

EPS = 0.2
#: Bits of a shingle's hash by which it is counted; a collision only makes a shingle look less rare.
KEY_BITS = 48
#: Shingles of more documents go last in the order.
COMMON = 2
#: Keys of more documents are rows of their own, so that no task has all of a hot one's; the rest go by part.
HOT = 64
#: Most shingles in the list of common ones (12 bytes each, broadcast): beyond it, only commoner ones are listed.
MOST_COMMON = 1 << 20
#: Shingles that a task holds before it sends their counts, or their keys, on.
HELD_COUNTS, HELD_KEYS = 1 << 20, 1 << 19
#: Names of sets that a task remembers so as not to send copies twice.
SEEN = 1 << 16
#: Documents of a part, about, so that a part's shingles fit a task however many documents there are.
PART_DOCUMENTS = 4096
#: Members of a region that one task joins, and shingles of them.
FIT, FIT_SHINGLES = 2048, 1 << 22
#: Pivots of a region that is split; the share of its members that a cell may have for the split to go on.
PIVOTS, SHRINKS = 16, 0.7
#: Members measured inside the largest linked group before all those outside it.
INNER_TURNS = 6
#: Bits of the filter of rows whose sets are needed: eight for each, this many at most (broadcast; beyond its use all pass).
FILTER_BITS = 1 << 26
#: Edges whose components one task finds (16 bytes each); larger graphs are labelled by joins.
SMALL_GRAPH = 1 << 20


def _batch(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


# counting


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance: the upper ones of small numbers compress to nothing."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplaned(data: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return data.reshape(width, -1).T.copy().view(kind)[:, 0] if len(data) else np.empty(0, kind)


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def _unstepped(data: np.ndarray) -> np.ndarray:
    return np.cumsum(_unplaned(data, "<u8"), dtype=np.uint64)


def _compressed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _decompressed(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending distinct keys, and counts."""
    return _compressed(_steps(keys), _planes(counts.astype("<u4")))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = _decompressed(blob)
    n = len(data) // 12
    return _unstepped(data[: 8 * n]), _unplaned(data[8 * n :], "<u4").astype(np.int64)


def _packed_entries(rows: np.ndarray) -> bytes:
    """Prefix entries, by ascending key."""
    return _compressed(_steps(rows["key"]), rows["fp"].tobytes(), _planes(rows["n"].copy()))


def _unpacked_entries(blob: bytes) -> np.ndarray:
    data = _decompressed(blob)
    n = len(data) // 20
    rows = np.empty(n, _ENTRY)
    rows["key"], rows["fp"], rows["n"] = _unstepped(data[: 8 * n]), data[8 * n : 16 * n].copy().view("<i8"), _unplaned(data[16 * n :], "<i4")
    return rows


def _parted(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Ascending keys by part: parts are ranges of keys, so that a part's are close together."""
    cuts = np.searchsorted(keys, (np.arange(parts + 1) * (2.0**KEY_BITS / parts)).astype(np.uint64))
    cuts[-1] = len(keys)
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), slice(cuts[p], cuts[p + 1])


def _key(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Numbers of hashes by remainder, up to 255; one or two to a cell, the cells a power of two."""
    cells = 1 << max(5, (len(hashes) // 2).bit_length())
    return np.minimum(np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def _classes(parts: int):
    """Of each document its set's name, size and sketch, in parts of their own; of all shingles, numbers by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size = turn = 0

        def counted() -> pa.RecordBatch:
            keys, numbers = np.unique(np.concatenate(held), return_counts=True)
            rows = [(p, _packed(keys[at], numbers[at])) for p, at in _parted(keys, parts)]
            none = pa.nulls(len(rows), pa.int64())
            return _batch(CLASS_NAMES, [none, none, none, pa.array([p for p, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())])

        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            m = len(sets)
            turn += 1
            yield _batch(
                CLASS_NAMES,
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([-(task << 32 | turn)] * m, pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())],
            )
            for s in sets:
                held.append(_key(s))
                size += len(s)
            if size >= HELD_COUNTS:
                yield counted()
                held.clear()
                size = 0
        if size:
            yield counted()

    return run


CLASS_NAMES = ["doc_id", "n", "fp", "part", "blob"]
_CLASS = "doc_id long, n long, fp long, part long, blob binary"
_SHINGLED = "doc_id long, n long, fp long, blob binary, key long, df long"


def _merged(part: tuple, table: pa.Table) -> pa.Table:
    """Documents as they are; of a part's counts the shingles of more than COMMON documents, with their numbers."""
    if part[0].as_py() < 0:
        none = pa.nulls(len(table), pa.int64())
        return pa.table([table["doc_id"], table["n"], table["fp"], table["blob"], none, none], names=["doc_id", "n", "fp", "blob", "key", "df"])
    both = [_unpacked(b.as_py()) for b in table["blob"]]
    keys, which = np.unique(np.concatenate([k for k, _ in both]), return_inverse=True)
    numbers = np.bincount(which, weights=np.concatenate([c for _, c in both])).astype(np.int64)
    keep = numbers > COMMON
    none = pa.nulls(int(keep.sum()), pa.int64())
    return pa.table([none, none, none, pa.nulls(len(none), pa.binary()), pa.array(keys[keep].astype(np.int64)), pa.array(numbers[keep])], names=["doc_id", "n", "fp", "blob", "key", "df"])


def _listed(table: DataFrame) -> Common:
    """The common shingles with their numbers: the commonest powers of two that are MOST_COMMON at most."""
    levels = sorted((r["l"], r["c"]) for r in table.groupBy(F.floor(F.log2("df")).cast("int").alias("l")).agg(F.count("*").alias("c")).collect())
    total, least = 0, 64
    for level, c in reversed(levels):
        if total + c > MOST_COMMON:
            break
        total, least = total + c, level
    rows = table.filter(F.floor(F.log2("df")) >= least).toArrow()
    keys, numbers = rows["key"].to_numpy().astype(np.uint64), rows["df"].to_numpy()
    order = np.argsort(keys, kind="stable")
    return Common(keys[order], np.minimum(numbers[order], 2**31 - 1).astype(np.int32))


# regions


class Common:
    """The listed shingles by their keys; a bit table in front of the search spares it for nearly all others."""

    TABLE_BITS = 25

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        self.keys, self.numbers = keys, numbers
        table = np.zeros(1 << self.TABLE_BITS, bool)
        table[self._place(keys)] = True
        self.table = np.packbits(table, bitorder="little")

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64((1 << self.TABLE_BITS) - 1)).astype(np.int64)

    def numbers_of(self, hashes: np.ndarray) -> np.ndarray:
        """How many documents have each; 0 if it is not listed."""
        out = np.zeros(len(hashes), np.int64)
        keys = _key(hashes)
        place = self._place(keys)
        may = np.flatnonzero(self.table[place >> 3] >> (place & 7).astype(np.uint8) & 1)
        if len(may) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
            out[may] = np.where(self.keys[at] == keys[may], self.numbers[at], 0)
        return out


def prefix(hashes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first fifth of a set and one more in the total order, and their numbers.

    The order: shingles that are not listed (numbers 0), by hash; listed ones, by frequency.
    """
    want = len(hashes) // 5 + 1 if len(hashes) else 0
    listed = numbers > 0
    rare = hashes[~listed][:want]
    rest, more = hashes[listed], numbers[listed]
    order = np.lexsort((rest, more))[: want - len(rare)]
    return np.concatenate([rare, rest[order]]), np.concatenate([np.zeros(len(rare), np.int64), more[order]])


_ENTRY = np.dtype([("key", "<u8"), ("fp", "<i8"), ("n", "<i4")])  # n is negative where the key is none of the first ninth
MEMBER = "space long, fp long, n long, first boolean, hot boolean"


def _keys(parts: int, shared):
    """Prefixes: by part, those that are not hot; the rest in blobs of their own, whose parts are no two the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common, task = shared.value, TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        hot: list[np.ndarray] = []
        size = turn = 0
        seen: set[int] = set()

        def dealt() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            out: list[tuple[int, bytes]] = []
            if held:
                rows = np.concatenate(held)
                rows = rows[np.argsort(rows["key"], kind="stable")]
                out = [(p, _packed_entries(rows[at])) for p, at in _parted(rows["key"], parts)]
            if hot:
                rows = np.concatenate(hot)
                out.append((-1 - (task << 32 | turn), _packed_entries(rows[np.argsort(rows["key"], kind="stable")])))
                turn += 1
            if out:
                yield _batch(["part", "blob"], [pa.array([p for p, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())])

        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist())
            numbers = common.numbers_of(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
            ends = np.cumsum([len(s) for s in sets])
            for s, end in zip(sets, ends, strict=True):
                fp = set_id(s)
                if not len(s) or fp in seen:
                    continue
                if len(seen) < SEEN:  # spares copies only; spaces are sets
                    seen.add(fp)
                keys, many = prefix(s, numbers[end - len(s) : end])
                row = np.empty(len(keys), _ENTRY)
                row["key"], row["fp"], row["n"] = _key(keys), fp, len(s)
                row["n"][len(s) // 9 + 1 :] *= -1
                cut = np.searchsorted(many, HOT, side="right")
                held.append(row[:cut])
                if cut < len(row):
                    hot.append(row[cut:])
                size += len(row)
            if size >= HELD_KEYS:
                yield from dealt()
                held.clear()
                hot.clear()
                size = 0
        yield from dealt()

    return run


def _spaces_of(key: tuple, table: pa.Table) -> pa.Table:
    """A part's spaces of two members and more. Neighbours in size whose sizes alone rule out a link part them."""
    rows = np.concatenate([_unpacked_entries(b.as_py()) for b in table["blob"]])
    if key[0].as_py() < 0:
        return _members(rows["key"].view(np.int64), rows["fp"], np.abs(rows["n"]), rows["n"] > 0, True)
    # shingles of one document are most
    _, which, numbers = np.unique(rows["key"], return_inverse=True, return_counts=True)
    rows = rows[numbers[which] > 1]
    n, first = np.abs(rows["n"]), rows["n"] > 0
    order = np.lexsort((rows["fp"], n, rows["key"]))
    keys, fps, n, first = rows["key"][order], rows["fp"][order], n[order], first[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
    keys, fps, n, first = keys[fresh], fps[fresh], n[fresh], first[fresh]
    if not len(keys):
        return _members(keys.view(np.int64), fps, n, first, False)
    begins = np.ones(len(keys), bool)
    begins[1:] = (keys[1:] != keys[:-1]) | (5 * n[:-1].astype(np.int64) < 4 * n[1:].astype(np.int64))
    # who is in no first ninth needs a smaller one that is before it
    space = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    before = np.cumsum(first) - np.repeat((np.cumsum(first) - first)[starts], np.diff(np.append(starts, len(keys))))
    keep = before > 0
    keys, fps, n, first, space = keys[keep], fps[keep], n[keep], first[keep], space[keep]
    if not len(keys):
        return _members(keys.view(np.int64), fps, n, first, False)
    starts = np.flatnonzero(np.r_[True, space[1:] != space[:-1]])
    sizes = np.diff(np.append(starts, len(keys)))
    # many shingles have the same members: one space is enough, named by them
    m = mixed(fps.view(np.uint64))
    name = mixed(np.add.reduceat(m, starts) + mixed(np.bitwise_xor.reduceat(mixed(m), starts))).view(np.int64)
    name[sizes < 2] = 0
    name = np.repeat(name, sizes)
    order = np.lexsort((~first, fps, name))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (fps[order][1:] != fps[order][:-1])
    keep = order[fresh & (name[order] != 0)]
    return _members(name[keep], fps[keep], n[keep], first[keep], False)


def _members(space: np.ndarray, fp: np.ndarray, n: np.ndarray, first: np.ndarray, hot: bool) -> pa.Table:
    return pa.table({"space": pa.array(space, pa.int64()), "fp": pa.array(fp, pa.int64()), "n": pa.array(n.astype(np.int64)), "first": pa.array(first.astype(bool), pa.bool_()), "hot": pa.array(np.full(len(fp), hot))})


def _spaces(keyed: DataFrame) -> DataFrame:
    """(space, fp, n, first), with one space for all shingles of the same members; first if it is for one of them."""
    raw = written(keyed.groupBy("part").applyInArrow(_spaces_of, MEMBER), "prefixes")
    hot = raw.filter("hot").groupBy("space", "fp", "n").agg(F.max("first").alias("first"))
    hot = written(hot, "hot-spaces")
    named = hot.groupBy("space").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("fp")).alias("a"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("b"), F.min(F.when(F.col("first"), F.col("n"))).alias("least"))
    named = named.filter("c > 1 and least is not null").select("space", F.xxhash64("c", "a", "b").alias("name"), "least")
    # who is in no first ninth needs a smaller one that is
    members = hot.join(named, "space").filter("n >= least").select(F.col("name").alias("space"), "fp", "n", "first")
    both = raw.filter("not hot").drop("hot").unionByName(members)
    return written(both.groupBy("space", "fp", "n").agg(F.max("first").alias("first")), "spaces")


# joining a region


def _folded(sketches: list[np.ndarray], cells: int) -> np.ndarray:
    """Sketches of fewer cells; a capped number stays a lower bound of what it counts, so folding comes before capping."""
    return np.stack([np.minimum(a.reshape(-1, cells).sum(0, dtype=np.int64), 255) for a in sketches]).astype(np.int16)


def plausible(spaces: np.ndarray, n: np.ndarray, first: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """Groups of members that may link, by their sketches, directly or by others: the first of each one's group.

    Rows are by space, then size. Of two members the smaller, or first, must have the space's shingle among its first.
    """
    label = np.arange(len(n))
    if not len(n):
        return label
    cells = np.array([len(s) for s in sketches])
    ends = np.searchsorted(spaces, spaces, side="right")
    # partners of a row: those after it that are no more than 5/4 as large; spaces are numbered, so one search does for all
    lo = np.arange(len(n)) + 1
    bound = int(n.max()) + 1
    hi = np.minimum(ends, np.searchsorted(spaces * bound + n, spaces * bound + np.minimum(5 * n // 4, bound - 1), side="right"))
    number = np.where(first, np.maximum(hi - lo, 0), 0)
    totals = np.concatenate([[0], np.cumsum(number)])
    up = list(range(len(n)))

    def find(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    at = 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(totals, totals[at] + (1 << 16), side="right")) - 1)
        x = np.repeat(np.arange(at, upto), number[at:upto])
        y = np.arange(len(x)) - np.repeat(totals[at:upto] - totals[at], number[at:upto]) + lo[x]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        width = np.minimum(cells[x], cells[y])
        for w in np.unique(width):
            i = np.flatnonzero(width == w)
            own, back = np.unique(np.concatenate([x[i], y[i]]), return_inverse=True)
            table = _folded([sketches[j] for j in own], int(w))
            a, b = back[: len(i)], back[len(i) :]
            step = max(1, (1 << 21) // int(w))
            for s in range(0, len(i), step):
                far = np.abs(table[a[s : s + step]] - table[b[s : s + step]]).sum(1, dtype=np.int64)
                near = i[s : s + step][9 * far <= n[x[i[s : s + step]]] + n[y[i[s : s + step]]]]
                for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                    p, q = find(p), find(q)
                    if p != q:
                        up[max(p, q)] = min(p, q)
        # rows of these spaces may meet again in the next turn
        last = int(ends[upto - 1])
        label[at:last] = [find(v) for v in range(at, last)]
        at = upto
    return np.array([find(v) for v in range(len(n))])


def _plausible(table: pa.Table) -> pa.Table:
    """Members that may link with another, each with one of its group."""
    space, n, fp = (table[c].to_numpy() for c in ("space", "n", "fp"))
    order = np.lexsort((fp, n, space))
    first = table["first"].to_numpy(zero_copy_only=False)[order]
    blobs = table["blob"].take(pa.array(order)).to_pylist()
    label = plausible(np.unique(space[order], return_inverse=True)[1], n[order], first, [np.frombuffer(b, np.uint8) for b in blobs])
    # the least name of a group, so that groups of many spaces meet under one
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, label, fp[order])
    x, y = fp[order], least[label]
    return pa.table({"x": pa.array(x[x != y]), "y": pa.array(y[x != y])})


class _Forest:
    """Union-find over numbered members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, members: np.ndarray) -> None:
        labels = np.unique(self.label[members])
        self.label[np.isin(self.label, labels)] = labels[0]


def forest(sets: list[np.ndarray], home: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the members of a region as all their links do; of two members, one must be at home."""
    m = len(sets)
    lengths = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    linked, found = _Forest(m), []
    done = np.zeros(m, bool)
    mark = np.zeros(int(ids.max()) + 1, np.int64)
    inner = 0
    while True:
        top = np.bincount(linked.label).argmax()
        inside = linked.label == top
        rest = np.flatnonzero(~done & ~inside)
        if not len(rest):
            return found
        own = np.flatnonzero(~done & inside)
        if inner < INNER_TURNS and len(own) and len(rest) > 1:
            x, inner = own[0], inner + 1
        else:
            x = rest[0]
        done[x] = True
        mine = ids[starts[x] : starts[x] + lengths[x]]
        mark[mine] = 1
        common = np.add.reduceat(mark[ids], starts)
        mark[mine] = 0
        link = 100 * common >= 80 * (lengths + lengths[x] - common)
        link &= (linked.label != linked.label[x]) & (home | home[x])
        near = np.flatnonzero(link)
        if len(near):
            # one link to each group is enough
            _, one = np.unique(linked.label[near], return_index=True)
            found += [(int(x), int(y)) for y in near[one]]
            linked.unite(np.append(near[one], x))


def _joined(table: pa.Table) -> pa.Table:
    """Forest links of one part's regions."""
    space, fp = table["space"].to_numpy(), table["fp"].to_numpy()
    home = table["home"].to_numpy(zero_copy_only=False)
    order = np.lexsort((~home, fp, space))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (space[order][1:] != space[order][:-1]) | (fp[order][1:] != fp[order][:-1])
    order = order[fresh]
    cuts = np.flatnonzero(np.r_[True, space[order][1:] != space[order][:-1], True])
    x: list[int] = []
    y: list[int] = []
    column = table["hashes"]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        if len(rows) > 1:
            sets = [np.frombuffer(column[int(r)].as_py(), np.uint64) for r in rows]
            links = forest(sets, home[rows])
            x += [int(fp[rows[i]]) for i, _ in links]
            y += [int(fp[rows[j]]) for _, j in links]
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


EDGE = "x long, y long"


# components


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges that a task has."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        root = v
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[v] != root:
            up[v], v = root, up[v]
        return root

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                up[max(a, b)] = min(a, b)
    vertices = list(up)
    yield _batch(["v", "label"], [pa.array(vertices, pa.int64()), pa.array([find(v) for v in vertices], pa.int64())])


def components(edges: DataFrame) -> DataFrame:
    """(v, label): of each vertex of edges (x, y), the least vertex it is joined to.

    A small graph's by one task; a larger one's by labels that spread along edges and jump to their labels' own.
    """
    edges = written(edges.select("x", "y").filter("x != y").distinct(), "edges")
    if edges.count() <= SMALL_GRAPH:
        return written(edges.coalesce(1).mapInArrow(_united, "v long, label long"), "labels")
    return _spread(edges)


def _spread(edges: DataFrame) -> DataFrame:
    both = written(edges.select("x", "y").union(edges.select("y", "x")).filter("x != y").distinct(), "edges")
    labels = written(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "y"), "y").groupBy(F.col("x").alias("v")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        step = written(spread.join(up, "label", "left").select("v", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        labels = step.select("v", "label")
        if step.filter("label != old").isEmpty():
            return labels


# recursion


def _measured(pivots: pa.Table, members: pa.Table) -> pa.Table:
    """Of each member the distances to its region's pivots, in order of the pivots' names."""
    order = np.argsort(pivots["fp"].to_numpy(), kind="stable")
    names = pivots["fp"].to_numpy()[order]
    sets = [np.frombuffer(pivots["hashes"][int(i)].as_py(), np.uint64) for i in order]
    far: list[list[float]] = []
    linked: list[list[int]] = []
    for blob in members["hashes"]:
        s = np.frombuffer(blob.as_py(), np.uint64)
        common = np.array([len(np.intersect1d(s, p, assume_unique=True)) for p in sets])
        union = np.array([len(s) + len(p) for p in sets]) - common
        far.append((1 - common / union).tolist())
        linked.append(names[100 * common >= 80 * union].tolist())
    columns = [members["space"], members["fp"], members["n"], members["home"], pa.array([names.tolist()] * len(far), pa.list_(pa.int64())), pa.array(far, pa.list_(pa.float64())), pa.array(linked, pa.list_(pa.int64()))]
    return pa.table(columns, names=["space", "fp", "n", "home", "pivots", "far", "linked"])


def _sized(regions: DataFrame) -> DataFrame:
    return regions.groupBy("space").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))


def _pieces(size: Column, shingles: Column) -> Column:
    """How many tasks' worth a region is."""
    return F.greatest(F.ceil(size / F.lit(FIT)), F.ceil(shingles / F.lit(FIT_SHINGLES))).cast("int")


def _fits(size: str, shingles: str) -> Column:
    return _pieces(F.col(size), F.col(shingles)) <= 1


def _links(regions: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    return regions.select("space", "fp", "home").join(sets.select("fp", "hashes"), "fp").groupBy(F.pmod("space", F.lit(parts))).applyInArrow(_joined, EDGE)


def _split(large: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions (space, fp, n, home) that fit a task, from larger ones, and links found on the way."""
    edges: DataFrame | None = None
    fitting: list[DataFrame] = []
    sizes = written(_sized(large), "region-sizes")
    while True:
        rank = F.row_number().over(Window.partitionBy("space").orderBy(F.xxhash64("fp"), "fp"))
        pivots = large.filter("home").withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("space", "fp")
        salts = sizes.select("space", F.explode(F.sequence(F.lit(0), 2 * _pieces(F.col("size"), F.col("shingles")) - 1)).alias("salt"))
        pivots = written(pivots.join(sets.drop("n"), "fp"), "pivots").join(salts, "space").select("space", "salt", "fp", "hashes")
        salted = large.join(sizes, "space").withColumn("salt", F.pmod(F.xxhash64("fp"), 2 * _pieces(F.col("size"), F.col("shingles"))).cast("int"))
        members = salted.join(sets.drop("n"), "fp").select("space", "salt", "fp", "n", "home", "hashes")
        found = pivots.groupBy("space", "salt").cogroup(members.groupBy("space", "salt"))
        found = written(found.applyInArrow(_measured, "space long, fp long, n long, home boolean, pivots array<long>, far array<double>, linked array<long>"), "measured")
        links = found.select(F.col("fp").alias("x"), F.explode("linked").alias("y")).filter("x != y")
        edges = links if edges is None else edges.unionByName(links)
        # the nearest pivot's cell is home; others whose pivots are within 2 * EPS of it get copies
        near = F.array_min("far")
        cell = F.explode(F.arrays_zip(F.col("pivots").alias("p"), F.col("far").alias("d")))
        cells = found.select("space", "fp", "n", "home", near.alias("near"), F.element_at("pivots", F.array_position("far", near).cast("int")).alias("nearest"), cell.alias("c"))
        cells = cells.filter(F.col("c.d") <= F.col("near") + 2 * EPS + 1e-9)
        cells = cells.select(F.xxhash64("space", "c.p").alias("cell"), "space", "fp", "n", (F.col("home") & (F.col("c.p") == F.col("nearest"))).alias("home"))
        # a cell without anyone at home has nothing to find
        count = cells.groupBy("space", "cell").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.max("home").alias("any"))
        count = written(count.filter("any"), "cells")
        stuck = count.join(sizes, "space").filter((F.col("c") > SHRINKS * F.col("size")) & (_pieces(F.col("c"), F.col("s")) > 1)).select("space").distinct()
        stuck = written(stuck, "stuck")
        fitting.append(_blocks(large.join(stuck, "space"), sizes, edges))
        go = cells.join(stuck, "space", "left_anti").join(count.select("cell", "c", "s"), "cell")
        fits = _fits("c", "s")
        fitting.append(written(go.filter(fits).select(F.col("cell").alias("space"), "fp", "n", "home"), "fitting"))
        large = written(go.filter(~fits).select(F.col("cell").alias("space"), "fp", "n", "home"), "regions")
        if large.isEmpty():
            out = fitting[0]
            for more in fitting[1:]:
                out = out.unionByName(more)
            return out, edges
        sizes = written(_sized(large), "region-sizes")


def _blocks(stuck: DataFrame, sizes: DataFrame, edges: DataFrame) -> DataFrame:
    """Regions that no pivots separate, as pairs of blocks of half a task; linked members need not meet again."""
    if stuck.isEmpty():
        return stuck
    labels = components(edges).select(F.col("v").alias("fp"), "label")
    named = written(stuck.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "stuck-members")
    top = named.groupBy("space", "label").agg(F.count("*").alias("c")).groupBy("space").agg(F.max_by("label", F.struct("c", "label")).alias("top"))
    named = named.join(top, "space").withColumn("out", F.col("label") != F.col("top"))
    # blocks of those outside the largest linked group, and of those inside
    counts = named.groupBy("space").agg(F.sum(F.col("out").cast("long")).alias("n_out"), F.count("*").alias("c"), F.sum("n").alias("s")).filter("n_out > 0")
    per = F.greatest(F.lit(2), F.least(F.lit(FIT), (F.col("c") / F.greatest(F.lit(1.0), F.col("s") / F.lit(FIT_SHINGLES))).cast("int"))) / 2
    counts = counts.select("space", F.ceil(F.col("n_out") / per).cast("int").alias("b_out"), F.greatest(F.lit(1), F.ceil((F.col("c") - F.col("n_out")) / per)).cast("int").alias("b_in"))
    dealt = named.join(counts, "space").withColumn("block", F.when(F.col("out"), F.pmod(F.xxhash64("fp"), "b_out")).otherwise(F.col("b_out") + F.pmod(F.xxhash64("fp"), "b_in")).cast("int"))
    # a block outside meets all; one inside meets those outside
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("b_out") + F.col("b_in")).otherwise(F.col("b_out")) - 1))
    paired = dealt.withColumn("other", other)
    name = F.xxhash64("space", F.least("block", "other"), F.greatest("block", "other"))
    return written(paired.select(name.alias("space"), "fp", "n", "home"), "blocks")


# the whole


def _parts(rows: DataFrame) -> int:
    return max(4 * shuffle_partitions(rows.sparkSession), math.ceil(rows.count() / PART_DOCUMENTS))


def _bits(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(0)), doc_id.isNull()), F.lit(n)).cast("int")


def _sets(rows: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, n, hashes) of the wanted (fp): from one row of each, and of others that a filter of doc_ids lets pass."""
    spark = rows.sparkSession
    leads = classes.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    leads = written(leads, "leads")
    n = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (8 * leads.count()).bit_length()))
    bits = np.zeros(n, bool)
    # a bit for each: at most n small numbers come to the driver
    bits[leads.select(_bits(F.col("doc_id"), n).alias("b")).distinct().toArrow()["b"].to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, set()
        for batch in batches:
            at = batch.column(1).to_numpy()
            texts = batch.column(0).filter(pa.array((own[at >> 3] >> (at & 7) & 1).astype(bool))).to_pylist()
            found = {}
            for s in shingle_sets(texts):
                fp = set_id(s)
                if len(s) and fp not in seen:
                    if len(seen) < SEEN:
                        seen.add(fp)
                    found[fp] = s
            if found:
                yield _batch(["fp", "n", "hashes"], [pa.array(found.keys(), pa.int64()), pa.array([len(s) for s in found.values()], pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())])

    made = rows.filter(F.length("text") > 0).select("text", _bits(F.col("doc_id"), n).alias("b")).mapInArrow(lean(run), "fp long, n long, hashes binary")
    return written(made.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, fp) of all rows, and those with words with their component's label."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = with_columns_of(docs, doc_id=T.LongType(), text=T.StringType())
    parts = _parts(rows)
    shingled = rows.select("doc_id", "text").mapInArrow(lean(_classes(parts)), _CLASS)
    shingled = written(shingled.groupBy("part").applyInArrow(_merged, _SHINGLED), "shingled")
    classes = shingled.filter("key is null").select("doc_id", "n", "fp")
    common = spark.sparkContext.broadcast(_listed(shingled.filter("key is not null")))
    keyed = rows.filter(F.length("text") > 0).select("text").mapInArrow(lean(_keys(parts, common)), "part long, blob binary")
    spaces = _spaces(keyed)
    sizes = written(_sized(spaces).filter("size > 1"), "space-sizes")
    small = spaces.join(sizes.filter(_fits("size", "shingles")).select("space"), "space")
    large = spaces.join(sizes.filter(~_fits("size", "shingles")).select("space"), "space").select("space", "fp", "n", F.lit(True).alias("home"))
    large = written(large, "large-spaces")
    sketches = shingled.filter("key is null").join(spaces.select("fp").distinct(), "fp", "left_semi").select("fp", "blob").dropDuplicates(["fp"])
    # members of small spaces that may link, each in one region, however many spaces it is in
    near = components(small.join(sketches, "fp").groupBy(F.pmod("space", F.lit(parts))).applyInArrow(_plausible, EDGE))
    sets = _sets(rows, classes, near.select(F.col("v").alias("fp")).union(large.select("fp")).distinct())
    regions = near.select(F.col("label").alias("space"), F.col("v").alias("fp")).join(sets.select("fp", "n"), "fp").select("space", "fp", "n", F.lit(True).alias("home"))
    sizes = written(_sized(regions), "region-sizes")
    fit = regions.join(sizes.filter(_fits("size", "shingles")).select("space"), "space")
    large = written(large.unionByName(regions.join(sizes.filter(~_fits("size", "shingles")).select("space"), "space")), "large-regions")
    edges = _links(fit, sets, parts)
    if not large.isEmpty():
        fitting, found = _split(large, sets)
        edges = edges.unionByName(found).unionByName(_links(fitting, sets, parts))
    labels = components(edges).select(F.col("v").alias("fp"), "label")
    return classes, classes.filter("n > 0").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def link_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    A null text, an empty one or one of white space alone has no shingles and is linked with nothing: its component is
    its own doc_id. Rows of equal sets are linked, whatever their doc_id; repeated rows are returned as often. A null
    doc_id is no least one: such a row takes the least doc_id of its component, null if all are. An empty table has no
    rows. Other columns are not read. Shingles and sets count by 64-bit hashes.
    """
    classes, named = _labelled(docs)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = classes.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _sets_of_rows(text: int):
    """Adds the name and size of the set of the column numbered text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(text).to_pylist())
            columns = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield _batch([*batch.schema.names, "fp", "n"], [*batch.columns, *columns])

    return run


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: of the least doc_id, nulls last, then of the least hash.

    Rows without words stay all.
    """
    classes, named = _labelled(docs)
    least = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("lead"))
    lead = written(least.select(F.col("lead.doc_id").alias("kept_id"), F.col("lead.fp").alias("kept_fp")), "leads")
    again = written(classes.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("again_id")), "repeated")
    # a doc_id of one row names it; the others' rows are told apart by their sets
    once = lead.select("kept_id").union(classes.filter("n = 0").select("doc_id")).dropna().distinct()
    once = once.join(again, once["kept_id"] == again["again_id"], "left_anti")
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    kept = rows.join(once, doc_id.cast("long") == F.col("kept_id"), "left_semi")
    more = rows.filter(doc_id.isNull()).unionByName(rows.join(again, doc_id.cast("long") == F.col("again_id"), "left_semi"))
    schema = T.StructType([*more.schema.fields, T.StructField("fp", T.LongType()), T.StructField("n", T.LongType())])
    more = more.mapInArrow(_sets_of_rows(docs.columns.index("text")), schema)
    leads = more.filter("n > 0").join(lead, doc_id.cast("long").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")), "left_semi")
    hashed = F.xxhash64(*[F.col(f.name) for f in rows.schema.fields if "map<" not in f.dataType.simpleString()])
    one = leads.groupBy(doc_id.cast("long"), "fp").agg(F.min_by(F.struct(*rows.columns), F.struct(hashed, text)).alias("row")).select("row.*")
    return kept.unionByName(one).unionByName(more.filter("n = 0").select(*rows.columns)).toDF(*docs.columns)
