"""Whole texts to token ids with the tokenizers library, encoding each distinct chunk once per worker.

Both vocabularies split text before their merges, never inside a run of letters and never joining what a blank or a
line feed separates on its left. A text is therefore cut, without changing its ids, before each run of blanks and line
feeds and between a Latin letter and an ASCII mark after it. Chunks repeat; a worker encodes a new one with the
library and keeps its bytes and ids under a 64-bit hash in sorted arrays. Hashes only find chunks: bytes are compared
wherever one is taken for another, so two of one hash get each their own ids. Texts with other white space, in which
such a cut could fall inside a token, go to the library whole. Markers of the vocabulary that stand in a text, such as an
end of text, get their own ids, as the library gives them; it encodes what lies between two of them by itself.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Bytes worked on at once; a longer text is cut at a chunk.
SLICE = 1 << 19
#: Longer chunks are encoded each time, not kept.
LONGEST = 256
#: Chunks kept by a worker; beyond it, the store starts anew (only speed depends on it).
KEPT = 1_500_000

_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[65:91, 97:123]] = True
_MARK = np.zeros(256, bool)
_MARK[np.r_[33:48, 58:65, 91:97, 123:127]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[10, 32]] = True
#: Byte-level vocabularies write a byte that is no printable character as one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = dict(zip(_PRINTED, _PRINTED)) | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Growing:
    """An array that is appended to, in room that doubles."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1 << 10, kind), 0

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(self.n + 2 * len(more), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs that begin at starts."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _differ(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which runs of a differ from those of b of the same lengths, none of them empty."""
    if not len(lengths):
        return np.zeros(0, bool)
    wrong = a[_places(at, lengths)] != b[_places(bt, lengths)]
    return np.logical_or.reduceat(wrong, np.cumsum(lengths) - lengths)


class ChunkTokenizer:
    """encode() gives the ids that Tokenizer.encode(text, add_special_tokens=False) would."""

    _own: dict[str, ChunkTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> ChunkTokenizer:
        """One for each vocabulary file and worker process."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        markers = self.tokenizer.get_added_tokens_decoder()
        if any(m.normalized or m.single_word or m.lstrip or m.rstrip for m in markers.values()):
            raise ValueError("markers that take white space or need a word's bounds are not supported")
        #: The ids of markers that may stand in a text, and an expression for them.
        self.markers = {m.content: i for i, m in markers.items()}
        self._marker = re.compile("(" + "|".join(map(re.escape, sorted(self.markers, key=len, reverse=True))) + ")") if self.markers else None
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        #: True for vocabularies that drop white space and lower the case.
        self.folds = ids(" A") == ids("a")
        self._power, self._inverse = _powers(_BASE, SLICE + 1), _powers(pow(_BASE, -1, 1 << 64), SLICE + 1)
        self._clear()

    def _clear(self) -> None:
        self._hash = np.empty(0, np.uint64)
        self._slot = np.empty(0, np.int64)
        # of each slot, where its ids and bytes begin and how many they are
        self._start, self._count = _Growing(np.int64), _Growing(np.int64)
        self._byte_start, self._length = _Growing(np.int64), _Growing(np.int64)
        self._ids, self._bytes = _Growing(np.int32), _Growing(np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more than texts)."""
        parts: list[np.ndarray] = []
        lengths = np.zeros(len(texts), np.int64)
        pending: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if pending:
                ids, counts = self._pieces([b for _, b in pending])
                parts.append(ids)
                np.add.at(lengths, [i for i, _ in pending], counts)
                pending.clear()
                held = 0

        for i, text in ((i, part) for i, whole in enumerate(texts) for part in (self._marker.split(whole) if self._marker and self._marker.search(whole) else [whole])):
            if text in self.markers or _OTHER_SPACE.search(text):
                flush()
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                parts.append(ids)
                lengths[i] += len(ids)
                continue
            for piece in self._slices(text.encode()):
                if held + len(piece) > SLICE:
                    flush()
                pending.append((i, piece))
                held += len(piece)
        flush()
        return np.concatenate(parts) if parts else np.empty(0, np.int32), np.concatenate([[0], np.cumsum(lengths)])

    def _slices(self, data: bytes):
        """Parts of at most SLICE bytes, cut where a run of blanks begins; a longer run without one stays whole."""
        at = 0
        while len(data) - at > SLICE:
            cut = at + SLICE
            while cut > at and not (data[cut] in b" \n" and data[cut - 1] not in b" \n"):
                cut -= 1
            if cut == at:
                cut = next((m.start() + 1 for m in re.finditer(rb"[^ \n][ \n]", data[at + SLICE - 1 :])), -1)
                cut = len(data) if cut < 0 else at + SLICE - 1 + cut
            yield data[at:cut]
            at = cut
        if at < len(data):
            yield data[at:]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        data = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        if len(data) > SLICE:  # one piece without blanks
            ids = np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, np.int32)
            return ids, np.array([len(ids)])
        raw = np.frombuffer(data, np.uint8)
        if self.folds:
            raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
            data = raw.tobytes()
        space, letter, mark = _SPACE[raw], _LETTER[raw], _MARK[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        begins = np.zeros(len(raw), bool)
        if self.folds:
            begins[1:] = ~space[1:] & space[:-1] | mark[1:] & letter[:-1]
        else:
            begins[1:] = space[1:] & ~space[:-1] | mark[1:] & letter[:-1]
        firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(raw))
        if self.folds:  # blanks at a chunk's end, or the whole of one, have no ids
            trimmed = np.concatenate([[0], np.cumsum(~space)])
            count = trimmed[stops] - trimmed[starts]
            starts = np.where((count > 0) & space[starts], starts + (stops - starts - count), starts)  # only a piece's first can begin with blanks
            stops = np.where(count > 0, starts + count, starts)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self._power[: len(raw)], dtype=np.uint64)])
        hashes = (sums[stops] - sums[starts]) * self._inverse[starts]
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        # every other chunk of a hash must be the first one's bytes
        lengths, lead = stops - starts, first[which]
        again = np.flatnonzero((lead != np.arange(len(lead))) & (lengths > 0))
        if (lengths != lengths[lead]).any() or _differ(raw, starts[again], raw, starts[lead[again]], lengths[again]).any():
            found = [self.tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in pieces]
            return np.array([x for ids in found for x in ids], np.int32), np.array([len(ids) for ids in found])
        begin, count, ids = self._looked_up(distinct, starts[first], lengths[first], raw, data)
        ids = ids[_places(begin[which], count[which])]
        piece = np.searchsorted(ends, starts, side="right") if not self.folds else np.searchsorted(ends, np.flatnonzero(begins), side="right")
        return ids, np.bincount(piece, weights=count[which], minlength=len(pieces)).astype(np.int64)

    def _looked_up(self, distinct: np.ndarray, starts: np.ndarray, lengths: np.ndarray, raw: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each distinct chunk's ids begin, how many, and these ids."""
        if len(self._hash) > KEPT:
            self._clear()
        at = np.searchsorted(self._hash, distinct)
        taken = at < len(self._hash)
        taken[taken] = self._hash[at[taken]] == distinct[taken]
        own = np.flatnonzero(taken)
        slot = self._slot[at[own]]
        alike = self._length.room[slot] == lengths[own]
        check = np.flatnonzero(alike & (lengths[own] > 0))
        alike[check] = ~_differ(raw, starts[own[check]], self._bytes.room, self._byte_start.room[slot[check]], lengths[own[check]])
        own, slot = own[alike], slot[alike]
        known = np.zeros(len(distinct), bool)
        known[own] = True
        new = np.flatnonzero(~known)
        found = self._encoded([data[starts[i] : starts[i] + lengths[i]].decode() for i in new])
        count = np.zeros(len(distinct), np.int64)
        count[own] = self._count.room[slot]
        count[new] = np.fromiter(map(len, found), np.int64, len(found))
        more = np.fromiter((x for ids in found for x in ids), np.int32, int(count[new].sum()))
        begin = np.zeros(len(distinct), np.int64)
        order = np.concatenate([own, new])
        begin[order] = np.cumsum(count[order]) - count[order]
        ids = np.concatenate([self._ids.room[_places(self._start.room[slot], count[own])], more])
        # a long chunk is not kept, nor one whose hash another has
        fresh = np.flatnonzero((lengths[new] <= LONGEST) & ~taken[new])
        keep = new[fresh]
        if len(keep):
            self._start.append(self._ids.n + np.cumsum(count[keep]) - count[keep])
            self._ids.append(more[_places((np.cumsum(count[new]) - count[new])[fresh], count[keep])])
            self._byte_start.append(self._bytes.n + np.cumsum(lengths[keep]) - lengths[keep])
            self._bytes.append(raw[_places(starts[keep], lengths[keep])])
            where = np.searchsorted(self._hash, distinct[keep])
            self._hash = np.insert(self._hash, where, distinct[keep])
            self._slot = np.insert(self._slot, where, self._count.n + np.arange(len(keep)))
            self._count.append(count[keep])
            self._length.append(lengths[keep])
        return begin, count, ids

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        """A run of Latin letters is one word to both vocabularies, so it goes straight to the merges."""
        out: list = [None] * len(chunks)
        rest = []
        model = self.tokenizer.model.tokenize
        for i, chunk in enumerate(chunks):
            if _PLAIN.fullmatch(chunk):
                word = chunk.lower().lstrip(" ") if self.folds else chunk
                out[i] = [t.id for t in model(word.encode().decode("latin-1").translate(_WRITTEN))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out
