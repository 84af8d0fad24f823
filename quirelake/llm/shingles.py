"""Word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words of a shingle.
WIDTH = 5
#: Bytes hashed at once; a longer text is hashed in parts, cut between words.
SLICE = 1 << 16
#: Longer words are named by a digest: texts of one letter more or less can be built that a polynomial does not tell apart.
SHORT = 32

_RANDOM = np.random.default_rng(510)
_BYTE = _RANDOM.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[65:91] = _BYTE[97:123]  # A-Z are lowered
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)
_power = _inverse = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if _power is None:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(SLICE + 1, base, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _power, _inverse = made
    return _power, _inverse


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_bytes(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in at most SLICE bytes, and where each begins."""
    power, inverse = _tables()
    word = ~space[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * inverse[starts])
    for i in np.flatnonzero(stops - starts > SHORT):
        hashes[i] = _digest(data[starts[i] : stops[i]].tobytes())
    return hashes, starts


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word.lower(), digest_size=8).digest(), "little")


def word_hashes(texts: list[bytes], space: np.ndarray = _SPACE) -> list[np.ndarray]:
    """The words of each text in order, A-Z lowered; space: bytes between words, [\\x20\\x09-\\x0D] if not given."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) + 1 <= SLICE):
            held += len(texts[upto]) + 1
            upto += 1
        if held > SLICE:
            out.append(_long(texts[at], space))
        else:
            ends = np.cumsum([len(t) + 1 for t in texts[at:upto]])
            hashes, starts = _of_bytes(np.frombuffer(b" ".join(texts[at:upto]) + b" ", np.uint8), space)
            out += np.split(hashes, np.searchsorted(starts, ends[:-1]))
        at = upto
    return out


def _long(text: bytes, space: np.ndarray) -> np.ndarray:
    """A text of more than SLICE bytes; a word of more is hashed by its own polynomial parts."""
    parts, at = [], 0
    while at < len(text):
        if space[text[at]]:  # no part of the word after it
            at += 1
            continue
        cut = min(len(text), at + SLICE - 1)
        while cut < len(text) and cut > at and not space[text[cut]]:
            cut -= 1
        if cut == at:  # no blank in reach: such a word counts by a digest of its bytes
            cut = next((i for i in range(at + SLICE - 1, len(text)) if space[text[i]]), len(text))
            parts.append(np.array([_digest(text[at:cut])], np.uint64))
        else:
            parts.append(_of_bytes(np.frombuffer(text[at:cut], np.uint8), space)[0])
        at = cut
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of WIDTH words; a shorter text is one shingle; no words, none."""
    words = word_hashes([(t or "").encode() for t in texts])
    lengths = np.array([len(w) for w in words])
    out: list[np.ndarray] = []
    at = 0
    while at < len(words):
        # texts side by side: shingles that reach into the next text are left out
        upto, held = at + 1, lengths[at]
        while upto < len(words) and held + lengths[upto] <= SLICE:
            held += lengths[upto]
            upto += 1
        both = np.concatenate(words[at:upto])
        rolled = np.zeros(max(0, len(both) - WIDTH + 1), np.uint64)
        for i in range(WIDTH):
            rolled = rolled * _STEP + both[i : i + len(rolled)]
        rolled = mixed(rolled + np.uint64(WIDTH))
        start = 0
        for w in words[at:upto]:
            if len(w) >= WIDTH:
                found = np.sort(rolled[start : start + len(w) - WIDTH + 1])
                fresh = np.empty(len(found), bool)
                fresh[0] = True
                np.not_equal(found[1:], found[:-1], out=fresh[1:])
                out.append(found[fresh])
            elif len(w):
                one = np.zeros(1, np.uint64)
                for x in w:
                    one = one * _STEP + x
                out.append(mixed(one + np.uint64(len(w))))
            else:
                out.append(np.empty(0, np.uint64))
            start += len(w)
        at = upto
    return out


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    if not len(hashes):
        return 0
    both = np.array([np.bitwise_xor.reduce(mixed(hashes + np.uint64(0x51))), np.sum(mixed(hashes ^ np.uint64(0xA7)), dtype=np.uint64), len(hashes)], np.uint64)
    return int(mixed(both[:1] * np.uint64(3) + mixed(both[1:2] + mixed(both[2:]))).view(np.int64)[0])
