"""Tokenizing, token files, packing: against the library itself, and round trips."""

import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirelake.llm import packing, shingles, token_files
from quirelake.llm.chunk_tokenizer import ChunkTokenizer

ODD = [
    "", " ", "\n\n", " a  b ", "a\tb c", "it's o'clock don't", "DON'T It'S", "日本語 テキスト", "é à ñ  x\n y  ", "a  b", " <|endoftext|> x<|startoftext|>", "x" * 300 + " y", "a'sb c's!d", "Ab12 3d", "é x", "İ ß K Σς", "éé,ü! É-x", "a b c",
]


@pytest.fixture(params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def path(request):
    return public_tokenizers.path(request.param)


loaded = functools.cache(Tokenizer.from_file)


def plain(path, text):
    return loaded(path).encode(text, add_special_tokens=False).ids


def test_chunks_give_the_library_s_ids(path):
    ids, at = ChunkTokenizer.of(path).encode(ODD)
    for i, text in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == plain(path, text), text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "a", " b", " ", "\n", "'s", "É", "\u00a0", "1", "x" * 90, "<|"]), max_size=12).map("".join), max_size=6))
def test_markers_get_the_library_s_ids(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        file = public_tokenizers.path(name)
        ids, at = ChunkTokenizer.of(file).encode(texts)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == plain(file, text), text


@pytest.mark.parametrize("slice_", [64, 100])
def test_words_longer_than_a_slice_are_the_same_words_anywhere(monkeypatch, slice_):
    """Separators before, after and at every edge of a slice, single, doubled and mixed: the words' hashes are the same."""
    monkeypatch.setattr(shingles, "SLICE", slice_)
    monkeypatch.setattr(shingles, "_power", None)
    monkeypatch.setattr(shingles, "_inverse", None)
    for n in range(slice_ - 3, slice_ + 4):
        words = ["w" * n, "q", "v" * (2 * n), "short", "w" * n]
        want = [shingles.word_hashes([w.encode()])[0][0] for w in words]
        for gap in (" ", "  ", "\r\n", "\t \x0b" * 30):
            for before in ("", " ", "\n\n", " " * slice_):
                got = shingles.word_hashes([(before + gap.join(words) + before).encode()])[0]
                assert got.tolist() == want, (n, gap, before)
        for lead in range(slice_ + 2):  # the word begins at every place of a slice
            got = shingles.word_hashes([("a " * (lead // 2) + " " * (lead % 2) + words[0] + " q").encode()])[0]
            assert got.tolist()[-2:] == [want[0], want[1]] and len(got) == lead // 2 + 2
    assert shingles.word_hashes([b" " * (3 * slice_)])[0].tolist() == []


def test_long_texts_are_cut_safely(path, monkeypatch):
    monkeypatch.setattr("quirelake.llm.chunk_tokenizer.SLICE", 64)
    t = ChunkTokenizer(path)
    for text in ("ab, cd\nef  gh " * 30, "x" * 500 + " y", " " * 300 + "a"):
        ids, _ = t.encode([text])
        assert ids.tolist() == plain(path, text)


def test_words_of_one_hash_have_their_own_ids(path):
    """Words of a text of two letters and its complement: polynomials of any odd base take the two for one."""
    a = ["a"]
    for _ in range(10):
        a.append("".join({"a": "b", "b": "a"}[c] for c in "".join(a)))
    words = ["".join(a), "".join({"a": "b", "b": "a"}[c] for c in "".join(a))]
    for texts in (words, [words[1]], [f"x {words[0]} {words[1]} y"], [" ".join(words * 3)]):
        ids, at = ChunkTokenizer.of(path).encode(texts)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == plain(path, text)
    first, second = shingles.word_hashes([w.encode() for w in words])
    assert first != second


def test_stored_chunks_of_one_hash_are_told_apart(path):
    t = ChunkTokenizer(path)
    t._inverse = t._inverse * np.uint64(0)  # every chunk has the hash 0
    for texts in (["one two two"], ["two"], ["three"], ["one"]):
        ids, at = t.encode(texts)
        assert ids.tolist() == plain(path, texts[0])


def test_texts_without_blanks_are_not_kept(path):
    rng, t = np.random.default_rng(4), ChunkTokenizer(path)
    for _ in range(4):
        texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 2000))) for _ in range(10)]
        ids, at = t.encode(texts)
        assert ids[at[3] : at[4]].tolist() == plain(path, texts[3])
    assert t._ids.n == 0 and t._bytes.n == 0


def test_all_documents_are_packed(spark):
    """Against plain ids: every piece's ids, crc32 and place; doc_ids that no float holds beside null ones."""
    p = public_tokenizers.path("word_bpe_49k.json")
    big = 2**53 + 1
    texts = {big + i: "some words here " * (i % 7) for i in range(40)}
    docs = spark.createDataFrame([*texts.items(), (None, "no id"), (None, None)], "doc_id long, text string").repartition(4)
    pieces = packing.pack(docs, p, 1, size=32, open_windows=2).collect()
    found = {}
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        if r["doc_id"] is not None:
            found.setdefault(r["doc_id"], {})[r["start"]] = ids
    for doc_id, text in texts.items():
        assert [x for _, ids in sorted(found[doc_id].items()) for x in ids] == plain(p, text) + [1]
    assert sum(r["length"] for r in pieces if r["doc_id"] is None) == len(plain(p, "no id")) + 2


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aBé'!, \n\t9日"), max_size=40))
def test_any_text(text):
    p = public_tokenizers.path("byte_bpe_50k.json")
    ids, _ = ChunkTokenizer.of(p).encode([text])
    assert ids.tolist() == plain(p, text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(steps).astype(np.int64)
    ef = token_files.EliasFano.of(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()


def test_segment_round_trip():
    ids, bounds = np.array([5, 70000, 2, 2], np.int32), np.array([0, 3, 4])
    doc_ids, back, ef = token_files.decode_segment(token_files.encode_segment([None, 9], ids, bounds))
    assert doc_ids == [None, 9] and back.tolist() == ids.tolist() and ef.all().tolist() == [0, 3, 4]


def rows_of(spark):
    rows = [(3, "b a", "x", 1), (None, "null id", "x", 2), (1, None, "x", 3), (2, "", "x", 4), (3, "a b", "x", 5), (3, "a b", "x", 6), (4, "long " * 3000, "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, shard int")


def test_token_files(spark):
    p = public_tokenizers.path("byte_bpe_50k.json")
    got = [tuple(r) for r in token_files.token_file_digest(rows_of(spark).repartition(3), p, 2).orderBy("start").collect()]
    at = 0
    for (doc_id, start, n, crc), (want, text) in zip(got, [(None, "null id"), (1, ""), (2, ""), (3, "a b"), (3, "a b"), (3, "b a"), (4, "long " * 3000)], strict=True):
        ids = plain(p, text) + [2]
        assert (doc_id, start, n, crc) == (want, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert token_files.token_file_digest(rows_of(spark).limit(0), p, 2).count() == 0


def test_open_windows_keep_their_number_and_waste_nothing():
    rng, w, done = np.random.default_rng(1), packing.OpenWindows(100, 4), []
    total = 0
    for i in range(500):
        n = int(rng.integers(1, 260))
        total += n
        done += w.put((i, 0, np.arange(n), n))
        assert len(w.windows) <= 4
    assert all(sum(len(p[2]) for p in x) == 100 for x in done)
    more, rest = w.close()
    assert sum(len(p[2]) for x in [*done, *more, rest] for p in x) == total and sum(len(p[2]) for p in rest) < 100
    assert packing.padded_length(64, 100) == 64 and packing.padded_length(65, 100) == 100


def test_pack(spark):
    p = public_tokenizers.path("word_bpe_49k.json")
    docs = rows_of(spark).repartition(3)
    pieces = packing.pack(docs, p, 1, size=64, open_windows=2).collect()
    used, by_doc = {}, {}
    for r in pieces:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for spans in used.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= 64
    assert sum(sum(n for _, n in s) == 64 for s in used.values()) >= len(used) - 1
    whole = np.frombuffer(b"".join(i for _, i in sorted(by_doc[4, 3001])), "<u4").tolist()
    assert whole == plain(p, "long " * 3000) + [1]
    assert sum(r["length"] for r in pieces) == sum(len(plain(p, r["text"] or "")) + 1 for r in docs.collect())
    assert packing.pack(docs.limit(0), p, 1).count() == 0
