"""Token operators against the tokenizer libraries and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from support import DATA
from tokenizers import Tokenizer

from penumbra.llm import bpe, packing, queries, token_files, tokens

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = st.lists(st.sampled_from([*"ab é\t\n.'s1 日\x1c\x85😀<|>,\r\u3000\u2003”", "<|endoftext|>", "word", "\n\n"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_pieces_encode_like_whole_texts(texts):
    got = [np.frombuffer(x, np.uint32).tolist() for x in tokens.file_encoder(JSON)(pa.array(texts)).to_pylist()]
    t = Tokenizer.from_file(JSON)
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_merges_like_the_library(ranked):
    coder, pieces = bpe._coder(RANKS, public_tokenizers.PATTERN)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(text):
        ids = pieces(pa.array(["", text, "x"]))
        assert np.frombuffer(ids[1].as_py(), np.uint32).tolist() == ranked.encode_ordinary(text)
        assert coder.decode(ids.slice(1)).to_pylist() == [text.encode(), b"x"]

    check()
    long = "abcab" * 8_000  # one pre-token
    assert np.frombuffer(pieces(pa.array([long]))[0].as_py(), np.uint32).tolist() == ranked.encode_ordinary(long)


def test_remembered_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 4)
    calls = []

    def encode(strings):
        calls.extend(strings)
        return [s.encode() for s in strings]

    e = tokens.PieceEncoder(encode)
    for text in ("a b c", "a d e", "a b f", "a g h", "a " + "x" * 99, "a b c d e f g h i j"):
        assert e(pa.array([text])).to_pylist() == [text.encode()]
    assert calls.count("a") == 1 and " " + "x" * 99 not in [k.decode() for k in e.pieces.to_pylist()]


def test_special_tokens_in_a_text_are_read_as_the_library_does(library):
    texts = ["a<|endoftext|>b", "x <|endoftext|> y", "a\n<|endoftext|>\n\nb", "<|endoftext|>", "word.<|endoftext|>."]
    got = tokens.file_encoder(JSON)(pa.array(texts)).to_pylist()
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def _contract(query, spark, columns):
    rows = queries.QUERIES[query](spark, DATA).select("doc_id", *columns).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    return rows, texts


def test_the_query_of_token_files(spark, library):
    rows, texts = _contract("op3_token_output", spark, ["start", "n_tokens", "ids_crc32"])
    expected, start = [], 0
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows)) == expected


def test_the_query_of_packing_and_its_quality(spark, library):
    rows, texts = _contract("op4_packing", spark, ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    expected, total = [], 0
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        at, piece, size, total = 0, 0, len(ids) % 2048 or 2048, total + len(ids)
        while at < len(ids):
            expected.append((i, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
            at, piece, size = at + size, piece + 1, 2048
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert len(bins) <= -(-total // 2048) * 1.02 + 1


def test_the_query_of_byte_bpe(spark, ranked):
    rows, texts = _contract("op6_byte_bpe", spark, ["n_tokens", "ids_sha256", "decoded_sha256"])
    expected = []
    for i in sorted(texts):
        ids = np.array(ranked.encode_ordinary(texts[i]), "<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()))
    assert sorted(map(tuple, rows)) == expected


def test_a_writer_rolls_its_files(spark, library):
    docs = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    folder, manifest = token_files.write_token_files(docs, JSON, end_id=2, file_bytes=60)
    assert manifest.count() > 8
    got = sorted(token_files.read_token_files(folder, manifest).collect(), key=lambda r: r.doc_id)
    start = 0
    for r in got:
        assert r.start == start and bytes(r.ids) == np.array([*library.encode(f"text number {r.doc_id} " * 50, add_special_tokens=False).ids, 2], "<u4").tobytes()
        start += r.n_tokens


def test_files_round_trip(spark, odd_documents, no_documents, library):
    folder, manifest = token_files.write_token_files(odd_documents, JSON, end_id=2)
    got = token_files.read_token_files(folder, manifest).collect()
    rows = sorted(((r.doc_id, r.text) for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    expected = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    starts = np.cumsum([0, *map(len, expected)])[:-1].tolist()
    assert [r.start for r in got] == starts
    assert [bytes(r.ids) for r in got] == [e.tobytes() for e in expected]
    some = token_files.read_token_files(folder, manifest, wanted=[5, 10]).collect()
    assert sorted(r.doc_id for r in some) == [5, 10]
    folder, manifest = token_files.write_token_files(no_documents, JSON, end_id=2)
    assert token_files.read_token_files(folder, manifest).count() == 0


def test_a_damaged_frame_is_found(tmp_path):
    path = f"{tmp_path}/f.zst"
    with open(path, "wb") as out:
        writer = token_files.FrameWriter(out, 2)
        for i in range(3):
            writer.add(i, np.arange(50, dtype=np.uint32) + i)
        writer.finish()
    data = bytearray(open(path, "rb").read())
    import zstandard

    # Any reader of zstandard sees plain frames and skips the rest.
    assert zstandard.ZstdDecompressor().decompressobj().decompress(bytes(data)) == np.arange(50, dtype="<u2").tobytes()
    reader = token_files.FrameReader(pafs.LocalFileSystem().open_input_file(path))
    assert reader.tokens(2)[0] == 2 and reader.ids == [0, 1, 2]
    table = len(data) - 9 - 36
    data[table + 8] ^= 1  # the first frame's checksum
    open(path, "wb").write(data)
    reader = token_files.FrameReader(pafs.LocalFileSystem().open_input_file(path))
    with pytest.raises(ValueError, match="checksum"):
        reader.tokens(0)
    assert reader.tokens(1)[0] == 1


def test_packing(odd_documents, no_documents, library):
    rows = packing.pack_documents(odd_documents, JSON, end_id=0, window=64, group_pieces=50).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    assert set(docs) == set(texts)
    for i, text in texts.items():
        whole = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        copies = 2 if i == 2 else 1
        parts = sorted(docs[i], key=lambda r: r.piece)
        assert sum(r.length for r in parts) == copies * len(whole) // 4
        if copies == 1:
            assert b"".join(bytes(r.ids) for r in parts) == whole
            assert all(r.length == 64 for r in parts[1:])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(no_documents, JSON).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_two_fit_packs_everything(lengths):
    bins = packing.best_two_fit(lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 40 for b in bins)
    half = sum(n > 20 for n in lengths)
    assert len(bins) <= max(-(-sum(lengths) // 40), half) * 1.5 + 1


def test_best_two_fit_replaces_the_smallest():
    # Greedy fills 6 + 3 and leaves 1; the two pieces 2 + 2 fill the gap of 4 whole.
    assert [sorted(b) for b in packing.best_two_fit([6, 3, 2, 2], 10)][0] == [0, 2, 3]


def test_encode_decode_odd_rows(odd_documents, no_documents):
    coded = bpe.decode_documents(bpe.encode_documents(odd_documents, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    texts = sorted((r.doc_id or 0, (r.text or "").encode()) for r in odd_documents.collect())
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in coded.collect()) == texts
    assert bpe.encode_documents(no_documents, RANKS, public_tokenizers.PATTERN).count() == 0


