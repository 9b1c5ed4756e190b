"""Whole-text encoding with a public tokenizer file, with repeated words encoded once a worker.

The byte-level pattern never lets a match go on from a character that is not white space to a
space or line end, nor from a letter to a mark. Texts may therefore be cut at such places, the pieces
encoded apart and their ids joined; the result equals the encoding of the whole text. Cutting,
finding the distinct pieces and joining ids are array work; only pieces that a worker hasn't met
yet are encoded.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from penumbra.llm.common import utf8

#: Pieces that a worker remembers, and the longest piece remembered, in bytes.
CACHE_PIECES, CACHE_BYTES = 1_000_000, 64

#: One match of the pattern for certain: a word of Latin letters, with its space if it has one.
ONE_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Kinds of bytes: white space, other ASCII, letters, and bytes of longer characters.
_SPACE, _PLAIN, _LETTER, _HIGH = 0, 1, 2, 3
_KIND = np.full(256, _HIGH, np.uint8)
_KIND[:128] = _PLAIN
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = _LETTER
_KIND[[*range(9, 14), *range(28, 33)]] = _SPACE
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?)"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[32, 10]] = True


def _closes_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes at ``at`` end a white-space character of two or three bytes."""
    last, second, first = data[at].astype(np.uint32), data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    three = first.astype(np.uint32) << 16 | second.astype(np.uint32) << 8 | last
    two = three & 0xFFFF
    return (
        np.isin(two, (0xC285, 0xC2A0))
        | np.isin(three, (0xE19A80, 0xE1A08E, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))
        | ((three >= 0xE28080) & (three <= 0xE2808B))
    )


def cut_points(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places, ascending and distinct, at which texts (``bounds`` in their UTF-8 bytes) may be cut."""
    if not len(data):
        return np.unique(bounds)
    kind = _KIND[data]
    mark = np.zeros(len(data), bool)
    breaks = np.flatnonzero(_BREAK[data[1:]]) + 1
    before = kind[breaks - 1]
    safe = (before == _PLAIN) | (before == _LETTER)
    high = np.flatnonzero(before == _HIGH)
    safe[high] = ~_closes_space(data, breaks[high] - 1)
    mark[breaks[safe]] = True
    mark[1:] |= _MARK[data[1:]] & (kind[:-1] == _LETTER)
    # After a line end that stands alone between characters that show.
    lines = np.flatnonzero(data[1:-1] == 10) + 1
    alone = (lines > 0) & mark[lines] & ((kind[lines + 1] == _PLAIN) | (kind[lines + 1] == _LETTER))
    mark[lines[alone] + 1] = True
    mark[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.concatenate([np.flatnonzero(mark), [len(data)]]) if mark[0] else np.concatenate([[0], np.flatnonzero(mark), [len(data)]])


class PieceEncoder:
    """Encodes columns of texts by pieces. ``encode`` gives the ids of each of some strings as bytes,
    as unsigned 32-bit integers of this machine. Pieces met are remembered as Arrow columns, which
    hold them in a tenth of a dictionary's memory; when they are too many, those of the latest
    texts stay."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]]):
        self.encode = encode
        self.pieces, self.ids = pa.array([], pa.binary()), pa.array([], pa.large_binary())

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as binary."""
        data, bounds = utf8(texts)
        cuts = cut_points(data, bounds)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        at = pc.index_in(distinct, self.pieces)
        fresh = pc.filter(distinct, pc.is_null(at))
        if len(fresh):
            made = pa.array(self.encode([p.decode() for p in fresh.to_pylist()]), pa.large_binary(), size=len(fresh))
            ids = pa.concat_arrays([self.ids, made])
            at = np.array(at.fill_null(-1))
            at[at < 0] = np.arange(len(self.ids), len(ids))
            ids_of = ids.take(pa.array(at))
            short = pc.less_equal(pc.binary_length(fresh), CACHE_BYTES)
            if len(ids) <= CACHE_PIECES:
                self.pieces = pa.concat_arrays([self.pieces, pc.filter(fresh, short)])
                self.ids = pa.concat_arrays([self.ids, pc.filter(made, short)])
            else:
                short = pc.less_equal(pc.binary_length(distinct), CACHE_BYTES)
                self.pieces, self.ids = pc.filter(distinct, short), pc.filter(ids_of, short)
        else:
            ids_of = self.ids.take(at)
        out = ids_of.take(coded.indices)
        ends = np.frombuffer(out.buffers()[1], np.int64)[np.searchsorted(cuts, bounds)]
        if ends[-1] >= 1 << 31:
            raise ValueError("ids of one batch of texts exceed 2 GB")
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), out.buffers()[2]])


_encoders: dict[str, PieceEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: bytes that show stand for themselves, the others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def file_encoder(path: str) -> PieceEncoder:
    """The encoder of a byte-level ``tokenizers`` file, one a worker. As the library does by default, a
    special token's own string in a text is that token. A piece that is a single word goes straight to
    the tokenizer's model, all others through its whole course."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenize, letters = tokenizer.model.tokenize, _byte_letters()

        def encode(strings: list[str]) -> Iterable[bytes]:
            words = [ONE_WORD(s) is not None for s in strings]
            others = iter(tokenizer.encode_batch_fast([s for s, w in zip(strings, words, strict=True) if not w], add_special_tokens=False))
            for s, word in zip(strings, words, strict=True):
                if word:
                    yield array("I", [t.id for t in tokenize(s.encode().decode("latin-1").translate(letters))]).tobytes()
                else:
                    yield array("I", next(others).ids).tobytes()

        _encoders[path] = PieceEncoder(encode)
    return _encoders[path]
