"""Lines as text and arrays: the public polyline encoding, simplification, places along a line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penumbra.functions import geo


def _signed(value: int) -> str:
    """One number of a polyline: zig-zag, five bits a character, low bits first."""
    value = ~(value << 1) if value < 0 else value << 1
    out = []
    while value >= 32:
        out.append(chr((value & 31 | 32) + 63))
        value >>= 5
    return "".join(out) + chr(value + 63)


@F.pandas_udf(T.StringType())  # a type object: none needs a session at import
def encode_polyline(lines: pd.Series) -> pd.Series:
    """Encoded polyline (five decimals) of an array of [lon, lat] pairs; null stays null."""

    def one(points) -> str | None:
        if points is None:
            return None
        p = np.floor(np.array([[y, x] for x, y in points], float).reshape(-1, 2) * 1e5 + 0.5).astype(np.int64)
        return "".join(map(_signed, np.diff(p, axis=0, prepend=np.zeros((1, 2), np.int64)).ravel().tolist()))

    return lines.map(one, na_action=None)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def decode_polyline(texts: pd.Series) -> pd.Series:
    """The [lon, lat] pairs of an encoded polyline; null where it breaks off or holds other characters."""

    def one(text) -> list[list[float]] | None:
        if text is None:
            return None
        numbers, value, shift = [], 0, 0
        for c in text:
            bits = ord(c) - 63
            if not 0 <= bits < 64:
                return None
            value |= (bits & 31) << shift
            shift += 5
            if bits < 32:
                numbers.append(~(value >> 1) if value & 1 else value >> 1)
                value = shift = 0
        if shift or len(numbers) % 2:
            return None
        p = np.cumsum(np.array(numbers, np.int64).reshape(-1, 2), axis=0) / 1e5
        return [[float(x), float(y)] for y, x in p]

    return texts.map(one, na_action=None)


def simplified(lines: Column, metres: float) -> Column:
    """Indexes (from 0) of the points that Douglas-Peucker keeps of an array of [x, y] in metres."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: None if p is None else _kept(np.array([list(q) for q in p], float), metres))

    return run(lines)


def _kept(points: np.ndarray, metres: float) -> list[int]:
    keep, spans = {0, len(points) - 1} if len(points) else set(), [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = float(d @ d)
        t = np.clip(inner @ d / length, 0, 1) if length else np.zeros(len(inner))
        away = np.hypot(*(inner - t[:, None] * d).T)
        far = int(away.argmax())
        if away[far] > metres:
            keep.add(a + 1 + far)
            spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return sorted(keep)


def line_length(points: Column) -> Column:
    """Metres along an array of {lon, lat} structs."""
    after = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), after, lambda p, q: geo.haversine(p["lon"], p["lat"], q["lon"], q["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def crown_ring(x: Column, y: Column, radius: Column) -> Column:
    """A tree crown as an eight-cornered ring of {x, y}."""
    corner = lambda i: F.struct((x + radius * F.cos(i * F.lit(np.pi / 4))).alias("x"), (y + radius * F.sin(i * F.lit(np.pi / 4))).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(7)), corner)


def quantised_height(metres: Column) -> Column:
    """Height in whole 64ths of a metre, halves up."""
    return F.floor(metres * 64 + 0.5).cast("int")


def bilinear(low_left: Column, low_right: Column, high_left: Column, high_right: Column, fx: Column, fy: Column) -> Column:
    """Value between four grid corners at the shares fx and fy; null if a corner is missing."""
    low, high = low_left + (low_right - low_left) * fx, high_left + (high_right - high_left) * fx
    return low + (high - low) * fy
