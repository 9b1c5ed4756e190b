"""Signatures of profiles: principal components and types, fitted from aggregates of the table.

Each step of a fit is one aggregation: tasks add up small matrices over their rows, Spark adds up the tasks' matrices, and only the
sums, whose size the vectors' length sets, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class SignatureModel:
    """Mean, components (rows) and how much of the variance each explains, centres in their space, and rows and spread (sum of squared
    distances) of the fit's types."""

    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    centres: np.ndarray
    sizes: np.ndarray
    spread: float

    @property
    def scales(self) -> np.ndarray:
        """Of each component the step of one of 127, so that no vector of values from 0 to 1 can pass the range."""
        up = np.where(self.components > 0, self.components * (1 - self.mean), -self.components * self.mean).sum(1)
        down = np.where(self.components > 0, self.components * self.mean, -self.components * (1 - self.mean)).sum(1)
        return np.maximum(up, down) / 127.0


def stratified(rows: DataFrame, cell: str, per_cell: int, id_col: str, seed: int = 1) -> DataFrame:
    """At most ``per_cell`` rows of every cell, those whose ids hash lowest; a large cell is thinned before it is shuffled."""
    order = Window.partitionBy(cell).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_cell).drop("_n")


def _summed(rows: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``make(matrix of vectors)`` over the batches of all tasks: a few numbers an entry, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            column = batch.column(0)
            if len(column):
                total += make(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))
        i, j = np.divmod(np.arange(total.size), shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros(shape)
    for r in rows.select("_v").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # one row an entry of the matrix
        out[r["i"], r["j"]] = r["v"]
    return out


def fit(rows: DataFrame, vector: str, components: int, types: int, id_col: str, starts: int = 4, rounds: int = 50, seed: int = 7) -> SignatureModel:
    """Fit on all vectors of one length. Null vectors, vectors of another length and those with null or non-finite values take no part.

    Components come from the matrix of second moments, each with its largest entry positive. Types are the centres of Lloyd's steps in
    the components' space, from ``starts`` sets of rows that hash lowest, of which the least spread counts; they are ordered by size,
    then by their first entry. Rows equal in id order make the same model.
    """
    v = F.col(vector).cast("array<double>")
    clean = rows.select(F.col(id_col).alias("_id"), v.alias("_v")).where("_v is not null and size(_v) > 0").where(~F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    first = clean.orderBy("_id").limit(1).collect()
    if not first:
        raise ValueError("no vector to fit on")
    d = len(first[0]["_v"])
    clean = clean.where(F.size("_v") == d)
    moments = _summed(clean, lambda x: np.hstack([np.ones((len(x), 1)), x]).T @ np.hstack([np.ones((len(x), 1)), x]), (d + 1, d + 1))
    n, mean = moments[0, 0], moments[0, 1:] / moments[0, 0]
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values)[:components]
    parts = vectors[:, order].T
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]
    explained = np.maximum(values[order], 0) / max(np.maximum(values, 0).sum(), 1e-300)
    chosen = clean.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(types * starts).collect()  # a fixed number of rows
    seeds = (np.array([r["_v"] for r in chosen]) - mean) @ parts.T
    best: SignatureModel | None = None
    for s in range(starts):
        centres = seeds[s::starts][:types]
        if not len(centres):
            break
        for _ in range(rounds):
            c = centres

            def step(x: np.ndarray, c: np.ndarray = c) -> np.ndarray:
                z = (x - mean) @ parts.T
                gaps = ((z[:, None, :] - c[None]) ** 2).sum(2) if len(z) * c.size < 1 << 22 else np.stack([((z - one) ** 2).sum(1) for one in c], 1)
                near = gaps.argmin(1)
                out = np.zeros((len(c), c.shape[1] + 2))
                np.add.at(out, near, np.hstack([np.ones((len(z), 1)), gaps[np.arange(len(z)), near][:, None], z]))
                return out

            sums = _summed(clean, step, (len(c), c.shape[1] + 2))
            centres = np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1), c)
            if np.abs(centres - c).max() < 1e-9:
                break
        spread = float(sums[:, 1].sum())
        if best is None or spread < best.spread - 1e-12:
            rank = np.lexsort((centres[:, 0], -sums[:, 0]))
            best = SignatureModel(mean, parts, explained, centres[rank], sums[rank, 0].astype(np.int64), spread)
    assert best is not None
    return best
