"""Embedding whitening by a randomised range finder and Rayleigh-Ritz.

Entries become whole steps, floor(steps * c), and each distinct vector counts once in
the fit. A random basis of a few directions more than are wanted is sharpened by
repeated passes: each task multiplies its centred rows with the basis and back, and only
sums of the size of the basis leave it. The covariance within the basis then gives
components and eigenvalues, with the residuals of the pairs. If a residual isn't small
against the gap to the next eigenvalue, the spectrum is too flat for a small basis: the
basis is expanded to the full dimension, where the answer is exact to rounding.

To the driver go d sums, products of d rows and at most d columns, and the bounded table
of vector lengths: ``max_size`` bounds d. The distinct vectors are one shuffle with sums
before it, so copies cost a row a task. Everything else is read from the written fit list.

Results for odd input: vectors that are null, empty or hold null or non-finite entries are
dropped, and so are vectors of another length than most; steps past a long are the largest
long; repeated rows come once each; directions without variance have no component, so equal
vectors alone, or an empty table, give no rows with components; other columns keep their
names in a struct. A deviation past a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.vectors import common_size, matrix, usable
from riskloom.scratch import Scratch

#: Components with less variance than this part of the largest have none.
FLAT = 1e-12
LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors with sums S; unit components (a column each) by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def steps(vector: Column, per: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * per) + F.lit(0))


def _added(fit: DataFrame, made: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all fit rows of what ``made`` gives for a block of them, added in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = made(matrix(batch.column("x"), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch({"at": pa.array(np.arange(total.size, dtype=np.int64)), "v": pa.array(total.ravel())})

    rows = fit.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def _ritz(fit: DataFrame, n: int, mean: np.ndarray, k: int, oversample: int, powers: int, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and components of the covariance, k at most."""
    d = len(mean)

    def times(basis: np.ndarray) -> np.ndarray:
        def made(x: np.ndarray) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ basis)

        return _added(fit, made, d).reshape(basis.shape) / n

    size = min(d, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    while True:
        if size < d:
            for _ in range(powers):
                basis = np.linalg.qr(times(basis))[0]
        else:
            basis = np.eye(d)
        image = times(basis)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        if size == d:
            return values[:k], turn[:, :k]
        found = basis @ turn
        off = np.linalg.norm(image @ turn - found * values, axis=0)[:k]
        apart = np.array([np.min(np.abs(np.delete(values, i) - values[i])) for i in range(min(k, size))])
        if (off <= tolerance * apart).all():
            return values[:k], found[:, :k]
        size = d


def fit_whitening(x: DataFrame, d: int, k: int, scratch: Scratch, oversample: int = 8, powers: int = 3, tolerance: float = 1e-10, seed: int = 12) -> Whitening | None:
    """The fit on the distinct rows of x (array of longs of length d); None if there are none or none differ."""
    fit = scratch.put(x.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    if not sums:
        return None
    n, total = sums[0]["n"], tuple(int(r["s"]) for r in sorted(sums, key=lambda r: r["at"]))
    mean = np.array([s / n for s in total])
    trace = float(_added(fit, lambda x: np.array([((x - mean) ** 2).sum()]), d)[0]) / n
    values, found = _ritz(fit, n, mean, min(k, d), oversample, powers, tolerance, seed)
    kept = values > FLAT * max(values[0], 0) if values[0] > 0 else np.zeros(len(values), bool)
    values, found = values[kept], found[:, kept]
    if not len(values):
        return None
    scaled = found / np.sqrt(values)
    centre = _added(fit, lambda x: ((x - mean) @ scaled).sum(axis=0), d) / n

    def spread(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ scaled - centre
        return z.T @ z

    covariance = _added(fit, spread, d).reshape(len(values), -1) / n
    return Whitening(n, total, found, values, trace, float(np.abs(covariance - np.eye(len(values))).max()))


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums over dimensions of (n x - S)^2."""
    most = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums))
    if most * most * x.shape[1] <= LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v <= LONG else None for v in exact]


def whiten(df: DataFrame, vector: str = "embedding", k: int = 4, per: int = 256, max_size: int = 4096, **how) -> tuple[DataFrame, Whitening | None]:
    """row (the given row), deviation and whitened (an array, an entry a component) of each usable row, and the fit."""
    scratch = Scratch(df.sparkSession, "whitening")
    schema = "deviation long, whitened array<double>"
    d = common_size(df, vector)
    if d is not None and d > max_size:
        raise ValueError(f"vectors of {d} entries, over {max_size}")
    given = df.filter(usable(F.col(vector)) & (F.size(vector) == (d or -1))).select(F.struct("*").alias("row"), steps(F.col(vector), per).alias("x"))
    model = None if d is None else fit_whitening(given.select("x"), d, k, scratch, **how)
    if model is None:
        nothing = F.lit(None)
        return given.select("row", nothing.cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    mean, scaled = model.mean, model.components / np.sqrt(model.eigenvalues)
    n, sums = model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), d, np.int64)
            z = (x - mean) @ scaled
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.record_batch([batch.column("row"), pa.array(_deviations(x, n, sums) if len(x) else [], pa.int64()), values], ["row", "deviation", "whitened"])

    kind = next(f.dataType.simpleString() for f in given.schema.fields if f.name == "row")
    return given.mapInArrow(run, f"row {kind}, {schema}"), model


def whitened_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4) -> DataFrame:
    """A row for each usable row and component."""
    out, model = whiten(df, vector, k)
    rows = out.select(F.col(f"row.{key}").alias(key), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = [float(e / model.trace) for e in model.eigenvalues] if model else [0.0]
    return rows.select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, explained))[F.col("at")].alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
