"""Embedding whitening: MLlib's Gramian of exactly centred rows, a local eigh, and a broadcast projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Integers whose square times a dimension stay exact in 64 bits are worked with as such.
WIDE = 1 << 62


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x) of usable rows: x is floor(scale * entry) as long."""
    v = F.col("embedding").cast("array<double>")
    usable = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _sums(batches):
    """Of a task's vectors, by their size: their number, the sums of each dimension and the greatest
    magnitude. Sums are of the upper and the lower halves of the integers, so that none overflows."""
    held: dict[int, list] = {}
    for batch in batches:
        x = batch.column("x")
        sizes = pc.list_value_length(x).to_numpy()
        for size in np.unique(sizes).tolist():
            m = x.filter(pa.array(sizes == size)).flatten().to_numpy().reshape(-1, size)
            upper, lower = (m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)
            had = held.setdefault(size, [0, [0] * size, 0])
            had[0] += len(m)
            had[1] = [h + (int(u) << 32) + int(w) for h, u, w in zip(had[1], upper, lower, strict=True)]
            had[2] = max(had[2], *(abs(int(v)) for v in (m.min(), m.max())))
    for size, (n, total, most) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (size, n, [str(t) for t in total], str(most))], names=["size", "n", "total", "most"])


class Fit:
    """What whitens vectors of one size: n, the sums S, the components and their eigenvalues."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums = n, sums
        # whether n * x - S, and the sum of its squares, are exact in 64 bits
        reach = n * most + max(abs(s) for s in sums)
        self.plain, self.small = reach < WIDE, len(sums) * reach * reach < WIDE
        self.values = self.vectors = None
        self.trace, self.identity_error = 0.0, 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S of rows of integers, exact: as long, or as Python's integers where those don't do."""
        if self.plain:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def solve(self, covariance: np.ndarray, components: int) -> None:
        """The components of the greatest eigenvalues; the greatest entry of each is positive."""
        values, vectors = np.linalg.eigh(covariance)
        self.trace = float(np.trace(covariance))
        self.values, self.vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components].copy()
        top = np.abs(self.vectors).argmax(axis=0)
        self.vectors *= np.sign(self.vectors[top, np.arange(self.vectors.shape[1])])
        # what is nothing but rounding has no variance to be made one
        self.values[self.values <= len(values) * np.finfo(float).eps * max(self.trace, 0.0)] = 0.0

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """Rows of n * x - S on the components, over the root of the eigenvalues; 0 where there is no variance."""
        root = np.sqrt(self.values)
        on = (centred / self.n).astype(np.float64) @ self.vectors
        return np.divide(on, root, out=np.zeros_like(on), where=root > 0)

    def deviations(self, centred: np.ndarray) -> list[int]:
        if self.small:
            return (centred * centred).sum(axis=1).tolist()
        return [sum(int(c) * int(c) for c in row) for row in centred]


def _matrix(rows: DataFrame, column: str) -> RowMatrix:
    """A RowMatrix of a column of arrays of doubles; the rows stay on the JVM's side."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v"))


def _fit(distinct: DataFrame, size: int, fit: Fit, components: int) -> None:
    own = distinct.filter(F.size("x") == size)
    if fit.plain:
        sums, n = F.lit(np.array(fit.sums, np.int64)), F.lit(fit.n)
        centred = F.zip_with("x", sums, lambda x, s: (x * n - s).cast("double") / n)
    else:
        wide = "decimal(38,0)"
        sums, n = F.array(*[F.lit(str(s)).cast(wide) for s in fit.sums]), F.lit(str(fit.n)).cast("decimal(19,0)")
        centred = F.zip_with("x", sums, lambda x, s: ((x.cast("decimal(19,0)") * n).cast(wide) - s).cast("double") / float(fit.n))
    gramian = _matrix(own.select(centred.alias("y")), "y").computeGramianMatrix().toArray()
    fit.solve(gramian / fit.n, components)

    def sums_of(batches):
        k = len(fit.values)
        total, squares = np.zeros(k), np.zeros((k, k))
        for pdf in batches:
            w = fit.whiten(fit.centred(np.stack(pdf["x"].to_numpy()).astype(np.int64)))
            total, squares = total + w.sum(axis=0), squares + w.T @ w
        yield pd.DataFrame({"at": np.arange(k + k * k), "part": np.concatenate([total, squares.ravel()])})

    k, out = len(fit.values), np.zeros(len(fit.values) * (len(fit.values) + 1))
    for r in own.mapInPandas(sums_of, "at long, part double").groupBy("at").agg(F.sum("part").alias("whole")).collect():
        out[r["at"]] = r["whole"]
    mean, cov = out[:k] / fit.n, out[k:].reshape(k, k) / fit.n
    has = fit.values > 0
    error = np.abs(cov - np.outer(mean, mean) - np.eye(k))[np.ix_(has, has)]
    fit.identity_error = float(error.max()) if error.size else 0.0


def fits(distinct: DataFrame, components: int) -> dict[int, Fit]:
    """The fit of each size of vectors (x) of `distinct`, which is settled and has no vector twice."""
    parts: dict[int, list] = {}
    for r in distinct.mapInArrow(_sums, "size long, n long, total array<string>, most string").toLocalIterator():  # a row a task and size
        had = parts.setdefault(r.size, [0, [0] * r.size, 0])
        had[0], had[1], had[2] = had[0] + r.n, [a + int(b) for a, b in zip(had[1], r.total, strict=True)], max(had[2], int(r.most))
    out = {size: Fit(*had) for size, had in sorted(parts.items())}
    for size, fit in out.items():
        _fit(distinct, size, fit, components)
    return out


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """Whiten vectors (vec_id, embedding) on the `components` directions of the greatest variance.

    Returns vec_id, component (from 1), n, deviation, whitened, explained, identity_error for
    each usable row and component. Each entry becomes x = floor(scale * entry), a long. The
    fit is over the distinct x vectors, n of them with sums S: their covariance V (divisor n)
    is the Gramian of the rows (n * x - S) / n over n; the components are its unit
    eigenvectors, numbered by falling eigenvalue e. deviation is the sum of (n * x - S)^2, a
    decimal(38, 0), exact, null past its range; whitened is x - S / n on the component, over sqrt(e); explained is
    e / trace(V); identity_error is the largest entry of whitened's covariance over the fit
    list less the identity, measured.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out. Vectors
    of different sizes are fitted apart, and those with fewer dimensions than `components` have
    as many components as dimensions. A component without variance (one distinct vector, a
    constant dimension) has whitened 0 and explained 0, and counts for no error. Entries past
    the range of a long are its ends. Repeated rows and a repeated or null vec_id keep their
    rows, a repeated vector counts once in the fit; other columns are ignored; no rows give none.

    What meets on the driver are sums and a Gramian, both of a size's dimensions alone.
    """
    rows = scaled(vectors.select("vec_id", "embedding"), scale)
    distinct = settle(rows.select("x").distinct())
    found = fits(distinct, components)
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches):
        for pdf in batches:
            sizes = pdf["x"].map(len)
            for size, own in pdf.groupby(sizes.to_numpy(), sort=False):
                fit = found[int(size)]
                centred = fit.centred(np.stack(own["x"].to_numpy()).astype(np.int64))
                white, k = fit.whiten(centred), len(fit.values)
                share = fit.values / fit.trace if fit.trace > 0 else np.zeros(k)
                out = [own["vec_id"].repeat(k), np.tile(np.arange(1, k + 1), len(own)), fit.n, np.repeat(np.array([str(d) if d < 10**38 else None for d in fit.deviations(centred)], object), k), white.ravel(), np.tile(share, len(own)), fit.identity_error]
                yield pd.DataFrame(dict(zip(columns, out, strict=True)))

    ids = dict(rows.dtypes)["vec_id"]
    # a deviation travels as text, so that it is exact
    projected = rows.mapInPandas(project, f"vec_id {ids}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return projected.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
