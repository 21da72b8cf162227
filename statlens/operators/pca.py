"""Standardisation and principal components (M1-M5).

Rows with a missing value in any chosen column are dropped, the columns are
scaled to mean 0 and population std 1 (constant columns to 0).  What is
decomposed is the columns' correlation matrix A, and Spark's part is always the
same product: A Q = Z'(Z Q) / n for a few vectors Q, one scan in which
every task sends one k x r block.

* Up to ``SMALL`` columns Q is the identity, so one scan gives A, and the driver
  decomposes it.
* Beyond, A is never formed: a block Krylov iteration finds the leading
  components from products with a few vectors at a time, each against all
  found before, until the residual of A v - w v is below ``TOLERANCE``.  The driver holds
  at most ``BASIS`` vectors of k numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.functions.columns import as_double, as_list, numeric_columns, q


def standardize(df: DataFrame, columns: Sequence[str] | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """M1: complete rows, each column as (x - mean) / population std."""
    cols = as_list(columns) or numeric_columns(df)
    keep = as_list(keep)
    base = (df.select(*[q(k) for k in keep], *[as_double(c).alias(c) for c in cols])
            .na.drop(how="any", subset=cols))
    stats = base.agg(*[x for i, c in enumerate(cols)
                       for x in (F.avg(q(c)).alias(f"_m{i}"), F.stddev_pop(q(c)).alias(f"_s{i}"))])
    z = [F.coalesce(F.try_divide(q(c) - F.col(f"_m{i}"), F.col(f"_s{i}")),
                    F.when(q(c).isNotNull(), F.lit(0.0))).alias(c) for i, c in enumerate(cols)]
    return base.crossJoin(F.broadcast(stats)).select(*[q(k) for k in keep], *z)


#: Columns up to which the whole matrix is formed; vectors of a Krylov basis; doubles of the rows a task works on at once.
SMALL, BASIS, CELLS = 1000, 160, 1 << 20
#: Size of a residual A v - w v, as a share of the largest eigenvalue; vectors beside the wanted ones; scans at most.
TOLERANCE, SPARE, SCANS = 1e-10, 4, 400


class _Correlations:
    """The correlation matrix of the complete rows of ``df`` as products with a few vectors."""

    def __init__(self, df: DataFrame, cols: list[str], keep: Sequence[str] = ()):
        x = F.col("_x")
        self.rows = (df.select(*[q(c) for c in keep], F.array(*[as_double(c) for c in cols]).alias("_x"))
                     .where(~F.exists(x, lambda v: v.isNull())))
        summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(x))
        got = self.rows.select(summary.alias("s")).select("s.*").first()  # 2 k numbers
        self.n, self.k = got["count"], len(cols)
        if self.n == 0:
            raise ValueError("no row has a value in every column")
        self.mean = got["mean"].toArray()
        deviation = np.sqrt(got["variance"].toArray() * (self.n - 1) / self.n)
        # what rounding leaves of a constant column's deviation counts as none
        self.varies = deviation > 1e-12 * np.abs(self.mean)
        self.scale = np.where(self.varies, 1.0 / np.where(self.varies, deviation, 1.0), 0.0)

    def times(self, vectors: np.ndarray) -> np.ndarray:
        """A Q by one scan; a task sends one block as large as Q."""
        mean, scale, k = self.mean, self.scale, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(vectors.shape)
            for b in batches:
                for z in _standard(b.column(0), mean, scale, k):
                    total += z.T @ (z @ vectors)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["_w"])

        rows = self.rows.select("_x")
        if self.k > 256:  # the block of a task outweighs its rows: no more tasks than can run
            rows = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))
        part = rows.mapInArrow(run, "_w array<double>")
        total = part.agg(Summarizer.sum(array_to_vector(F.col("_w"))).alias("w")).first()["w"]
        return total.toArray().reshape(vectors.shape) / self.n

    def components(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``wanted`` largest eigenvalues and their vectors (columns); the largest loading of each is positive."""
        if self.k <= SMALL:
            a = self.times(np.eye(self.k))
            values, vectors = np.linalg.eigh((a + a.T) / 2)
            values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        else:
            values, vectors = self._leading(wanted)
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
        return np.maximum(values, 0.0), vectors * np.where(signs == 0, 1.0, signs)

    def _leading(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        block = min(self.k, wanted + SPARE)
        basis = np.linalg.qr(np.random.default_rng(0).normal(size=(self.k, block)) * self.varies[:, None])[0]
        image = self.times(basis)
        for _ in range(SCANS):
            small = basis.T @ image
            values, inner = np.linalg.eigh((small + small.T) / 2)
            values, inner = values[::-1], inner[:, ::-1]
            vectors = basis @ inner[:, :block]
            rest = image @ inner[:, :block] - vectors * values[:block]
            off = np.linalg.norm(rest, axis=0)
            if off[:wanted].max() <= TOLERANCE * values[0]:
                break
            if basis.shape[1] + block > max(BASIS, 3 * block):  # go on from the best vectors
                basis, image = basis @ inner[:, :2 * block], image @ inner[:, :2 * block]
            new = rest[:, off > TOLERANCE * values[0] * 1e-2]
            for _ in range(2):
                new = new - basis @ (basis.T @ new)
            new, size = np.linalg.qr(new)
            new = new[:, np.abs(np.diag(size)) > 1e-14 * values[0]]
            if new.shape[1] == 0:
                break
            basis, image = np.hstack([basis, new]), np.hstack([image, self.times(new)])
        return values[:wanted], vectors[:, :wanted]


def _standard(arrays: pa.Array, mean: np.ndarray, scale: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Standardised rows of an array column, about ``CELLS`` numbers at a time."""
    step = max(1, CELLS // k)
    for start in range(0, len(arrays), step):
        part = arrays.slice(start, step)
        yield (part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), k) - mean) * scale


def _all_or(k: int, components: int | None) -> int:
    return min(k, components or (k if k <= SMALL else 5))


def _ratios(a: _Correlations, values: np.ndarray) -> list[float]:
    return [float(v) / max(int(a.varies.sum()), 1) for v in values]  # the trace counts the columns that vary


def pca_variance(df: DataFrame, columns: Sequence[str] | None = None, components: int | None = None) -> DataFrame:
    """M2: explained-variance ratio per component and the running total; of the first ``components``
    (default: all, of more than ``SMALL`` columns 5)."""
    cols = as_list(columns) or numeric_columns(df)
    a = _Correlations(df, cols)
    return _variance_rows(df, _ratios(a, a.components(_all_or(len(cols), components))[0]))


def _variance_rows(df: DataFrame, ratios: list[float]) -> DataFrame:
    cum = np.cumsum(ratios)
    rows = [(i + 1, r, float(cum[i])) for i, r in enumerate(ratios)]
    return df.sparkSession.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative_ratio double")


def pca_loadings(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """M3: loadings of the first k components (long form, rounded to 3)."""
    cols = as_list(columns) or numeric_columns(df)
    _, vectors = _Correlations(df, cols).components(min(k, len(cols)))
    rows = [(c, j + 1, round(float(vectors[i, j]), 3)) for i, c in enumerate(cols) for j in range(vectors.shape[1])]
    return df.sparkSession.createDataFrame(rows, "column_name string, component int, loading double")


def pca_scores(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = (), components: int | None = None) -> DataFrame:
    """M4: each complete row projected on the first ``components`` (default as for :func:`pca_variance`): pc1, pc2, ..."""
    cols = as_list(columns) or numeric_columns(df)
    keep = as_list(keep)
    a = _Correlations(df, cols, keep)
    _, vectors = a.components(_all_or(len(cols), components))
    mean, scale, k, r, names = a.mean, a.scale, a.k, vectors.shape[1], [*keep, *[f"pc{j + 1}" for j in range(vectors.shape[1])]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.vstack([np.empty((0, r)), *[z @ vectors for z in _standard(b.column(b.num_columns - 1), mean, scale, k)]])
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(got[:, j].copy()) for j in range(r)], names)

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in names[len(keep):]])
    return a.rows.mapInArrow(run, schema)


def pca_n95(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.95) -> DataFrame:
    """M5: the fewest components whose cumulative ratio reaches ``share``."""
    cols = as_list(columns) or numeric_columns(df)
    a, wanted = _Correlations(df, cols), _all_or(len(cols), None)
    ratios = _ratios(a, a.components(wanted)[0])
    while sum(ratios) < share - 1e-12 and wanted < len(cols):  # of many columns: twice as many
        wanted = min(len(cols), 2 * wanted)
        ratios = _ratios(a, a.components(wanted)[0])
    v = _variance_rows(df, ratios)
    return v.where(F.col("cumulative_ratio") >= share - 1e-12).agg(F.min("component").alias("n_components"))
