"""Kernel machines trained by preconditioned stochastic gradients with projection onto a fixed set of centres.

A machine is sum_i alpha_i k(., z_i) over centres.  A batch's functional
gradient adds temporary centres at the batch's points; a correction along the
top eigenfunctions of a sample, estimated once, lets the step be as large as
the batch allows; every few batches what the temporary centres stand for is
projected back on the centres.

The data stay where they are: a batch is the rows whose hashed id falls in it,
and one job sums what a whole group of batches needs.  Centres and sample are
model-sized and broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.operators.fourier import extended

MatrixKernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product."""
    left, right = np.empty((len(a), a.shape[1] + 2)), np.empty((len(b), b.shape[1] + 2))
    np.multiply(a, -2, out=left[:, :-2])
    left[:, -2], left[:, -1] = np.einsum("ij,ij->i", a, a), 1
    right[:, :-2] = b
    right[:, -2], right[:, -1] = 1, np.einsum("ij,ij->i", b, b)
    d = left @ right.T
    return np.maximum(d, 0, out=d)


@dataclass(frozen=True)
class laplacian:  # noqa: N801  used like a function, but it can be sent to executors
    s: float

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = _squares(a, b)
        np.sqrt(d, out=d)
        d *= -1 / self.s
        return np.exp(d, out=d)


@dataclass(frozen=True)
class gaussian:  # noqa: N801
    s: float

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = _squares(a, b)
        d *= -0.5 / (self.s * self.s)
        return np.exp(d, out=d)


def arrays(df: DataFrame, most: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, x, label) of a bounded set of rows, by id."""
    t = df.select("id", "x", "label").orderBy("id").limit(most + 1).toArrow()
    if t.num_rows > most:
        raise ValueError(f"a model-sized set has {most} rows at most")
    return t["id"].to_numpy(), np.array(t["x"].to_pylist(), float), t["label"].to_numpy()


def one_hot(label: np.ndarray, classes: int) -> np.ndarray:
    return (label[:, None] == np.arange(classes)).astype(float)


@dataclass
class Spectrum:
    """Top eigenpairs of a kernel on a sample: values of K / s descending, one more than vectors, and the largest diagonal."""

    x: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    top: float

    @classmethod
    def of(cls, kernel: MatrixKernel, x: np.ndarray, q: int) -> Spectrum:
        k = kernel(x, x)
        t, v = np.linalg.eigh(k / len(x))
        q = min(q, len(x) - 1)
        return cls(x, v[:, ::-1][:, :q], t[::-1][: q + 1], float(np.diag(k).max()))

    @property
    def critical_batch(self) -> int:
        """The batch size beyond which a larger batch no longer speeds a step up."""
        return max(1, int(self.top / self.values[-1]))

    def rate(self, batch: int, scale: float = 0.5) -> float:
        """The step for a batch."""
        q = self.values[-1]
        return scale * 2 * (batch / self.top if batch < self.critical_batch else 2 * batch / (self.top + (batch - 1) * q)) / batch

    def correction(self, ksg: np.ndarray) -> np.ndarray:
        """Weights on the sample that take back what a gradient does along the top eigenfunctions; ksg = K(sample, batch) g."""
        d = (1 - self.values[-1] / self.values[:-1]) / self.values[:-1] / len(self.x)
        return self.vectors @ (d[:, None] * (self.vectors.T @ ksg))


def choose_rank(values: np.ndarray, most_batch: int, alpha: float = 0.95, least: int = 5) -> int:
    """The largest q whose eigenvalue still allows a batch below most_batch."""
    ok = np.flatnonzero((1 / np.maximum(values, 1e-300)) ** alpha < most_batch)
    return int(max(least, len(ok)))


def memory_batch(features: int, classes: int, centres: int, gigabytes: float) -> int:
    """Rows of a batch whose kernel block against the centres fits the memory, in doubles."""
    return max(1, int((gigabytes * 2**30 / 8 - (features + classes) * centres) / (centres + features + classes)))


@dataclass
class Machine:
    kernel: MatrixKernel
    centres: np.ndarray
    alpha: np.ndarray
    history: list[float] = field(default_factory=list)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x, self.centres) @ self.alpha

    def predict(self, df: DataFrame, block: int = 1024) -> DataFrame:
        """df (id, x, ..) with scores array<double> and predicted int, ties to the smaller class."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        schema = extended(df, scores="array<double>", predicted="int")

        def each(batches):
            model = shared.value
            for b in batches:
                x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, -1)
                s = np.concatenate([model(x[k : k + block]) for k in range(0, len(x), block)]) if len(x) else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(s), pa.list_(pa.float64())), pa.array(s.argmax(1).astype(np.int32))], names=schema.fieldNames())

        return df.mapInArrow(each, schema)


def batch_sums(df: DataFrame, model: Machine, sample: np.ndarray, classes: int, batches: int, epoch: int, only: list[int]) -> dict[int, dict[str, np.ndarray]]:
    """For each wanted batch: n, K(centres, batch) g and K(sample, batch) g, with g the model's error on the batch. One job, summed in tasks."""
    shared = df.sparkSession.sparkContext.broadcast((model, sample))
    rows = df.select("x", "label", F.pmod(F.xxhash64(F.lit(epoch), "id"), F.lit(batches)).cast("int").alias("batch")).where(F.col("batch").isin(only))

    def each(parts):
        model, sample = shared.value
        total: dict[int, list] = {}
        for p in parts:
            if not p.num_rows:
                continue
            x, y, of = np.array(p.column("x").to_pylist(), float), p.column("label").to_numpy(), p.column("batch").to_numpy()
            g = model(x) - one_hot(y, classes)
            kz, ks = model.kernel(model.centres, x), model.kernel(sample, x)
            for b in np.unique(of):
                at = of == b
                new = [np.array([at.sum(), (g[at] ** 2).sum()], float), kz[:, at] @ g[at], ks[:, at] @ g[at]]
                total[int(b)] = [u + v for u, v in zip(total[int(b)], new, strict=True)] if int(b) in total else new
        for b, vs in total.items():
            for name, v in zip(("n", "kz", "ks"), vs, strict=True):
                flat = v.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), b, np.int32)), pa.array([name] * len(flat)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["batch", "name", "k", "v"])

    got = rows.mapInArrow(each, "batch int, name string, k int, v double").groupBy("batch", "name", "k").agg(F.sum("v").alias("v")).toArrow().to_pandas()
    out: dict[int, dict[str, np.ndarray]] = {}
    for (b, name), part in got.groupby(["batch", "name"]):
        v = part.sort_values("k")["v"].to_numpy()
        out.setdefault(int(b), {})[name] = v if name == "n" else v.reshape(-1, classes)
    return out


def project(kzz: np.ndarray, target: np.ndarray, spectrum: Spectrum, ridge: float = 1e-8) -> np.ndarray:
    """Weights on the centres whose function has these values there: up to a few thousand centres by a direct solve."""
    return np.linalg.solve(kzz + ridge * len(kzz) * np.eye(len(kzz)), target)


def train(df: DataFrame, centres: DataFrame, sample: DataFrame, kernel: MatrixKernel, classes: int, rank: int = 20, epochs: int = 1, batches: int = 4, delay: int = 2, scale: float = 0.5) -> Machine:
    """Train on df (id, x, label); centres and sample are model-sized DataFrames of the same columns.

    delay: batches whose gradients are taken against the same model before the
    projection; the step of their mean is that of a single batch.
    """
    _, z, _ = arrays(centres)
    _, s, _ = arrays(sample)
    spectrum = Spectrum.of(kernel, s, rank)
    model = Machine(kernel, z, np.zeros((len(z), classes)))
    kzz, kzs = kernel(z, z), kernel(z, s)
    for epoch in range(epochs):
        for start in range(0, batches, delay):
            only = list(range(start, min(start + delay, batches)))
            sums = batch_sums(df, model, s, classes, batches, epoch, only)
            moved, error, n = np.zeros_like(model.alpha), 0.0, 0.0
            for part in sums.values():
                count, sq = part["n"]
                step = spectrum.rate(int(count), scale)
                # values at the centres of: gradient at the batch, less its part along the top eigenfunctions
                moved -= step * (part["kz"] - kzs @ spectrum.correction(part["ks"])) / max(1, len(sums))
                error, n = error + sq, n + count
            model.history.append(error / max(n, 1.0))
            model.alpha = model.alpha + project(kzz, moved, spectrum)
    return model


def accuracy(scored: DataFrame) -> DataFrame:
    """One row: n, accuracy, loss (mean squared error against one-hot labels) of predict()'s rows."""
    hit = (F.col("predicted") == F.col("label")).cast("double")
    sq = F.aggregate(F.transform("scores", lambda v, k: F.pow(v - (k == F.col("label")).cast("double"), 2)), F.lit(0.0), lambda a, v: a + v)
    return scored.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(sq).alias("loss"))


def random_features(df: DataFrame, dim: int, features: int, s: float, seed: int = 0) -> DataFrame:
    """x mapped to (cos x W, sin x W) / sqrt(features), W normal with deviation 1 / s: features of the Gaussian kernel."""
    w = np.random.default_rng(seed).standard_normal((dim, features)) / s
    shared = df.sparkSession.sparkContext.broadcast(w)
    schema = extended(df, features="array<double>")

    def each(batches):
        for b in batches:
            p = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, -1) @ shared.value if b.num_rows else np.zeros((0, features))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(np.concatenate((np.cos(p), np.sin(p)), 1) / np.sqrt(features)), pa.list_(pa.float64()))], names=schema.fieldNames())

    return df.mapInArrow(each, schema)
