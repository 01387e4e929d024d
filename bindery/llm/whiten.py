"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

From a start vector v, left vectors u (one entry a row of the table) and right vectors v (one entry a dimension) follow in
turn: u is Xv and v is X'u, each made orthogonal to all before it. In these vectors X is a small bidiagonal matrix, whose
singular value decomposition gives X's components and deviations. Each step is one pass over the table: tasks compute their
rows' part of Xv and add up its products with X and with the earlier left vectors. Left vectors are as long as the table and
are therefore never stored: each is X times a short vector of coefficients, and a row gives its entries of all of them again
whenever they are needed. Nothing but sums of a few vectors' length leaves a task, so lost executors cost a partial pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.integers import Scaled, matrix, scaled, sums

SCALE, ADD, COMPONENTS = 1024, 100_000, 8
#: Singular values below this share of the largest are those of directions in which the table has no extent.
NOTHING = 1e-11
#: A component is settled when its residual is below this share of the largest singular value.
SETTLED = 1e-15
#: Rows that a task multiplies at once.
BLOCK = 8192


@dataclass(frozen=True)
class Whitening:
    """Components (dimension, number) and their eigenvalues, falling; the trace of the covariance; exact sums of entries."""

    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    count: int
    totals: list[int]


def centred(x: np.ndarray, n: int, totals: list[int]) -> np.ndarray:
    """Entries less their means: the whole part of a mean is taken off as an integer, so that nothing is rounded before."""
    whole = np.array([t // n for t in totals], np.int64)
    return (x - whole) - np.array([t % n / n for t in totals])


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for s in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(s, BLOCK)
            yield batch, matrix(batch.column(column), dim)


def _pass(table: Scaled, totals: list[int], work, size: int) -> np.ndarray:
    """The sum over all rows of ``work`` (centred block to an array of ``size``), one array of sums a task."""
    n, dim = table.count, table.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for _, x in _blocks(batches, 0, dim):
            out += work(centred(x, n, totals))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(out)], ["at", "value"])

    return sums(table.rows.select("x").mapInArrow(run, "at int, value double"), size)


def _step(table: Scaled, totals: list[int], known: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Of u = Xw: products with the left vectors of ``known`` coefficients, squared length, and X'u. One pass."""
    k, dim = known.shape[1], table.dim
    both = np.concatenate([known, w[:, None]], axis=1)

    def work(x: np.ndarray) -> np.ndarray:
        left = x @ both
        u = left[:, -1]
        return np.concatenate([left[:, :-1].T @ u, [u @ u], x.T @ u])

    got = _pass(table, totals, work, k + 1 + dim)
    return got[:k], float(got[k]), got[k + 1 :]


def fit(table: Scaled, wanted: int = COMPONENTS) -> Whitening:
    """The leading ``wanted`` components, fewer if the table extends in fewer directions."""
    n, dim = table.count, table.dim
    none = Whitening(np.zeros((dim, 0)), np.zeros(0), 0.0, n, [0] * dim)
    if not n:
        return none
    entries = table.rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    totals = [int(r["s"]) for r in sorted(entries.collect(), key=lambda r: r["at"])]
    total = float(_pass(table, totals, lambda x: np.array([(x**2).sum()]), 1)[0])
    none = Whitening(none.components, none.eigenvalues, total / n, n, totals)
    if not total:
        return none
    rng = np.random.default_rng(dim)
    right, coefficients, images = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    diagonal: list[float] = []
    beside: list[float] = []
    floor = NOTHING * np.sqrt(total)

    def away(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    v, beta = rng.normal(size=dim), 0.0
    v /= np.linalg.norm(v)
    while True:
        # left vector: Xv less what the earlier ones have of it, measured again where much was taken off
        w = v - (coefficients[:, -1] * beta if diagonal and beta else 0.0)
        shares, square, image = _step(table, totals, coefficients, w)
        for _ in range(2):
            w, image = w - coefficients @ shares, image - images @ shares
            left = square - float(shares @ shares)
            if left > 0.5 * square or left <= floor**2:
                break
            shares, square, image = _step(table, totals, coefficients, w)
        alpha = np.sqrt(max(left, 0.0))
        right = np.concatenate([right, v[:, None]], axis=1)
        beside.append(beta)
        if alpha > floor:
            coefficients = np.concatenate([coefficients, w[:, None] / alpha], axis=1)
            images = np.concatenate([images, image[:, None] / alpha], axis=1)
            diagonal.append(float(alpha))
            nxt = away(image / alpha - alpha * v)
            beta = float(np.linalg.norm(nxt))
        else:
            # the table has no extent along v: a left vector of zeros, and a fresh right one
            coefficients, images = (np.concatenate([m, np.zeros((dim, 1))], axis=1) for m in (coefficients, images))
            diagonal.append(0.0)
            beta = 0.0
        k = len(diagonal)
        b = np.diag(diagonal) + np.diag(beside[1:], 1)
        p, s, q = np.linalg.svd(b)
        if k == dim or (beta > floor and k >= wanted and (beta * np.abs(p[-1, :wanted]) <= SETTLED * s[0]).all()):
            break
        if beta <= floor:
            nxt, beta = away(rng.normal(size=dim)), 0.0
        v = nxt / np.linalg.norm(nxt)
        v = away(v)
        v /= np.linalg.norm(v)
    keep = [i for i in range(min(wanted, k)) if s[i] > NOTHING * s[0]]
    found = right @ q.T[:, keep]
    return Whitening(found / np.linalg.norm(found, axis=0), s[keep] ** 2 / n, total / n, n, totals)


def deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int]:
    """Exact sums over dimensions of (n * x - total)**2."""
    most = max(int(np.abs(x).max(initial=0)), 1) * n + max(map(abs, totals))
    if len(totals) * most**2 < 1 << 63:
        return ((x * n - np.array(totals, np.int64)) ** 2).sum(1).tolist()
    return [int(sum(d * d for d in row)) for row in x.astype(object) * n - np.array(totals, object)]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, add: int = ADD, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """Rows (id, whitened array<double>, deviation decimal(38,0)) and the whitening, with one more column: identity_error.

    An entry ``c`` counts as ``floor(scale * c) + add``. Vectors that are null, empty or hold null or non-finite entries have no
    row and no part in the fit; repeated rows count as often as they stand there; null ids are ids like others; other columns
    are ignored. There are as many components as the vectors extend in, at most ``components``: none for one vector or for
    equal ones; an empty table gives no rows. Vectors of different lengths are an error. ``deviation`` is the sum over
    dimensions of (n * x - total)**2; identity_error the largest entry of whitened rows' covariance less the identity.
    """
    table = scaled(vectors, id_col, None, vector_col, scale, add)
    model = fit(table, components)
    n, dim, k, totals = table.count, table.dim, len(model.eigenvalues), model.totals
    onto = model.components / np.sqrt(model.eigenvalues)
    error = 0.0
    if k:
        moments = _pass(table, totals, lambda x: np.append((x @ onto).sum(0), ((x @ onto).T @ (x @ onto)).ravel()), k + k * k) / n
        mean, second = moments[:k], moments[k:].reshape(k, k)
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, 1, dim):
            white = centred(x, n, totals) @ onto
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            spread = pa.array([*map(str, deviations(x, n, totals))]).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(white.ravel())), spread], ["id", "whitened", "deviation"])

    rows = table.rows.select("id", "x").mapInArrow(run, "id long, whitened array<double>, deviation decimal(38,0)")
    return rows.withColumn("identity_error", F.lit(error)), model


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that leaves 64 bits is null here; the operator's own column has it."""
    rows, model = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    one = rows.select("id", "deviation", "identity_error", F.posexplode("whitened").alias("at", "value"))
    return one.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.count).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        F.col("value").alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"),
        "identity_error",
    )
