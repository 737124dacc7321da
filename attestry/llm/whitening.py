"""Whitening of embeddings by TSQR.

Rows are centred with exact sums, every partition reduces its rows to one triangular factor R by QR, the factors are
merged pairwise up a tree (each level a written table of a FAN-th of the rows), and the singular values and right
vectors of the last R are those of the centred rows. No covariance is formed, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import drop, written
from .vectors import finite, matrix

COMPONENTS = 32
#: Rows reduced at a time, besides the factor so far.
CHUNK = 4096
#: Factors that a task merges, and bytes of them at most (two at least).
FAN, FAN_BYTES = 32, 1 << 26
#: Singular values up to this share of the largest are rounding: their directions hold nothing to scale.
ZERO = 1e-13
_LONG = 2**63 - 1

Batches = Iterator[pa.RecordBatch]


def _numerators(x: np.ndarray, n: int, sums: list[int], most: int) -> np.ndarray:
    """n * x - S, exact: int64 where that fits, else Python integers. most: the largest magnitude in the column."""
    if 4 * n * max(most, 1) < _LONG:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _deviations(numerators: np.ndarray) -> pa.Array:
    """Exact sums of squares of each row; null where one doesn't fit a long."""
    most = int(np.abs(numerators).max(initial=0)) if numerators.size else 0
    if most * most * max(1, numerators.shape[1]) <= _LONG:
        return pa.array((numerators * numerators).sum(axis=1).astype(np.int64), pa.int64())
    exact = (numerators.astype(object) ** 2).sum(axis=1)
    return pa.array([int(v) if v <= _LONG else None for v in exact], pa.int64())


def _tree(parts: DataFrame, merge: Callable[[bytes | None, bytes], bytes], size: int) -> bytes:
    """All of `parts` (value: `size` bytes) merged, level by level, each task merging a bounded number of them one by one."""
    fan = max(2, min(FAN, FAN_BYTES // max(1, size)))

    def run(batches: Batches) -> Batches:
        value = None
        for batch in batches:
            for one in batch.column(0):
                value = merge(value, one.as_py())
        if value is not None:
            yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

    level = written(parts, "factors")
    count = level.count()
    while count > 1:
        above = written(level.repartition(-(-count // fan)).mapInArrow(run, "value binary"), "factors")
        drop(level)
        level, before = above, count
        count = level.count()
        assert count < before
    value = level.first()
    drop(level)
    return value["value"] if value else b""


def exact_sums(rows: DataFrame) -> tuple[int, int, list[int], int]:
    """(d, n, sums, most) of the vectors `x` (arrays of longs): the commonest length (of equals the greater), how many have it, their exact sums by dimension and the largest magnitude."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"))
    top = lengths.filter("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return 0, 0, [], 0
    d, n, most = top["d"], top["n"], top["most"]

    def run(batches: Batches) -> Batches:
        total = [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            part = max(1, 2**62 // max(most, 1))  # rows whose sums fit a long
            for lo in range(0, len(x), part):
                total = [a + int(b) for a, b in zip(total, x[lo : lo + part].sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], names=["i", "s"])

    sums = rows.filter(F.size("x") == d).select("x").mapInArrow(K.task(run), "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return d, n, [int(r["s"]) for r in sums], int(most)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each row (vec_id, x: an array of longs) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    All rows are fitted on: n of them with sums S. deviation is the exact sum of (n * x - S)^2 over the dimensions, null
    where that does not fit a long. Components are the unit right singular vectors of the centred rows, from 1 by falling
    eigenvalue e, one sign for all; whitened is (x - S / n) on the component over sqrt(e), explained e over the trace,
    and identity_error, one value, the largest absolute entry of whitened's covariance minus the identity, measured
    over all rows. Components beyond the rank (constant dimensions, repeated rows alone) have no whitened values and no rows.

    A repeated row counts and is returned as often as it stands; a null vec_id is returned as null. Rows whose
    length isn't the commonest (of equals the greater) or whose x is null or holds null (in the query also: a number beyond a long) take no part. An empty table gives an empty one. Other columns are not read.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").filter(F.coalesce(F.forall("x", lambda c: c.isNotNull()), F.lit(False)))
    d, n, sums, most = exact_sums(rows)
    if not n:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == d)

    def factor(batches: Batches) -> Batches:
        r = None
        for batch in batches:
            x = matrix(batch.column(0), d)
            for lo in range(0, len(x), CHUNK):
                centred = (_numerators(x[lo : lo + CHUNK], n, sums, most) / n).astype(np.float64)
                r = np.linalg.qr(centred if r is None else np.vstack([r, centred]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["value"])

    def both(one: bytes | None, two: bytes) -> bytes:
        if one is None:
            return two
        return np.linalg.qr(np.vstack([np.frombuffer(v).reshape(-1, d) for v in (one, two)]), mode="r").tobytes()

    r = np.frombuffer(_tree(rows.select("x").mapInArrow(K.task(factor), "value binary"), both, 8 * d * d)).reshape(-1, d)
    _, s, right = np.linalg.svd(r, full_matrices=False)
    kept = min(components, int((s > ZERO * s[0]).sum()))
    if not kept:
        return spark.createDataFrame([], schema)
    e = s**2 / n
    model = spark.sparkContext.broadcast((right[:kept].T / np.sqrt(e[:kept]), sums))

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled, sums = model.value
        numerators = _numerators(x, n, sums, most)
        return numerators, (numerators / n).astype(np.float64) @ scaled

    def moments(batches: Batches) -> Batches:
        total = np.zeros((kept + 1, kept))
        for batch in batches:
            x = matrix(batch.column(0), d)
            for lo in range(0, len(x), CHUNK):
                _, w = whitened(x[lo : lo + CHUNK])
                total[:kept] += w.T @ w
                total[kept] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["value"])

    def added(one: bytes | None, two: bytes) -> bytes:
        return two if one is None else (np.frombuffer(one) + np.frombuffer(two)).tobytes()

    total = np.frombuffer(_tree(rows.select("x").mapInArrow(K.task(moments), "value binary"), added, 8 * (kept + 1) * kept)).reshape(-1, kept)
    mean = total[kept] / n
    error = float(np.abs(total[:kept] / n - np.outer(mean, mean) - np.eye(kept)).max())
    explained = e[:kept] / e.sum()

    def project(batches: Batches) -> Batches:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                numerators, w = whitened(matrix(part.column(1), d))
                at = pa.array(np.repeat(np.arange(part.num_rows), kept))
                m = part.num_rows * kept
                columns = [part.column(0).take(at), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(m, n)), _deviations(numerators).take(at), pa.array(w.ravel()), pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(m, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(K.task(project), schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All of `embeddings` with whole vectors, components as whole 64ths moved up by a million, on the first 32 components."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = F.transform("embedding", lambda c: F.try_add(F.floor(c.cast("double") * 64), F.lit(1_000_000)))
    return whiten(rows.select("vec_id", F.when(finite(F.col("embedding")), x).alias("x")))
