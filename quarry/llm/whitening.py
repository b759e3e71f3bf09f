"""Embedding whitening: leading eigenpairs of the covariance by spectrum slicing.

Spark makes exact integer sums over all vectors; what comes to the driver is one number for each pair
of dimensions. There, the inertia of LDL' factorisations of the shifted covariance counts the
eigenvalues above a shift, and bisection by those counts isolates each leading one. Rayleigh
quotient iteration from inside the isolated interval converges cubically, and two more counts
certify which number in order the eigenvalue has.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
#: Entries whose x is at most this far from zero; larger ones count as not finite.
MOST = 1 << 60
#: Rows that a task multiplies at once.
ROWS = 4096


def integers(column: pa.Array, dim: int | None = None):
    """(places, x) of the lists of each length (of ``dim``, if given): x = floor(1024 c) + 100000 as whole
    numbers. Lists that are null or empty or hold a null, a number that is not finite or one
    whose x no long holds are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]) if dim is None else [dim]:
        at = np.flatnonzero(lengths == n)
        if len(at):
            c = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(SCALE * c)
                good = (np.abs(x) < MOST).all(axis=1)  # false for NaN
            if good.any():
                yield at[good], x[good].astype(np.int64) + SHIFT


def product(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact ``a.T @ b`` of whole numbers of size ``most`` at most, as Python's where no machine type holds it."""
    if most * most * len(a) < 1 << 52:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64)
    if most * most * len(a) < 1 << 62:
        return a.T @ b
    return a.astype(object).T @ b.astype(object)


def _sums(vectors: DataFrame):
    """Rows and exact sums of x by length of vector: {dim: (n, [sum, ...])}, for the length that most
    vectors have; of lengths equally common, the longest."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for _, x in integers(b["embedding"]):
                s = held.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                s[0] += len(x)
                s[1] += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        for dim, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))], ["dim", "i", "n", "s"])

    sums = vectors.select("embedding").mapInArrow(run, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    sums = common.stage_table(sums, "sums")
    most = sums.where("i = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return 0, 0, []
    return most["dim"], most["n"], [int(r["s"]) for r in sums.where(F.col("dim") == most["dim"]).orderBy("i").collect()]  # a row a dimension


def _pair_sums(rows: DataFrame, column: str, read, dim: int) -> dict[tuple[int, int], object]:
    """{(i, j): sum over rows of what ``read`` makes of a batch's ``column``}, i <= j; a task sends one row a pair."""
    i, j = np.triu_indices(dim)

    def run(batches):
        total = None
        for b in batches:
            for p in read(b[column]):
                total = p[i, j] if total is None else total + p[i, j]
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)) if total.dtype == object else pa.array(total)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], ["i", "j", "p"])

    exact = column == "embedding"
    got = rows.select(column).mapInArrow(run, f"i int, j int, p {'decimal(38,0)' if exact else 'double'}").groupBy("i", "j").agg(F.sum("p").alias("p"))
    return {(r["i"], r["j"]): r["p"] for r in got.collect()}  # half of the dimensions squared


def inertia(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are above zero: the positive ones of D in LDL', by
    Bunch and Kaufman's pivots of one or two rows; a factor is not kept."""
    a, above, alpha = a.copy(), 0, (1 + 17**0.5) / 8
    tiny = np.finfo(float).tiny
    while (n := len(a)) > 0:
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if n > 1 else 0
        most = column[r - 1] if n > 1 else 0.0
        two = False
        if max(abs(a[0, 0]), most) > tiny and abs(a[0, 0]) < alpha * most:
            other = np.abs(a[r])
            other[r] = 0
            if abs(a[0, 0]) * other.max() >= alpha * most * most:
                pass
            elif abs(a[r, r]) >= alpha * other.max():
                a[[0, r]] = a[[r, 0]]
                a[:, [0, r]] = a[:, [r, 0]]
            else:
                two = True
                a[[1, r]] = a[[r, 1]]
                a[:, [1, r]] = a[:, [r, 1]]
        if two:  # its block has one eigenvalue of either sign
            above += 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        else:
            pivot = a[0, 0]
            above += pivot > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:] / pivot) if abs(pivot) > tiny else a[1:, 1:]
    return above


def leading(v: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows.

    For each one an interval is bisected by inertia counts until it holds that eigenvalue
    alone or is as narrow as rounding allows; eigenvalues that no shift parts are one
    cluster, whose vectors are any orthonormal basis. Rayleigh quotient iteration starts
    from inverse iteration at the interval's middle and leaves out vectors found before;
    if counts around where it ends deny the number, it starts again from a narrower interval.
    """
    n = len(v)
    k, eye, size = min(k, n), np.eye(n), max(np.abs(v).sum(axis=1).max(), np.finfo(float).tiny)
    fine = 64 * np.finfo(float).eps * size
    counts: dict[float, int] = {size + fine: 0, -size - fine: n}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(v - shift * eye)
        return counts[shift]

    def bisect(low: float, high: float, number: int, width: float) -> tuple[float, float]:
        while high - low > fine and (above(low) != number or above(high) != number - 1 or high - low > width):
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= number else (low, middle)
        return low, high

    def solve(shift: float, y: np.ndarray) -> np.ndarray:
        try:
            z = np.linalg.solve(v - shift * eye, y)
        except np.linalg.LinAlgError:
            z = np.linalg.solve(v - (shift + fine / 64) * eye, y)
        return z if np.isfinite(z).all() else y

    values, found, rng = [], np.zeros((0, n)), np.random.default_rng(seed)
    for number in range(1, k + 1):
        low = max((s for s, c in counts.items() if c >= number), default=-size)
        high = min((s for s, c in counts.items() if c < number), default=size)
        width = np.inf
        while True:
            low, high = bisect(low, high, number, width)
            y = rng.standard_normal(n)
            shift = (low + high) / 2
            for step in range(12):
                y -= found.T @ (found @ y)
                y /= np.linalg.norm(y)
                if step >= 2:  # after two steps of inverse iteration
                    was, shift = shift, y @ v @ y
                    if step > 3 and abs(shift - was) <= fine / 64 or np.linalg.norm(v @ y - shift * y) <= fine / 64:
                        break
                y = solve(shift, y)
            y -= found.T @ (found @ y)
            y /= np.linalg.norm(y)
            value = y @ v @ y
            if above(value - 4 * fine) >= number > above(value + 4 * fine) or high - low <= fine:
                break
            width = (high - low) / 16
        values.append(value)
        found = np.vstack([found, y])
    return np.array(values), found


def certified(v: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of falling eigenvalues, whether counts a little below and above it say that it has its
    number: at least so many eigenvalues lie above the one shift, fewer above the other."""
    fine = 256 * np.finfo(float).eps * max(np.abs(v).sum(axis=1).max(), np.finfo(float).tiny)
    eye = np.eye(len(v))
    return np.array([inertia(v - (e - fine) * eye) >= i and inertia(v - (e + fine) * eye) < i for i, e in enumerate(values, 1)], bool)


@dataclass
class Whitener:
    """What whitens vectors: their length, number and sums, and the leading eigenpairs of the covariance
    of x; ``explained`` are shares of its trace."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    certified: np.ndarray

    @staticmethod
    def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitener:
        """Fit to all vectors (embedding): two passes, one for sums, one for products of what is left after
        a whole number near each mean is taken off, so that both are exact."""
        dim, n, sums = _sums(vectors)
        if not n:
            return Whitener(0, 0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), np.zeros(0, bool))
        centre = [round(Fraction(s, n)) for s in sums]

        def read(column):
            for _, x in integers(column, dim):
                for i in range(0, len(x), ROWS):
                    y = x[i : i + ROWS] - np.array(centre)
                    yield product(y, y, int(np.abs(y).max())).astype(object)

        got = _pair_sums(vectors, "embedding", read, dim)
        off = [s - n * c for s, c in zip(sums, centre, strict=True)]
        v = np.zeros((dim, dim))
        for (i, j), p in got.items():
            v[i, j] = v[j, i] = float(Fraction(int(p) * n - off[i] * off[j], n * n))
        values, basis = leading(v, k)
        trace = np.trace(v)
        return Whitener(dim, n, sums, values, basis, values / trace if trace > 0 else np.full(len(values), np.nan), certified(v, values))

    def live(self) -> np.ndarray:
        """The components along which the vectors vary at all, beyond rounding."""
        return self.values > 1e-12 * max(self.values.max(initial=0.0), np.finfo(float).tiny)

    def apply(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, deviation decimal(38,0), whitened array) of every vector that the fit took; the entry of
        a component along which nothing varies is null."""
        me, live = self, self.live()
        kind = vectors.schema["vec_id"].dataType.simpleString()
        if not self.n:
            return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")

        def run(batches):
            mean = [Fraction(s, me.n) for s in me.sums]
            whole = np.array([round(m) for m in mean])
            rest = np.array([float(m - int(w)) for m, w in zip(mean, whole, strict=True)])
            scaled = np.where(live[:, None], me.vectors / np.sqrt(np.where(live, me.values, 1))[:, None], np.nan)
            for b in batches:
                for at, x in integers(b["embedding"], me.dim):
                    y = x - whole
                    d = [int(s - me.n * int(w)) for s, w in zip(me.sums, whole, strict=True)]  # n x - S = n y - d
                    if (me.n * int(np.abs(y).max()) + max(map(abs, d))) ** 2 * me.dim < 1 << 62:
                        far = ((me.n * y - np.array(d)) ** 2).sum(axis=1)
                    else:
                        far = ((me.n * y.astype(object) - np.array(d, object)) ** 2).sum(axis=1)
                    w = (y - rest) @ scaled.T
                    flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(at)), pa.array([Decimal(int(f)) for f in far], pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

        return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")

    def identity_error(self, vectors: DataFrame) -> float:
        """The largest absolute entry of the covariance of whitened vectors, as measured over all of them,
        minus the identity; over the components that vary. Without any it is 0."""
        live = self.live()
        if not live.any():
            return 0.0
        k = int(live.sum())
        white = self.apply(vectors).select(F.filter("whitened", lambda x: x.isNotNull()).alias("w"))
        mean = white.select(F.posexplode("w").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()  # a row a component
        m = np.zeros(k)
        for r in mean:
            m[r["i"]] = r["m"]

        def read(column):
            w = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - m
            yield w.T @ w

        got = _pair_sums(white, "w", read, k)
        return max(abs(p / self.n - (i == j)) for (i, j), p in got.items())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` that is not null and holds only finite numbers, whitened, one row for
    each of its first 8 components (fewer for shorter vectors).

    Vectors of another length than most have, and empty ones, are dropped as well; ids may be
    null or repeat, each row is one of its own. Along a component that nothing varies in
    ``whitened`` is null; ``explained`` is null where nothing varies at all; ``deviation`` is null where
    no long holds it (``Whitener.apply`` gives it whole, as a decimal). An empty table gives no rows. ``certified`` tells whether inertia counts confirm the component's number.
    """
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fit = Whitener.fit(vectors)
    error = fit.identity_error(vectors)
    arrays = [F.array(*[F.lit(x) for x in a]) for a in ([None if np.isnan(e) else float(e) for e in fit.explained], [bool(c) for c in fit.certified])] if fit.n else [F.array().cast("array<double>"), F.array().cast("array<boolean>")]
    rows = fit.apply(vectors).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    at = lambda a: F.get(a, F.col("i"))
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened", at(arrays[0]).cast("double").alias("explained"), F.lit(float(error)).alias("identity_error"), at(arrays[1]).alias("certified"))
