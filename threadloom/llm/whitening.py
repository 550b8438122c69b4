"""Whitening of vectors by principal components, with eigenvectors refined in mixed precision.

Sums and products of the vectors' whole numbers are exact, whatever the order of the tasks:
products are taken of small limbs in double precision, where they are exact, and added as
whole numbers. Eigenvectors of the covariance are found in float32 and corrected in extended
precision by the iteration of Ogita and Aishima, which only multiplies matrices; eigenvalues
too close to be told apart are corrected together, by a small problem of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import staged

#: Entries become floor(SCALE * entry) + SHIFT; components that are returned.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bits of a limb, rows multiplied at once: the products of a block stay below 2**53.
LIMB, BLOCK = 20, 4096
#: Whole numbers are kept within this, where doubles are exact; no vector of use is near it.
FAR = 2.0 ** 52
HIGH = np.longdouble
#: Most turns of the refinement; a turn moves a vector by 1 / CAUTION of another at most.
TURNS, CAUTION = 40, 100


def whole_rows(batch: pa.RecordBatch, column: int, width: int):
    """Places of the usable rows, and their entries as whole numbers without the shift.

    Shorter vectors are filled up with zeros.
    """
    lists = batch.column(column)
    valid = np.asarray(lists.is_valid())
    counts = np.zeros(len(lists), np.int64)
    counts[valid] = np.asarray(lists.drop_null().value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    ends = np.cumsum(counts)
    rows = np.flatnonzero(valid & (wrong[ends] == wrong[ends - counts]))
    length = counts[rows]
    out = np.zeros((len(rows), width))
    owner = np.repeat(np.arange(len(rows)), length)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    out[owner, within] = flat[np.repeat(ends[rows] - length, length) + within]
    return rows, np.clip(np.floor(SCALE * out), -FAR, FAR).astype(np.int64)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of whole numbers, as Python numbers."""
    high, low = x >> 26, x & (2 ** 26 - 1)
    return [(a << 26) + b for a, b in zip(high.sum(0).tolist(), low.sum(0).tolist())]


def exact_products(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` of whole numbers, as Python numbers in an array of objects."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    for start in range(0, len(x), BLOCK):
        limbs, rest = [], x[start:start + BLOCK]
        while rest.any():
            # the part that is taken is within half a limb of 0, what is left is a multiple
            part = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
            limbs.append(part.astype(np.float64))
            rest = (rest - part) >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _gathered(vectors: DataFrame, width: int, per_block) -> dict[int, list[int]]:
    """Sums over all vectors of the whole numbers ``per_block`` gives for some of them, as
    rows of equal length by number."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, x = whole_rows(batch, 0, width)
            if len(rows):
                for i, values in per_block(x):
                    values = np.array(values, object)
                    totals[i] = totals[i] + values if i in totals else values
        for i, values in totals.items():
            # a decimal column takes 38 digits; sums travel in two halves of 2**60
            low = [int(v) & (2 ** 60 - 1) for v in values]
            high = [int(v) >> 60 for v in values]
            yield pa.RecordBatch.from_pydict({
                "i": [i] * len(low), "j": list(range(len(low))),
                "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())},
                schema=fields)

    fields = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("low", pa.int64()),
                        ("high", pa.int64())])
    found = (vectors.mapInArrow(partial, "i long, j long, low long, high long")
             .groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
                                      for c in ("low", "high")]).collect())
    out: dict[int, dict[int, int]] = {}
    for r in found:
        out.setdefault(r["i"], {})[r["j"]] = int(r["low"]) + (int(r["high"]) << 60)
    return {i: [row[j] for j in range(len(row))] for i, row in out.items()}


def scatter(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, column sums (without the shift) and n * n times the covariance, exact.

    The products are taken after subtracting a whole number next to the mean.
    """
    def counted(x: np.ndarray):
        yield 0, [len(x), *exact_sums(x)]

    n, *sums = _gathered(vectors, width, counted).get(0, [0] * (width + 1))
    if not n:
        return 0, sums, np.zeros((width, width), object)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def centred(x: np.ndarray):
        products = exact_products(x - centre)
        yield from ((i, row) for i, row in enumerate(products))

    found = _gathered(vectors, width, centred)
    products = np.array([found[i] for i in range(width)], object).reshape(width, width)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], object)
    return n, sums, n * products - np.outer(rest, rest)


# -- eigenvectors --------------------------------------------------------------

def orthonormal(x: np.ndarray, turns: int = 3) -> np.ndarray:
    """Nearly orthonormal columns made orthonormal, by multiplications alone."""
    for _ in range(turns):
        x = x @ (3 * np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    return x


def refined(a: np.ndarray, x: np.ndarray):
    """One turn of Ogita and Aishima: better eigenvectors, their eigenvalues, and the gap
    below which two eigenvalues can't be told apart yet."""
    eye = np.eye(len(a), dtype=x.dtype)
    r, s = eye - x.T @ x, x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    away = s - np.diag(value)
    gap = CAUTION * (np.linalg.norm(away.astype(float))
                     + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    apart = value[None, :] - value[:, None]
    far = np.abs(apart) > gap
    step = np.where(far, (s + value[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ step, value, gap


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix in extended precision.

    The first guess is that of float32. Eigenvalues within the gap of a turn form a cluster;
    the matrix, restricted to the cluster's vectors and without their mean eigenvalue, is
    solved in float32 again, which turns the vectors towards the eigenvectors, and the next
    turns go on from there. Eigenvalues that are equal to the last digit stay a cluster; any
    orthonormal basis of their space is then as good.
    """
    a = np.asarray(a, HIGH)
    scale = np.abs(a).max() if a.size else 0
    if not scale:
        return np.zeros(len(a), HIGH), np.eye(len(a), dtype=HIGH)
    a = a / scale
    x = orthonormal(np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH))
    least = 4 * len(a) * np.finfo(HIGH).eps
    for _ in range(TURNS):
        x, value, gap = refined(a, x)
        order = np.argsort(-value, kind="stable")
        x, value = x[:, order], value[order]
        close = value[:-1] - value[1:] <= gap
        turned = False
        for start, stop in runs(close):
            part = x[:, start:stop]
            mean = value[start:stop].mean()
            inner = part.T @ (a @ part - mean * part)
            inner = (inner + inner.T) / 2
            size = np.abs(inner).max()
            if np.abs(inner - np.diag(np.diag(inner))).max() <= least:
                continue
            turn = np.linalg.eigh((inner / size).astype(np.float32))[1][:, ::-1]
            x[:, start:stop] = part @ orthonormal(turn.astype(HIGH))
            turned = True
        x = orthonormal(x)
        away = x.T @ (a @ x)
        if not turned and np.abs(away - np.diag(np.diag(away))).max() <= least:
            break
    value = np.diag(x.T @ (a @ x))
    order = np.argsort(-value, kind="stable")
    return value[order] * scale, x[:, order]


def runs(close: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of places linked by ``close``, each of two places or more."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], close, [False])).view(np.int8)))
    return [(int(a), int(b) + 1) for a, b in zip(edge[0::2], edge[1::2])]


# -- whitened rows -------------------------------------------------------------

def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> dict:
    """Number, sums, eigenvalues and eigenvectors over all usable vectors.

    What reaches the driver are ``width`` * ``width`` sums, however many vectors there are.
    The sign of a component makes its largest entry positive.
    """
    n, sums, exact = scatter(vectors, width)
    covariance = np.array([[HIGH(_ratio(v, n * n)) for v in row] for row in exact],
                          HIGH).reshape(width, width) if n else np.zeros((width, width), HIGH)
    value, x = eigen(covariance)
    for j in range(width):
        if x[np.abs(x[:, j]).argmax(), j] < 0:
            x[:, j] = -x[:, j]
    trace = covariance.trace() if width else HIGH(0)
    # an eigenvalue this small is rounding: all vectors lie in fewer dimensions
    real = value > (value.max() if width else 0) * width * np.finfo(float).eps
    return {"n": n, "sums": sums, "width": width, "real": real[:components].tolist(),
            "value": value[:components].astype(float), "vector": x[:, :components].astype(float),
            "explained": [float(v / trace) if trace else None for v in value[:components]]}


def _ratio(p: int, q: int) -> HIGH:
    """p / q of whole numbers to the last digit of extended precision."""
    whole, rest = divmod(int(p), int(q))
    return HIGH(str(whole)) + HIGH(str(rest)) / HIGH(str(q))


def projected(vectors: DataFrame, key: str, vector: str, model: dict) -> DataFrame:
    """``key``, ``deviation`` (decimal) and ``w``, all components of a vector in an array."""
    kind = vectors.schema[key].dataType.simpleString()
    n, width, sums = model["n"], model["width"], model["sums"]
    scale = np.array([np.sqrt(v) if r else np.inf for v, r in zip(model["value"], model["real"])])
    turn = model["vector"] / np.where(np.isfinite(scale), scale, 1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, object)
        for batch in batches:
            rows, x = whole_rows(batch, 1, width)
            if not len(rows):
                continue
            # what is left of n * x - sums fits a double's digits after the division
            whole = _scaled(x, n, total)
            w = (whole.astype(np.float64) / n) @ turn
            w[:, ~np.isfinite(scale)] = np.nan
            big = [int(v) for v in _squares(whole)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)),
                pa.array([str(v) for v in big], pa.string()),
                pa.array([[None if np.isnan(v) else v for v in r] for r in w.tolist()],
                         pa.list_(pa.float64()))], ["key", "deviation", "w"])

    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(
        project, f"key {kind}, deviation string, w array<double>")


def _scaled(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total, in machine numbers where they hold it."""
    most = max(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0)))
    if n * most + max((abs(int(t)) for t in total), default=0) < 2 ** 62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def _squares(whole: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exact."""
    most = max(abs(int(v)) for v in (whole.min(initial=0), whole.max(initial=0)))
    if whole.shape[1] * most * most < 2 ** 62:
        return (whole.astype(np.int64) ** 2).sum(1)
    return (whole.astype(object) ** 2).sum(1)


def identity_error(rows: DataFrame, model: dict) -> float | None:
    """Largest absolute entry of the components' covariance minus the identity."""
    real = [i for i, r in enumerate(model["real"]) if r]
    if not model["n"] or not real:
        return None
    w = [F.col("w")[i] for i in real]
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    centred = [c - F.lit(m) for c, m in zip(w, means)]
    pairs = [(i, j) for i in range(len(w)) for j in range(i, len(w))]
    found = rows.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, numbered from 1 by falling eigenvalue.

    ``key``, ``component``, ``n``, ``deviation`` (null beyond a long; ``deviation_exact`` has
    it as a decimal), ``whitened``, ``explained`` and ``identity_error``. Rows whose vector is
    null or holds a null, infinite or NaN entry are left out; all others count and are
    returned, those with a null or repeated key, too. Vectors shorter than the longest are
    filled up with zeros, so one without entries is all zeros. Entries beyond 2**52 count as
    that. A component without variance (fewer vectors than dimensions, equal vectors) has a
    null ``whitened`` and no part in ``identity_error``; ``explained`` is null if nothing
    varies. No usable vector: no rows. Further columns are ignored. The covariance is a
    ``width`` * ``width`` matrix on the driver, ``width`` being the number of dimensions.
    """
    usable = vectors.where(_usable(F.col(vector)))
    width = usable.agg(F.max(F.size(vector))).first()[0] or 0
    model = fit(usable.select(vector), width, components)
    rows = staged(projected(usable, key, vector, model), "whitened")
    error = identity_error(rows, model)
    each = F.posexplode("w")
    explained = F.array(*[F.lit(v).cast("double") for v in model["explained"]])
    exact = F.expr("try_cast(deviation AS decimal(38,0))")
    return rows.select("key", "deviation", each.alias("place", "whitened")).select(
        F.col("key").alias(key), (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model["n"]).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint) AS deviation"), "whitened",
        (explained[F.col("place")] if width else F.lit(None).cast("double")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), exact.alias("deviation_exact"))


def _usable(vector: Column) -> Column:
    """Whether all entries are there and finite."""
    far = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e)
                                         & (F.abs(e) < far))
