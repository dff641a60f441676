"""Regression by distributed sufficient statistics: every step is one aggregation of p + p(p+1)/2 sums, solved with numpy.

Nothing but those sums reaches the driver, so rows, clusters and covariate patterns may be as many as there are.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.functions.stats import two_sided_p
from emberlane.schema import Z_EXACT

MAX_STEPS, TOLERANCE, PLAUSIBLE = 60, 1e-9, 50.0


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(values: Sequence[float | None], p: int) -> np.ndarray:
    m = np.zeros((p, p))
    for (i, j), v in zip(_pairs(p), values, strict=True):
        m[i, j] = m[j, i] = 0.0 if v is None else float(v)
    return m


def _linear(xs: Sequence[Column], beta: np.ndarray) -> Column:
    eta = F.lit(0.0)
    for x, b in zip(xs, beta, strict=True):
        eta = eta + x * F.lit(float(b))
    return eta


def _weight(weight: Column | None) -> Column:
    return (weight if weight is not None else F.lit(1.0)).cast("double")


def sigmoid(eta: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(35.0)), F.lit(-35.0))))


@dataclass
class Fit:
    """Coefficients by name, the inverse information, and covariances by clustering."""

    names: list[str]
    beta: np.ndarray
    bread: np.ndarray
    n: float
    converged: bool
    engine: str = "newton"
    notes: str = ""
    meats: dict[str, np.ndarray] = field(default_factory=dict)
    clusters: dict[str, int] = field(default_factory=dict)

    def covariance(self, by: str | None = None, correct: bool = True) -> np.ndarray:
        """Sandwich for a clustering; the default factor G/(G-1) * (N-1)/(N-K) may be left out."""
        if by is None:
            return self.bread
        g, k = self.clusters[by], len(self.beta)
        factor = g / max(1, g - 1) * (self.n - 1) / max(1, self.n - k) if correct else 1.0
        return factor * self.bread @ self.meats[by] @ self.bread

    def table(self, by: str | None = None, correct: bool = True, scale: float = 1.0) -> list[dict]:
        se = np.sqrt(np.maximum(np.diag(self.covariance(by, correct)), 0))
        rows = []
        for name, b, s in zip(self.names, self.beta, se, strict=True):
            ok = math.isfinite(b) and s > 0
            rows.append({"term": name, "beta": float(b), "se": float(s), "or": math.exp(min(700, b * scale)), "lo": math.exp(min(700, (b - Z_EXACT * s) * scale)), "hi": math.exp(min(700, (b + Z_EXACT * s) * scale)), "p": two_sided_p(b / s) if ok else None})
        return rows


def _newton(stats, p: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool, float]:  # noqa: ANN001
    """Maximise a concave likelihood given (value, gradient, information) at a point; halves steps that make it worse."""
    beta = np.zeros(p) if start is None else start
    value, grad, info = stats(beta)
    for _ in range(MAX_STEPS):
        step = np.linalg.lstsq(info, grad, rcond=None)[0]
        if np.abs(step).max(initial=0) < TOLERANCE:
            return beta, info, True, value
        for _ in range(12):
            new = stats(beta + step)
            if new[0] >= value - 1e-9 * abs(value):
                break
            step = step / 2
        beta, (value, grad, info) = beta + step, new
        if np.abs(beta).max() > 1e3:
            return beta, info, False, value
    return beta, info, False, value


def _inverse(info: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(info) if np.linalg.matrix_rank(info) < len(info) else np.linalg.inv(info)


def logit(df: DataFrame, y: Column, xs: dict[str, Column], clusters: Sequence[str | tuple[str, ...]] = (), weight: Column | None = None, trials: Column | None = None) -> Fit:
    """Logistic regression (no intercept unless given as a column): y is 0/1, or a count of ``trials``."""
    names = list(xs)
    w = _weight(weight)
    n = (trials if trials is not None else F.lit(1.0)).cast("double")
    keys = sorted({c for k in clusters for c in ((k,) if isinstance(k, str) else k)})
    base = df.select(*keys, y.cast("double").alias("_y"), n.alias("_n"), w.alias("_w"), *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(xs.values())])
    base = base.groupBy(*[c for c in base.columns if c not in ("_y", "_n", "_w")]).agg(F.sum(F.col("_y") * F.col("_w")).alias("_k"), F.sum(F.col("_n") * F.col("_w")).alias("_t")).persist()
    cols = [F.col(f"_x{i}") for i in range(len(names))]

    def stats(beta: np.ndarray):  # noqa: ANN202
        eta = _linear(cols, beta)
        mu = sigmoid(eta)
        soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        v = F.col("_t") * mu * (1 - mu)
        row = base.agg(F.sum(F.col("_k") * eta - F.col("_t") * soft), *[F.sum((F.col("_k") - F.col("_t") * mu) * x) for x in cols], *[F.sum(v * cols[i] * cols[j]) for i, j in _pairs(len(cols))]).first()
        p = len(cols)
        return float(row[0] or 0), np.array([float(v or 0) for v in row[1 : p + 1]]), _square(row[p + 1 :], p)

    try:
        beta, info, ok, _ = _newton(stats, len(names))
        total = float(base.agg(F.sum("_t")).first()[0] or 0)
        fit = Fit(names, beta, _inverse(info), total, ok, notes="" if ok else "Newton steps did not settle")
        mu = sigmoid(_linear(cols, beta))
        scores = [((F.col("_k") - F.col("_t") * mu) * x).alias(f"s{i}") for i, x in enumerate(cols)]
        for by in clusters:
            key = (by,) if isinstance(by, str) else by
            sums = base.select(*key, *scores).groupBy(*key).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(names))])
            row = sums.agg(F.count(F.lit(1)), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in _pairs(len(names))]).first()
            fit.clusters["+".join(key)], fit.meats["+".join(key)] = row[0], _square(row[1:], len(names))
        return fit
    finally:
        base.unpersist()


def two_way(fit: Fit, a: str, b: str, term: int, fallback: str = "max") -> dict:
    """Cameron-Gelbach-Miller error of one term (no small-sample factor); a variance that isn't positive falls back to the larger one-way error, or to that of ``a``."""
    meat = fit.meats[a] + fit.meats[b] - fit.meats[f"{a}+{b}"]
    var = (fit.bread @ meat @ fit.bread)[term, term]
    se = {k: math.sqrt(max(0.0, fit.covariance(k, correct=False)[term, term])) for k in (a, b)}
    good = math.isfinite(var) and var > 0
    both = math.sqrt(var) if good else max(se.values()) if fallback == "max" else se[a]
    beta = float(fit.beta[term])
    return {"beta": beta, f"se_{a}": se[a], f"se_{b}": se[b], "se_twoway": both, "lo": beta - Z_EXACT * both, "hi": beta + Z_EXACT * both, "fallback": not good}


def multinomial(df: DataFrame, label: str, classes: Sequence[str], xs: dict[str, Column], cluster: str, weight: Column | None = None) -> tuple[Fit, Sequence[str]]:
    """Multinomial logit against the first class, clustered errors; terms are named class:term. A row counts ``weight`` times."""
    rest, p = list(classes[1:]), len(xs)
    names = [f"{c}:{t}" for c in rest for t in xs]
    base = df.select(F.col(cluster).alias("_g"), F.col(label).alias("_l"), _weight(weight).alias("_w"), *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(xs.values())])
    base = base.groupBy("_g", *[f"_x{i}" for i in range(p)]).agg(F.sum("_w").alias("_n"), *[F.sum(F.when(F.col("_l") == c, F.col("_w")).otherwise(0.0)).alias(f"_k{j}") for j, c in enumerate(rest)]).persist()
    cols = [F.col(f"_x{i}") for i in range(p)]

    def parts(beta: np.ndarray) -> tuple[list[Column], Column, list[Column]]:
        etas = [F.greatest(F.least(_linear(cols, beta[j * p : (j + 1) * p]), F.lit(50.0)), F.lit(-50.0)) for j in range(len(rest))]
        total = F.lit(1.0)
        for e in etas:
            total = total + F.exp(e)
        return etas, total, [F.exp(e) / total for e in etas]

    def stats(beta: np.ndarray):  # noqa: ANN202
        etas, total, mus = parts(beta)
        ll = -F.col("_n") * F.log(total)
        for j, e in enumerate(etas):
            ll = ll + F.col(f"_k{j}") * e
        grads = [F.sum((F.col(f"_k{j}") - F.col("_n") * mus[j]) * x) for j in range(len(rest)) for x in cols]
        hess = []
        for a, b in _pairs(len(names)):
            (j, i), (m, k) = divmod(a, p), divmod(b, p)
            hess.append(F.sum(F.col("_n") * mus[j] * ((1.0 if j == m else 0.0) - mus[m]) * cols[i] * cols[k]))
        row = base.agg(F.sum(ll), *grads, *hess).first()
        q = len(names)
        return float(row[0] or 0), np.array([float(v or 0) for v in row[1 : q + 1]]), _square(row[q + 1 :], q)

    try:
        beta, info, ok, _ = _newton(stats, len(names))
        engine = "newton"
        if not ok:
            beta = _quasi_newton(base, p, len(rest))
            value, grad, info = stats(beta)
            ok, engine = bool(np.abs(grad).max(initial=0) <= 1e-4 * max(1.0, abs(value))), "lbfgs"
        n = float(base.agg(F.sum("_n")).first()[0] or 0)
        fit = Fit(names, beta, _inverse(info), n, ok, engine)
        _, _, mus = parts(beta)
        scores = [F.sum((F.col(f"_k{j}") - F.col("_n") * mus[j]) * x).alias(f"s{j * p + i}") for j in range(len(rest)) for i, x in enumerate(cols)]
        row = base.groupBy("_g").agg(*scores).agg(F.count(F.lit(1)), *[F.sum(F.col(f"s{a}") * F.col(f"s{b}")) for a, b in _pairs(len(names))]).first()
        fit.clusters[cluster], fit.meats[cluster] = row[0], _square(row[1:], len(names))
        return fit, rest
    finally:
        base.unpersist()


def _quasi_newton(base: DataFrame, p: int, others: int) -> np.ndarray:
    """Point estimate by limited-memory BFGS where Newton steps don't settle, brought to the first class as base by subtraction.

    The first term is the intercept (a column of ones), which the library adds by itself.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rest = F.col("_n") - sum((F.col(f"_k{j}") for j in range(others)), F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("label"), w.alias("w")) for c, w in enumerate([rest, *[F.col(f"_k{j}") for j in range(others)]])]))
    rows = base.select(*[F.col(f"_x{i}") for i in range(1, p)], each.alias("e")).select("*", "e.*").where("w > 0")
    if p == 1:
        rows = rows.withColumn("_x1", F.lit(0.0))
    rows = VectorAssembler(inputCols=[f"_x{i}" for i in range(1, max(2, p))], outputCol="features").transform(rows)
    fit = LogisticRegression(family="multinomial", regParam=0.0, maxIter=500, tol=1e-10, weightCol="w").fit(rows)
    b = np.column_stack([fit.interceptVector.toArray(), fit.coefficientMatrix.toArray()[:, : p - 1]])
    return (b[1:] - b[0]).ravel()


def random_intercept(df: DataFrame, y: Column, xs: dict[str, Column], cluster: str, rounds: int = 9, points: int = 10) -> tuple[Fit, float, float]:
    """Linear mixed model with a random intercept per cluster by restricted likelihood: fit, residual and cluster variance.

    One row of sums per cluster is kept in Spark; every round profiles a grid of variance ratios in one aggregation and
    narrows it, so nothing but sums reaches the driver.
    """
    names, p = list(xs), len(xs)
    cols = [*xs.values(), y]
    t = df.select(F.col(cluster).alias("g"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(p + 1)], *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"q{i}_{j}") for i, j in _pairs(p + 1)]]
    each = t.groupBy("g").agg(*sums).persist()
    try:
        def profile(ratios: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray, float, float]]:
            aggs = []
            for k, r in enumerate(ratios):  # inverse covariance of a cluster: I - shrink * J
                shrink = r / (1 + F.col("n") * float(r))
                aggs += [F.sum(F.log1p(F.col("n") * float(r))).alias(f"d{k}"), *[F.sum(F.col(f"q{i}_{j}") - shrink * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"a{k}_{i}_{j}") for i, j in _pairs(p + 1)]]
            row = each.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), *aggs).first()
            out = []
            for k in range(len(ratios)):
                m = np.zeros((p + 1, p + 1))
                for i, j in _pairs(p + 1):
                    m[i, j] = m[j, i] = float(row[f"a{k}_{i}_{j}"] or 0)
                inv = _inverse(m[:p, :p])
                b = inv @ m[:p, p]
                free = float(row["n"] or 0) - p
                var = max(1e-300, (m[p, p] - b @ m[:p, p]) / max(1.0, free))
                reml = -0.5 * (free * math.log(var) + float(row[f"d{k}"] or 0) + np.linalg.slogdet(m[:p, :p])[1])
                out.append((reml, b, inv * var, var, float(row["n"] or 0)))
            return out

        lo, hi = -12.0, 6.0
        for _ in range(rounds):
            grid = np.linspace(lo, hi, points)
            fits = profile(np.exp(grid))
            at = int(np.argmax([f[0] for f in fits]))
            lo, hi = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
        _, beta, cov, var, n = fits[at]
        return Fit(names, beta, cov, n, True, "reml", clusters={cluster: each.count()}), var, var * float(np.exp(grid[at]))
    finally:
        each.unpersist()


def conditional_pairs(df: DataFrame, pair: str, critical: str, y: Column, xs: dict[str, Column] | None = None) -> Fit:
    """Conditional logit of 1:1 strata: differences within pairs that disagree, an intercept-free logit on them.

    A stratum with more than one row in an arm is not 1:1 and raises; see :func:`conditional_strata`.
    """
    xs = {critical: F.col(critical).cast("double"), **(xs or {})}
    arm = F.col(critical).cast("int")
    pick = lambda a, c: F.max(F.when(arm == a, c))
    t = df.groupBy(pair).agg(F.count_if(arm == 1).alias("n1"), F.count_if(arm == 0).alias("n0"), pick(1, y.cast("double")).alias("y1"), pick(0, y.cast("double")).alias("y0"), *[f(a, x.cast("double")).alias(f"{n}__{a}") for n, x in xs.items() for a in (1, 0) for f in (pick,)])
    if t.where("n1 > 1 or n0 > 1").limit(1).count():
        raise ValueError("strata are not 1:1")
    t = t.where("n1 = 1 and n0 = 1 and y1 != y0")
    sign = F.when(F.col("y1") == 1, 1.0).otherwise(-1.0)
    return logit(t, F.lit(1.0), {n: sign * (F.col(f"{n}__1") - F.col(f"{n}__0")) for n in xs})


#: Tails of a stratum's count that are left out have a logarithm below minus this, far beyond a double's digits.
_TAIL = 50.0
#: Cells of small strata that are summed at a time.
CELLS = 50_000


def _tilts(eta: np.ndarray, n: np.ndarray, m: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each stratum the shift of ``eta`` at which as many successes are expected as there are (nearly; it need not be exact)."""
    total = np.add.reduceat(n, start)
    size = np.diff(np.append(start, len(eta)))
    at = np.log(m / (total - m))
    low, high = at - np.maximum.reduceat(eta, start), at - np.minimum.reduceat(eta, start)
    shift = np.clip(at - np.add.reduceat(n * eta, start) / total, low, high)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(eta + np.repeat(shift, size), -700, 700)))
        gap, var = np.add.reduceat(n * q, start) - m, np.add.reduceat(n * q * (1 - q), start)
        if (np.abs(gap) <= 1e-3 * np.sqrt(var) + 1e-9 * m).all():
            break
        low, high = np.where(gap < 0, shift, low), np.where(gap > 0, shift, high)
        step = shift - gap / np.maximum(var, 1e-300)
        shift = np.where((step > low) & (step < high), step, (low + high) / 2)
    return shift


def conditional_cells(x: np.ndarray, n: np.ndarray, k: np.ndarray, start: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, score and information at ``b`` of strata made of cells: x (cells, terms), rows and successes of each; a stratum begins at each ``start``.

    Given its tilt, a stratum's successes are a sum of independent draws, so the denominator is the chance that it comes to
    the successes seen: the inverse Fourier transform of its characteristic function, and likewise for the first two moments.
    The transform is exact at as many points as there are rows; points at which aliases or the function itself fall below
    exp(-50) are left out, so that large strata need some twenty points rather than a step for each row and success.
    """
    p, size = x.shape[1], np.diff(np.append(start, len(x)))
    eta = x @ b
    m, total = np.add.reduceat(k, start), np.add.reduceat(n, start)
    shift = _tilts(eta, n, m, start)
    tilted = eta + np.repeat(shift, size)
    q = 1 / (1 + np.exp(-tilted))
    spread = n * q * (1 - q)
    var = np.add.reduceat(spread, start)
    middle = np.add.reduceat(spread[:, None] * x, start) / np.maximum(var, 1e-300)[:, None]
    centred = x - np.repeat(middle, size, axis=0)  # successes are fixed, so a stratum's constants tell nothing
    upper = np.triu_indices(p)
    squares = centred[:, upper[0]] * centred[:, upper[1]]
    reach = _TAIL / 3 + np.sqrt(_TAIL**2 / 9 + 2 * _TAIL * var)
    points = np.minimum(total + 1, np.ceil(reach) + 2)
    points += points % 2 == 0
    last = np.minimum((points - 1) / 2, np.ceil(np.arccos(np.maximum(-1.0, 1 - _TAIL / np.maximum(var, 1e-300))) * points / (2 * np.pi)))
    mass, first, second = np.zeros(len(start)), np.zeros((len(start), p)), np.zeros((len(start), len(upper[0])))
    large = size > 200
    for g in np.flatnonzero(large):  # matrix products, a stratum at a time
        c, j = slice(start[g], start[g] + size[g]), np.arange(int(last[g]) + 1)
        angle = 2 * np.pi * j / points[g]
        both = 1 + np.multiply.outer(np.exp(1j * angle) - 1, q[c])
        moved = 1 - (1 - q[c]) / both
        value = np.exp(np.log(both) @ n[c] - 1j * angle * m[g]) * np.where(j == 0, 1, 2) / points[g]
        off = (n[c] * (moved - q[c])) @ centred[c]
        mass[g], first[g] = value.real.sum(), (value @ off).real
        second[g] = (value @ ((n[c] * moved * (1 - moved)) @ squares[c] + off[:, upper[0]] * off[:, upper[1]])).real
    for j in range(int(last[~large].max(initial=-1)) + 1):  # all others at once, a point at a time
        some = ~large & (last >= j)
        live, cell, c = np.flatnonzero(some), size[some], np.repeat(some, size)
        begin = np.concatenate(([0], np.cumsum(cell)[:-1]))
        angle = 2 * np.pi * j / points[live]
        qc, nc = q[c], n[c]
        both = 1 + qc * np.repeat(np.exp(1j * angle) - 1, cell)
        moved = 1 - (1 - qc) / both
        value = np.exp(np.add.reduceat(nc * np.log(both), begin) - 1j * angle * m[live]) * ((1 if j == 0 else 2) / points[live])
        off = np.add.reduceat((nc * (moved - qc))[:, None] * centred[c], begin)
        more = np.add.reduceat((nc * moved * (1 - moved))[:, None] * squares[c], begin) + off[:, upper[0]] * off[:, upper[1]]
        mass[live] += value.real
        first[live] += (value[:, None] * off).real
        second[live] += (value[:, None] * more).real
    mean = first / mass[:, None]
    cov = (second / mass[:, None] - mean[:, upper[0]] * mean[:, upper[1]]).sum(0)
    info = np.zeros((p, p))
    info[upper] = cov
    info.T[upper] = cov
    whole = np.add.reduceat(k * tilted - n * np.logaddexp(0, tilted), start) - np.log(mass)
    grad = ((k - n * q)[:, None] * centred).sum(0) - mean.sum(0)
    return float(whole.sum()), grad, info


def conditional_sums(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """:func:`conditional_cells` of strata that agree in rows: x (strata, rows, terms), y (strata, rows)."""
    strata, n, p = x.shape
    return conditional_cells(x.reshape(-1, p), np.ones(strata * n), y.reshape(-1).astype(float), np.arange(strata) * n, b)


def conditional_by(df: DataFrame, key: Column, stratum: Sequence[str], y: Column, xs: dict[str, Column]) -> dict[object, Fit]:
    """A conditional logit of m:n strata for each value of ``key``, all in step with each other.

    Rows of a stratum that agree in their terms are one cell, concordant strata drop out. A stratum's cells are gathered once into
    arrays; every Newton step is one pass over them, in time that grows with the cells and not with the square of a
    stratum, and only sums per key reach the driver. A task holds one stratum's cells at least. Keys are a design's
    models or categories. ``clusters`` counts the strata used. ``y`` is 0 or 1; rows without it are left out.
    """
    names, p = list(xs), len(xs)
    terms, keys = [f"x{i}" for i in range(p)], [f"key{i}" for i in range(len(stratum))]
    rows = df.select(key.alias("_k"), *[F.col(f"`{c}`").alias(a) for c, a in zip(stratum, keys, strict=True)], y.cast("double").alias("y"), *[x.cast("double").alias(t) for t, x in zip(terms, xs.values(), strict=True)])
    cells = rows.where("y IS NOT NULL").groupBy("_k", *keys, *terms).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"))
    t = cells.groupBy("_k", *keys).agg(F.collect_list(F.struct("n", "s", *terms)).alias("_r"), F.sum("n").alias("_rows"), F.sum("s").alias("_won"))
    flat = lambda c: F.transform("_r", lambda r: r[c])
    t = t.where("_won > 0 AND _won < _rows").select("_k", flat("n").alias("n"), flat("s").alias("s"), F.flatten(F.transform("_r", lambda r: F.array(*[r[c] for c in terms]))).alias("x"))
    t = t.repartition(df.sparkSession.sparkContext.defaultParallelism * 4).persist()
    shape = ", ".join(["_k " + dict(t.dtypes)["_k"], "ll double", *[f"g{i} double" for i in range(p)], *[f"h{i}_{j} double" for i, j in _pairs(p)]])

    def stats(betas: dict[object, np.ndarray]) -> dict[object, tuple]:
        def run(batches):  # noqa: ANN001, ANN202
            import pandas as pd

            for pdf in batches:
                out = []
                for k, part in pdf.groupby("_k", dropna=False):
                    if k in betas:
                        size = part["n"].map(len).to_numpy()
                        deal = np.cumsum(size) // CELLS
                        for d in np.unique(deal):
                            some, cells = part[deal == d], size[deal == d]
                            begin = np.concatenate(([0], np.cumsum(cells)[:-1]))
                            n, s, x = (np.concatenate(some[c].to_numpy()) for c in ("n", "s", "x"))
                            ll, g, h = conditional_cells(x.reshape(len(n), p), n, s, begin, betas[k])
                            out.append((k, ll, *g, *[h[i, j] for i, j in _pairs(p)]))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")])

        sums = t.mapInPandas(run, shape)
        got = sums.groupBy("_k").agg(*[F.sum(c).alias(c) for c in sums.columns[1:]]).collect()
        return {r["_k"]: (float(r[1]), np.array(r[2 : p + 2], dtype=float), _square(r[p + 2 :], p)) for r in got}

    try:
        sizes = {r["_k"]: (r["s"], r["n"]) for r in t.groupBy("_k").agg(F.count(F.lit(1)).alias("s"), F.sum(F.aggregate("n", F.lit(0.0), lambda a, v: a + v)).alias("n")).collect()}
        beta = {k: np.zeros(p) for k in sizes}
        at = stats(beta) if beta else {}
        step = {k: np.linalg.lstsq(at[k][2], at[k][1], rcond=None)[0] for k in beta}
        done, halved = {}, dict.fromkeys(beta, 0)
        for _ in range(MAX_STEPS):
            for k in list(step):
                settled, lost = np.abs(step[k]).max(initial=0) < TOLERANCE, np.abs(beta[k]).max(initial=0) > 1e3 or at[k][0] > -1e-5
                if settled or lost:  # a likelihood next to one has no finite maximum
                    done[k] = bool(settled and not lost)
                    del step[k]
            if not step:
                break
            new = stats({k: beta[k] + s for k, s in step.items()})
            for k in list(step):
                if new[k][0] >= at[k][0] - 1e-9 * abs(at[k][0]) or halved[k] >= 12:
                    beta[k], at[k], halved[k] = beta[k] + step[k], new[k], 0
                    step[k] = np.linalg.lstsq(at[k][2], at[k][1], rcond=None)[0]
                else:
                    step[k], halved[k] = step[k] / 2, halved[k] + 1
        return {k: Fit(names, beta[k], _inverse(at[k][2]), float(n), done.get(k, False), clusters={"strata": int(s)}) for k, (s, n) in sizes.items()}
    finally:
        t.unpersist()


def conditional_strata(df: DataFrame, stratum: str, y: Column, xs: dict[str, Column]) -> Fit:
    """Conditional logit of m:n strata on all rows; see :func:`conditional_by`. Without a discordant stratum nothing is fitted."""
    fits = conditional_by(df, F.lit(1), [stratum], y, xs)
    return fits.get(1, Fit(list(xs), np.zeros(len(xs)), np.zeros((len(xs), len(xs))), 0.0, False, notes="no discordant stratum"))


def conditional_counts(df: DataFrame, stratum: str, critical: str, y: Column) -> Fit:
    """Conditional logit of one two-armed factor in m:n strata, on (stratum, arm) counts of rows and successes.

    Given its successes a stratum's count in the critical arm is noncentral hypergeometric, the likelihood of
    :func:`conditional_strata` on the rows (and of :func:`conditional_pairs` where strata are 1:1). Strata without both
    arms or without both outcomes tell nothing; rows without outcome or arm are left out. ``clusters`` counts the strata used.
    """
    arm, yy = F.col(critical).cast("int"), y.cast("double")
    counts = [f.alias(f"{n}{a}") for a in (1, 0) for n, f in (("n", F.count(F.when(arm == a, yy))), ("k", F.count_if((arm == a) & (yy > 0))))]
    t = df.groupBy(stratum).agg(*counts)
    t = t.withColumn("m", F.col("k1") + F.col("k0")).where("n1 > 0 and n0 > 0 and m > 0 and m < n1 + n0")
    cells = t.groupBy("n1", "n0", "m").agg(F.sum("k1").alias("k1"), F.count(F.lit(1)).alias("c")).persist()

    def stats(beta: np.ndarray):  # noqa: ANN202
        b = float(beta[0])

        def run(batches):  # noqa: ANN001, ANN202
            import pandas as pd

            for pdf in batches:
                logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int((pdf["n1"] + pdf["n0"]).max()) + 1))))) if len(pdf) else None
                rows = []
                for n1, n0, m, k1, c in pdf[["n1", "n0", "m", "k1", "c"]].itertuples(index=False):
                    k = np.arange(max(0, m - n0), min(n1, m) + 1)
                    w = k * b - logs[k] - logs[n1 - k] - logs[m - k] - logs[n0 - m + k]
                    top = w.max()
                    e = np.exp(w - top)
                    mean = float(k @ e / e.sum())
                    ways = logs[n1] + logs[n0] + top + math.log(e.sum())
                    rows.append((k1 * b - c * float(ways), k1 - c * mean, c * float((k - mean) ** 2 @ e / e.sum())))
                yield pd.DataFrame(rows, columns=["ll", "g", "h"])

        row = cells.mapInPandas(run, "ll double, g double, h double").agg(F.sum("ll"), F.sum("g"), F.sum("h")).first()
        return float(row[0] or 0), np.array([float(row[1] or 0)]), np.array([[float(row[2] or 0)]])

    try:
        beta, info, ok, _ = _newton(stats, 1)
        used = cells.agg(F.sum("c"), F.sum(F.col("c") * (F.col("n1") + F.col("n0")))).first()
        return Fit([critical], beta, _inverse(info), float(used[1] or 0), ok, clusters={stratum: int(used[0] or 0)})
    finally:
        cells.unpersist()


def gee_exchangeable(df: DataFrame, y: Column, xs: dict[str, Column], cluster: str, steps: int = 40, weight: Column | None = None) -> dict:
    """Population-averaged logit with exchangeable working correlation, robust errors; falls back to independence.

    The inverse correlation is aI + bJ, so each cluster enters by sums only. A fit that runs away, whose slope exceeds
    :data:`PLAUSIBLE` or whose error collapses counts as not converged, whatever the steps say. Equal rows of a cluster are
    counted once before the steps, which read these counts; a row counts ``weight`` times.
    """
    names, p = list(xs), len(xs)
    base = df.select(F.col(cluster).alias("_g"), y.cast("double").alias("_y"), _weight(weight).alias("_w"), *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(xs.values())])
    base = base.groupBy(*[c for c in base.columns if c != "_w"]).agg(F.sum("_w").alias("_n")).persist()
    cols, n = [F.col(f"_x{i}") for i in range(p)], F.col("_n")
    start = logit(base, F.col("_y"), dict(zip(names, cols, strict=True)), ["_g"], weight=n)

    def clusters(beta: np.ndarray) -> DataFrame:
        mu = sigmoid(_linear(cols, beta))
        sd = F.sqrt(mu * (1 - mu))
        r = (F.col("_y") - mu) / sd
        return base.groupBy("_g").agg(
            F.sum(n).alias("m"), F.sum(n * r).alias("r"), F.sum(n * r * r).alias("rr"), *[F.sum(n * sd * x).alias(f"d{i}") for i, x in enumerate(cols)],
            *[F.sum(n * sd * x * r).alias(f"e{i}") for i, x in enumerate(cols)], *[F.sum(n * sd * sd * cols[i] * cols[j]).alias(f"v{i}_{j}") for i, j in _pairs(p)],
        )

    def solve(alpha: float, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        t = clusters(beta)
        a = 1 / (1 - alpha)
        b = F.lit(-alpha * a) / (1 + (F.col("m") - 1) * alpha)
        u = [a * F.col(f"e{i}") + b * F.col(f"d{i}") * F.col("r") for i in range(p)]
        row = t.agg(F.count(F.lit(1)), *[F.sum(x) for x in u], *[F.sum(a * F.col(f"v{i}_{j}") + b * F.col(f"d{i}") * F.col(f"d{j}")) for i, j in _pairs(p)], *[F.sum(u[i] * u[j]) for i, j in _pairs(p)]).first()
        k = len(_pairs(p))
        return np.array(row[1 : p + 1], dtype=float), _square(row[p + 1 : p + 1 + k], p), _square(row[p + 1 + k :], p), row[0]

    def finish(beta: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, int]:
        _, info, meat, g = solve(alpha, beta)
        inv = np.linalg.pinv(info)
        return beta, np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0)), g

    try:
        beta, alpha, ok = start.beta.copy(), 0.0, False
        for _ in range(steps):
            s = clusters(beta).agg(F.sum("rr"), F.sum((F.col("r") * F.col("r") - F.col("rr")) / 2), F.sum(F.col("m") * (F.col("m") - 1) / 2), F.sum("m")).first()
            phi = s[0] / max(1.0, s[3] - p)
            alpha = float(np.clip(s[1] / max(1.0, s[2] - p) / phi, -0.99, 0.99))
            grad, info, _, _ = solve(alpha, beta)
            step = np.linalg.lstsq(info, grad, rcond=None)[0]
            beta = beta + step
            if not np.isfinite(beta).all() or np.abs(beta).max() > PLAUSIBLE:
                break
            if np.abs(step).max() < 1e-7:
                ok = True
                break
        if ok:
            beta, se, g = finish(beta, alpha)
            ok = bool(np.isfinite(se).all() and se[-1] > 0 and abs(beta[-1]) <= PLAUSIBLE)
        used = "exchangeable"
        if not ok:
            used, alpha = "independence_fallback", 0.0
            beta, se, g = finish(start.beta, 0.0)
        return {"names": names, "beta": beta, "se": se, "alpha": alpha, "cov_struct_used": used, "exchangeable_converged": used == "exchangeable", "n_groups": int(g)}
    finally:
        base.unpersist()


def slopes_by(df: DataFrame, key: str, y: Column, x: str, cluster: str, weight: Column | None = None) -> DataFrame:
    """Univariate clustered logit per key in one distributed pass: (cluster, x) counts, Newton per key in its own task."""
    w = _weight(weight)
    t = df.groupBy(F.col(key).alias("key"), F.col(cluster).alias("g"), F.col(x).cast("double").alias("x")).agg(F.sum(w).alias("n"), F.sum(y.cast("double") * w).alias("k"))

    def one(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        beta, se, ok = fit_counts(pdf["x"].to_numpy(), pdf["k"].to_numpy(), pdf["n"].to_numpy(), pdf["g"].to_numpy())
        return pd.DataFrame([[pdf["key"].iloc[0], float(beta), float(se), bool(ok), int(pdf["n"].sum())]], columns=["key", "slope", "se", "converged", "n"])

    return t.groupBy("key").applyInPandas(one, "key string, slope double, se double, converged boolean, n long").withColumnRenamed("key", key)


def fit_counts(x: np.ndarray, k: np.ndarray, n: np.ndarray, g: np.ndarray | None = None, steps: int = 50) -> tuple[float, float, bool]:
    """Slope, clustered error (default factor) and success of a logit on (x, successes, trials, cluster) counts."""
    xx = np.stack([np.ones_like(x), x], axis=1)
    b, ok = np.zeros(2), False
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-np.clip(xx @ b, -35, 35)))
        info = (xx * (n * mu * (1 - mu))[:, None]).T @ xx
        if np.linalg.matrix_rank(info) < 2:
            return float("nan"), float("nan"), False
        step = np.linalg.solve(info, xx.T @ (k - n * mu))
        b = b + step
        if np.abs(b).max() > 1e3:
            return float("nan"), float("nan"), False
        if np.abs(step).max() < 1e-10:
            ok = True
            break
    if not ok:
        return float("nan"), float("nan"), False
    mu = 1 / (1 + np.exp(-np.clip(xx @ b, -35, 35)))
    inv = np.linalg.inv((xx * (n * mu * (1 - mu))[:, None]).T @ xx)
    if g is None:
        return float(b[1]), float(np.sqrt(inv[1, 1])), True
    s = (k - n * mu)[:, None] * xx
    _, at = np.unique(g, return_inverse=True)
    sums = np.zeros((at.max() + 1, 2))
    np.add.at(sums, at, s)
    c, total = len(sums), n.sum()
    v = inv @ (sums.T @ sums) @ inv * (c / max(1, c - 1)) * ((total - 1) / max(1, total - 2))
    return float(b[1]), float(np.sqrt(max(0, v[1, 1]))), True
