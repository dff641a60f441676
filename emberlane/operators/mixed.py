"""Logit with crossed random intercepts by variational Bayes: one factor with any number of levels, others with a few.

Posteriors are independent normals for every coefficient, level and log standard deviation. Priors are the usual ones of
this engine (fixed values): normal with standard deviation 2 for coefficients of scaled covariates, 1 for log standard
deviations. A step is one pass over the rows: each row's expected probability and weight under the posterior come from
Gauss-Hermite quadrature, sums go to the levels of the large factor, and their Schur complement leaves a system in the
coefficients and small factors alone, which the driver solves. So a step moves all means jointly, as Newton's method does.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.scratch import Scratch

#: Standard deviations of the priors of scaled coefficients and of log standard deviations.
COEFFICIENT_SD, LOG_SD_SD = 2.0, 1.0
#: Levels of all small factors together, at most; they are columns of the driver's system.
SMALL_LEVELS = 300
#: Bytes of a block, at most: Spark's Parquet reader holds 4096 blocks at a time, whatever their size. Patterns that a task works on at a time.
BLOCK_BYTES, CHUNK = 16 << 10, 8192
#: Bytes of an Arrow batch, at most.
BATCH_BYTES = 8 << 20
STEPS, TOLERANCE, NODES, LARGEST_MOVE, LARGEST_LOG_MOVE = 80, 1e-5, 12, 2.0, 0.5


@dataclass
class MixedFit:
    """Posterior means and deviations of the coefficients (by name, in the covariates' own units), medians of the factors' deviations.

    The bound is that of a settled fit, without constants; else NaN.
    """

    names: list[str]
    mean: np.ndarray
    sd: np.ndarray
    deviations: dict[str, float]
    levels: dict[str, int]
    n: int
    steps: int
    converged: bool
    bound: float


def expectations(m: np.ndarray, v: np.ndarray, soft: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Means of sigmoid, of its derivative and, if wanted, of log(1 + exp) for normals of mean ``m`` and variance ``v``.

    Nodes come in pairs about the mean, so a pair needs one exponential.
    """
    at, weight = np.polynomial.hermite.hermgauss(NODES)
    less, sd = np.exp(-np.clip(m, -300, 300)), np.sqrt(2 * v)
    p, squares, logs = np.zeros(len(m)), np.zeros(len(m)), np.zeros(len(m)) if soft else None
    for t, w in zip(at[NODES // 2 :], weight[NODES // 2 :] / math.sqrt(math.pi), strict=True):
        far = np.exp(np.minimum(sd * t, 300))
        up, down = 1 + less / far, 1 + less * far
        if soft:
            logs += w * np.log(up * down)
        np.reciprocal(up, out=up)
        np.reciprocal(down, out=down)
        p += w * (up + down)
        squares += w * (up * up + down * down)
    return p, np.maximum(p - squares, 0), m + logs if soft else None


def log_sd(levels: int, square: float, power: float, precision: float, old: tuple[float, float], prior: float = LOG_SD_SD) -> tuple[float, float]:
    """Posterior (mean, variance) of a factor's log standard deviation from the levels' expected sum of squares.

    ``power`` says how that sum will follow the factor's ``precision`` (elasticity, at most 0), so that a step does not crawl.
    """
    (before, s2), m = old, old[0]
    power = min(0.0, max(-0.998, power))
    for _ in range(50):
        lo, hi = -15.0, 15.0
        for _ in range(80):
            m = (lo + hi) / 2
            expected = math.exp(-2 * m + 2 * s2)
            gap = -levels + expected * square * (expected / precision) ** power - m / prior**2
            lo, hi = (m, hi) if gap > 0 else (lo, m)
        expected = math.exp(-2 * m + 2 * s2)
        new = 1 / (2 * expected * square * (expected / precision) ** power + 1 / prior**2)
        if abs(new - s2) < 1e-12:
            break
        s2 = new
    return min(before + LARGEST_LOG_MOVE, max(before - LARGEST_LOG_MOVE, m)), s2


def _packed(xs: int, ys: int, center: np.ndarray, scale: np.ndarray, small: list[list]) -> Callable:
    """Patterns, sorted by level, as blocks of one level of the large factor: scaled covariates, places of small levels, counts."""
    first = np.cumsum([xs, *map(len, small)])
    names = ["g", "m", "x", "f", "k"]
    block = max(1, BLOCK_BYTES // (8 * xs + 4 * len(small) + 8 * (1 + ys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            x = np.stack([(get(f"x{k}") - center[k]) / scale[k] for k in range(xs)], axis=1)
            f = np.empty((n, len(small)), dtype=np.int32)
            for k, levels in enumerate(small):
                f[:, k] = first[k] + pc.index_in(batch.column(f"f{k}"), value_set=pa.array(levels, pa.string())).to_numpy()
            counts = np.stack([get("n"), *[get(f"k{c}") for c in range(ys)]], axis=1)
            at = batch.column("g").dictionary_encode().indices.to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            cut = [i for a, b in zip(begin, [*begin[1:], n], strict=True) for i in range(a, b, block)]
            ends = [*cut[1:], n]
            blobs = [pa.array([v[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for v in (x, f, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(cut)), pa.array(np.subtract(ends, cut), pa.int64()), *blobs], names=names)

    return run


def _flat(batch: pa.RecordBatch, column: str, kind: type, width: int) -> np.ndarray:
    """The blocks' rows under one another, without a copy: a batch's binary values lie side by side."""
    col = batch.column(column)
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return np.frombuffer(data if data is not None else b"", dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def _row_sums(ys: list[int], n_ys: int, xs: int, mean: np.ndarray, var: np.ndarray, factors: int) -> Callable:
    """Rows (g, part): for each level and batch its sums of gap, weight and weighted columns; for a task (g null) the totals.

    Every outcome of ``ys`` (a row of ``mean`` and ``var``) has its sums in a part, one after another. Small factors are columns
    of zeros and ones, so their sums are those of runs of rows with the same levels.
    """
    p = mean.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps, cross = np.zeros((len(ys), p)), np.zeros((len(ys), p, p))
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.repeat(np.arange(batch.num_rows), batch.column("m").to_numpy())
            x_all, f_all, k_all = _flat(batch, "x", np.float64, xs), _flat(batch, "f", np.int32, factors) if factors else np.zeros((len(block), 0), np.int32), _flat(batch, "k", np.float64, 1 + n_ys)
            mu, s2 = ([batch.column(f"{c}{y}").to_numpy() for y in ys] for c in ("mu", "s2"))
            part = np.zeros((batch.num_rows, len(ys), p + 2))
            for a in range(0, len(block), CHUNK):
                own, f = block[a : a + CHUNK], f_all[a : a + CHUNK]
                x = np.ascontiguousarray(x_all[a : a + CHUNK].T)
                counts = np.ascontiguousarray(k_all[a : a + CHUNK].T)
                begin = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (f[1:] != f[:-1]).any(1))))
                levels, at, square = f[begin], own[begin], x * x
                run_of = np.repeat(np.arange(len(begin)), np.diff([*begin, len(own)]))
                for i, y in enumerate(ys):
                    eta = mean[i, :xs] @ x + (mean[i][levels].sum(1) + mu[i][at])[run_of]
                    prob, slope, _ = expectations(eta, var[i, :xs] @ square + (var[i][levels].sum(1) + s2[i][at])[run_of])
                    sums = np.empty((xs + 2, len(own)))
                    sums[0], sums[1] = counts[1 + y] - counts[0] * prob, counts[0] * slope
                    sums[2:] = x * sums[1]
                    gaps[i, :xs] += x @ sums[0]
                    cross[i, :xs, :xs] += sums[2:] @ x.T
                    sums = np.add.reduceat(sums, begin, axis=1).T
                    np.add.at(part[:, i], (at, slice(0, xs + 2)), sums)
                    for k in range(factors):
                        np.add.at(part[:, i], (at, 2 + levels[:, k]), sums[:, 1])
                        np.add.at(gaps[i], levels[:, k], sums[:, 0])
                        np.add.at(cross[i, :, :xs], levels[:, k], sums[:, 2:])
                        for j in range(factors):
                            np.add.at(cross[i], (levels[:, k], levels[:, j]), sums[:, 1])
            at = batch.column("g").dictionary_encode().indices.to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            names = batch.column("g").take(pa.array(begin)).to_numpy(zero_copy_only=False)
            yield _parts(names, np.add.reduceat(part, begin, axis=0).reshape(len(begin), -1))
        cross[:, :xs, xs:] = cross[:, xs:, :xs].transpose(0, 2, 1)
        yield _parts(np.array([None], dtype=object), np.concatenate([gaps.ravel(), cross.ravel()])[None])

    return run


def _fit_sums(y: int, n_ys: int, xs: int, mean: np.ndarray, var: np.ndarray, factors: int) -> Callable:
    """A task's expected log likelihood of one outcome."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = 0.0
        for batch in batches:
            block = np.repeat(np.arange(batch.num_rows), batch.column("m").to_numpy())
            mu, s2 = (batch.column(f"{c}{y}").to_numpy() for c in ("mu", "s2"))
            x_all, k_all = _flat(batch, "x", np.float64, xs), _flat(batch, "k", np.float64, 1 + n_ys)
            f_all = _flat(batch, "f", np.int32, factors) if factors else np.zeros((len(block), 0), np.int32)
            for a in range(0, len(block), CHUNK):
                x, f, own, counts = (v[a : a + CHUNK] for v in (x_all, f_all, block, k_all))
                eta = x @ mean[:xs] + mean[f].sum(1) + mu[own]
                soft = expectations(eta, (x * x) @ var[:xs] + var[f].sum(1) + s2[own], True)[2]
                fit += float(counts[:, 1 + y] @ eta - counts[:, 0] @ soft)
        yield _parts(np.array([None], dtype=object), np.array([[fit]]))

    return run


def _parts(names: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], names=["g", "part"])


def _level_sums(ys: list[int], precision: list[float], p: int) -> Callable:
    """Totals over the large factor's levels: what eliminating their means adds to each outcome's system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, gaps = np.zeros((len(ys), p, p)), np.zeros((len(ys), p))
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            for i, (y, hold) in enumerate(zip(ys, precision, strict=True)):
                x = np.stack([get(f"c{y}_{k}") for k in range(p)], axis=1)
                held = hold + get(f"w{y}")
                cross[i] += (x / held[:, None]).T @ x
                gaps[i] += ((get(f"gap{y}") - hold * get(f"mu{y}")) / held) @ x
        yield _parts(np.array([None], dtype=object), np.concatenate([cross.ravel(), gaps.ravel()])[None])

    return run


def _moved(ys: list[int], precision: list[float], moves: list[np.ndarray]) -> Callable:
    """The large factor's levels after a step that moves an outcome's other means by its entry of ``moves``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            out = {"g": batch.column("g")}
            for y, hold, move in zip(ys, precision, moves, strict=True):
                held, mu = get(f"w{y}") + hold, get(f"mu{y}")
                pull = sum(get(f"c{y}_{j}") * v for j, v in enumerate(move))
                shift = np.clip((get(f"gap{y}") - mu * hold - pull) / held, -LARGEST_MOVE, LARGEST_MOVE)
                out |= {f"mu{y}": pa.array(mu + shift), f"s2{y}": pa.array(1 / held)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _total(parts: DataFrame) -> np.ndarray:
    """The sum of arrays of one length, position by position: Spark adds, the driver gets one number a position."""
    rows = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def _bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of :data:`BATCH_BYTES` in this session, unless fewer bytes are set: a task holds some of them beside its heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key, "67108864b").rstrip("b")
    if not given.isdigit() or int(given) > BATCH_BYTES:  # -1 is no limit
        spark.conf.set(key, str(BATCH_BYTES))


def crossed_logit(df: DataFrame, y: Column, xs: dict[str, Column], large: str, small: Sequence[str] = (), steps: int = STEPS) -> MixedFit:
    """The fit of one outcome, see :func:`crossed_logits`."""
    return crossed_logits(df, {"y": y}, xs, large, small, steps)["y"]


def crossed_logits(df: DataFrame, ys: dict[str, Column], xs: dict[str, Column], large: str, small: Sequence[str] = (), steps: int = STEPS) -> dict[str, MixedFit]:
    """Variational fits of ``y ~ xs`` (an intercept among them) with a random intercept per level of ``large`` and of each of ``small``.

    The outcomes ``ys`` are fitted apart but in step: rows are counted by pattern once for all of them, and a step's pass over
    the patterns serves those that have not settled. Patterns lie in blocks of one level of ``large``; its levels are a stored
    table that joins the blocks, so a level with very many rows is only ever met as partial sums. The levels of ``small``, at most
    :data:`SMALL_LEVELS` in all, else it raises, are collected. Covariates are centred and scaled for the fit (an intercept is at
    their means) and slopes are given in their own units. A null in a covariate, a factor or an outcome raises: a fit must not
    shrink its table unseen. ``converged`` says whether all means and log deviations settled within ``steps``.
    """
    names = list(xs)
    keep = [F.col(large).cast("string").alias("g"), *[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(small)]]
    outcomes = [c.cast("double").alias(f"y{k}") for k, c in enumerate(ys.values())]
    rows = df.select(*keep, *[c.cast("double").alias(f"x{k}") for k, c in enumerate(xs.values())], *outcomes)
    keys = rows.columns[: -len(ys)]
    any_null = F.lit(False)
    for c in rows.columns:
        any_null = any_null | F.col(c).isNull()
    _bounded_batches(df.sparkSession)
    with Scratch(df.sparkSession) as scratch:
        sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"y{k}").alias(f"k{k}") for k in range(len(ys))], F.max(any_null.cast("int")).alias("bad")]
        counted = scratch.keep(rows.groupBy(*keys).agg(*sums))
        moments = [f(F.col(f"x{k}"), F.col("n")) for k in range(len(names)) for f in (lambda x, n: F.sum(x * n), lambda x, n: F.sum(x * x * n))]
        n, bad, *sums = counted.agg(F.sum("n"), F.max("bad"), *moments).first()
        if n is None or bad:
            raise ValueError("a mixed fit needs rows, and none with a null in what it uses")
        center = np.array(sums[::2]) / n
        scale = np.sqrt(np.maximum(0, np.array(sums[1::2]) / n - center**2))
        fixed = scale <= 1e-8  # the intercept
        center, scale = np.where(fixed, 0, center), np.where(fixed, 1, scale)
        levels: dict[str, list] = {}
        for k, f in enumerate(small):
            levels[f] = sorted(r[0] for r in counted.select(f"f{k}").distinct().limit(SMALL_LEVELS + 1).collect())
        if sum(map(len, levels.values())) > SMALL_LEVELS:
            raise ValueError(f"small factors have more than {SMALL_LEVELS} levels together")
        order = ["g", *[f"f{k}" for k in range(len(small))]]
        blocks = counted.drop("bad").sortWithinPartitions(*order).mapInArrow(_packed(len(names), len(ys), center, scale, list(levels.values())), "g string, m long, x binary, f binary, k binary")
        blocks = scratch.keep(blocks)
        scratch.drop(counted)
        return _fitted(scratch, blocks, list(ys), names, center, scale, large, levels, int(n), steps)


@dataclass
class _State:
    """Where an outcome's fit stands: coefficients and small levels, and log deviations (of the large factor first)."""

    mean: np.ndarray
    var: np.ndarray
    sds: list[tuple[float, float]]
    fit: MixedFit | None = None


def _fitted(scratch: Scratch, blocks: DataFrame, outcomes: list[str], names: list[str], center: np.ndarray, scale: np.ndarray, large: str, small: dict[str, list], n: int, steps: int) -> dict[str, MixedFit]:
    sizes = [len(names), *map(len, small.values())]
    owner = np.repeat(np.arange(len(sizes)), sizes)  # 0: coefficients, else the number of the small factor
    p, q, shape = len(owner), len(names), (len(outcomes), len(names))
    states = [_State(np.zeros(p), np.full(p, 0.01), [(-0.5, 0.1)] * len(sizes)) for _ in outcomes]
    start = {c: F.lit(v) for k in range(len(outcomes)) for c, v in ((f"mu{k}", 0.0), (f"s2{k}", 0.1))}
    table = scratch.keep(blocks.select("g").distinct()).withColumns(start)
    n_large = table.count()
    counts = {large: n_large, **{f: len(v) for f, v in small.items()}}
    held: list[DataFrame] = []
    for step in range(1, steps + 1):
        live = [k for k, s in enumerate(states) if s.fit is None]
        means, vars_ = (np.stack([getattr(states[k], a) for k in live]) for a in ("mean", "var"))
        precisions = [np.array([math.exp(-2 * m + 2 * s) for m, s in states[k].sds]) for k in live]
        parts = scratch.keep(blocks.join(table, "g").mapInArrow(_row_sums(live, *shape, means, vars_, len(small)), "g string, part array<double>"))
        total = _total(parts.where("g is null"))
        gaps, cross = total[: len(live) * p].reshape(-1, p), total[len(live) * p :].reshape(-1, p, p)
        columns = [c for k in live for c in (f"gap{k}", f"w{k}", *[f"c{k}_{j}" for j in range(p)])]
        add = [F.sum(F.col("part")[k]).alias(c) for k, c in enumerate(columns)]
        sums = scratch.keep(parts.where("g is not null").groupBy("g").agg(*add).join(table, "g"))
        level = _total(sums.mapInArrow(_level_sums(live, [float(r[0]) for r in precisions], p), "g string, part array<double>"))
        away, lost = level[: len(live) * p * p].reshape(-1, p, p), level[len(live) * p * p :].reshape(-1, p)
        off, moves, olds = [], [], []
        for i, k in enumerate(live):
            s, precision = states[k], precisions[i]
            olds.append(np.array([m for m, _ in s.sds]))
            prior = np.where(owner == 0, COEFFICIENT_SD**-2, precision[owner])
            move = np.linalg.solve(cross[i] + np.diag(prior) - away[i], gaps[i] - prior * s.mean - lost[i])
            move *= min(1.0, LARGEST_MOVE / np.abs(move).max())
            mean, var, sds = s.mean + move, 1 / (prior + np.diag(cross[i])), list(s.sds)
            for f in range(1, len(sizes)):
                mine = owner == f
                square = float((mean[mine] ** 2 + var[mine]).sum())
                follows = float((2 * mean[mine] ** 2 * var[mine] + var[mine] ** 2).sum())
                sds[f] = log_sd(sizes[f], square, -follows * precision[f] / square, precision[f], sds[f])
            off.append(max(np.abs(move).max(), np.abs(np.sqrt(var) - np.sqrt(s.var)).max()))
            s.mean, s.var, s.sds = mean, var, sds
            moves.append(move)
        schema = ", ".join(["g string", *[f"{c}{k} double" for k in live for c in ("mu", "s2")]])
        table = sums.mapInArrow(_moved(live, [float(r[0]) for r in precisions], moves), schema)
        own = lambda k: F.col(f"mu{k}") * F.col(f"mu{k}")
        found = table.agg(*[F.sum(c) for k in live for c in (own(k) + F.col(f"s2{k}"), (2 * own(k) + F.col(f"s2{k}")) * F.col(f"s2{k}"), F.log(f"s2{k}"))]).first()
        for i, k in enumerate(live):
            s, precision, (square, follows, logs) = states[k], float(precisions[i][0]), found[3 * i : 3 * i + 3]
            s.sds[0] = log_sd(n_large, square, -follows * precision / square, precision, s.sds[0])
            settled = max(off[i], np.abs(np.array([m for m, _ in s.sds]) - olds[i]).max()) < TOLERANCE
            if settled or step == steps:
                bound = math.nan
                if settled:
                    fit = _total(blocks.join(table, "g").mapInArrow(_fit_sums(k, *shape, s.mean, s.var, len(small)), "g string, part array<double>"))[0]
                    bound = float(fit) + _prior_terms(s.sds, owner, s.mean, s.var, n_large, square, logs)
                deviations = {f: math.exp(m) for f, (m, _) in zip(counts, s.sds, strict=True)}
                s.fit = MixedFit(names, s.mean[:q] / scale, np.sqrt(s.var[:q]) / scale, deviations, counts, n, step, settled, bound)
        scratch.drop(parts)
        held.append(sums)
        for old_table in held[:-2]:
            scratch.drop(old_table)
        held = held[-2:]
        if all(s.fit for s in states):
            break
    return {name: s.fit for name, s in zip(outcomes, states, strict=True)}


def _prior_terms(sds: list, owner: np.ndarray, mean: np.ndarray, var: np.ndarray, n_large: int, square: float, logs: float) -> float:
    """What priors and entropies add to the bound, constants left out."""
    out = -float((mean[owner == 0] ** 2 + var[owner == 0]).sum()) / (2 * COEFFICIENT_SD**2) + 0.5 * float(np.log(var).sum()) + 0.5 * logs
    for f, (m, s2) in enumerate(sds):
        mine = owner == f
        levels, q = (n_large, square) if f == 0 else (int(mine.sum()), float((mean[mine] ** 2 + var[mine]).sum()))
        out += -levels * m - 0.5 * math.exp(-2 * m + 2 * s2) * q - (m * m + s2) / (2 * LOG_SD_SD**2) + 0.5 * math.log(s2)
    return out
