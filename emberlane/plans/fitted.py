"""DuckDB SQL that fits logistic models by itself: Newton steps as a recursive table, systems solved by elimination columns.

The text is generated for any number of terms. It shares nothing with the Spark fits but the data, so agreement of
coefficients and clustered errors is a check of both.
"""
from __future__ import annotations

from collections.abc import Sequence

STEPS = 20
Z = "1.959963984540054"


def _eliminated(inner: str, keep: str, p: int, rhs: Sequence[str]) -> str:
    """Gauss-Jordan on the positive definite system h{i}_{j} (upper half) of ``inner`` for columns ``{rhs}{i}``: the solutions under the same names."""
    at = lambda i, j: f"h{min(i, j)}_{max(i, j)}"
    sql = f"SELECT {keep}, {', '.join(f'{at(i, j)} AS a{i}_{j}' for i in range(p) for j in range(p))}, {', '.join(f'{r}{i}' for r in rhs for i in range(p))} FROM ({inner})"
    for k in range(p):
        left = [(f"a{{}}_{j}", j) for j in range(k + 1, p)]
        names = [n for n, _ in left] + [f"{r}{{}}" for r in rhs]
        out = [f"{n.format(i)} / a{k}_{k} AS {n.format(i)}" if i == k else f"{n.format(i)} - a{i}_{k} * ({n.format(k)} / a{k}_{k}) AS {n.format(i)}" for n in names for i in range(p)]
        sql = f"SELECT {keep}, {', '.join(out)} FROM ({sql})"
    return sql


def _sums(p: int, residual: str = "k - n * mu", weight: str = "n * mu * (1 - mu)") -> str:
    grads = [f"sum(({residual}) * x{i}) AS g{i}" for i in range(p)]
    return ", ".join([*grads, *[f"sum({weight} * x{i} * x{j}) AS h{i}_{j}" for i in range(p) for j in range(i, p)]])


def logit(rows: str, xs: Sequence[str], y: str, cluster: str = "message_id", by: str = "1", trials: str = "1.0", more_clusters: Sequence[str] = ()) -> str:
    """The tables of a fit, to be put before a SELECT (``WITH RECURSIVE ...``).

    ``fit``: one row per ``by`` (column grp) with b{i}, and the inverse information v{i}_{j}; ``meat_{name}``: m{i}_{j} and g (clusters)
    by ``cluster`` and ``more_clusters`` (name: expression); ``total``: n.
    """
    p = len(xs)
    rng = range(p)
    eta = " + ".join(f"b{i} * x{i}" for i in rng)
    xl, bl = ", ".join(f"x{i}" for i in rng), ", ".join(f"b{i}" for i in rng)
    clusters = {"meat": cluster, **dict(c.split(":") for c in more_clusters)}
    gl = ", ".join(f"{e} AS c_{n}" for n, e in clusters.items())
    inverse = "SELECT *, " + ", ".join(f"{1 if i == j else 0}::DOUBLE AS e{j}_{i}" for j in rng for i in rng)
    at_end = f"SELECT grp, {bl}, {_sums(p)} FROM (SELECT it.grp, {bl}, {xl}, n, k, 1 / (1 + exp(-({eta}))) AS mu FROM it JOIN cells USING (grp) WHERE step = {STEPS}) GROUP BY grp, {bl}"
    vs = ", ".join(f"e{j}_{i} AS v{i}_{j}" for j in rng for i in rng)
    meats = [
        f"{name} AS (SELECT grp, count(*) AS g, {', '.join(f'sum(u{i} * u{j}) AS m{i}_{j}' for i in rng for j in range(i, p))} FROM (SELECT grp, {', '.join(f'sum(s * x{i}) AS u{i}' for i in rng)} FROM scored GROUP BY grp, c_{name}) GROUP BY grp)"
        for name in clusters
    ]
    return f"""WITH RECURSIVE base AS MATERIALIZED (SELECT {by} AS grp, {gl}, {', '.join(f'({x})::DOUBLE AS x{i}' for i, x in enumerate(xs))}, sum({trials})::DOUBLE AS n, sum(({y})::DOUBLE) AS k FROM {rows} GROUP BY ALL),
        cells AS MATERIALIZED (SELECT grp, {xl}, sum(n) AS n, sum(k) AS k FROM base GROUP BY ALL),
        it AS (SELECT DISTINCT 0 AS step, grp, {', '.join(f'0.0::DOUBLE AS b{i}' for i in rng)} FROM cells UNION ALL
               SELECT step + 1, grp, {', '.join(f'b{i} + g{i} AS b{i}' for i in rng)} FROM ({_eliminated(f'''SELECT step, grp, {bl}, {_sums(p)} FROM (SELECT step, it.grp, {bl}, {xl}, n, k, 1 / (1 + exp(-({eta}))) AS mu FROM it JOIN cells USING (grp) WHERE step < {STEPS}) GROUP BY step, grp, {bl}''', f'step, grp, {bl}', p, ['g'])})),
        fit AS (SELECT grp, {bl}, {vs} FROM ({_eliminated(f'{inverse} FROM ({at_end})', f'grp, {bl}', p, [f'e{j}_' for j in rng])})),
        scored AS (SELECT base.*, k - n / (1 + exp(-({eta}))) AS s FROM base JOIN fit USING (grp)),
        {', '.join(meats)}, total AS (SELECT grp, sum(n) AS n, sum(k) AS k FROM cells GROUP BY grp)"""


def sandwich(i: int, p: int, meat: str = "meat") -> str:
    """Variance of term i by a meat, without any factor."""
    at = lambda r, s: f"{meat}.m{min(r, s)}_{max(r, s)}"
    return "(" + " + ".join(f"fit.v{i}_{r} * {at(r, s)} * fit.v{s}_{i}" for r in range(p) for s in range(p)) + ")"


def tail(z: str) -> str:
    """Two-sided normal tail of z, by Simpson's rule on the density."""
    u = f"least(abs({z}), 9)"
    f = f"exp(-pow(i * {u} / 3000, 2) / 2)"
    return f"greatest(0, 1 - 2 * {u} / 9000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 3001), lambda i: {f} * CASE WHEN i IN (0, 3000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)))"


def table(names: Sequence[str], scale: str = "1") -> str:
    """A fit's rows of terms: beta, clustered error with the small-sample factor, odds ratio and interval, p."""
    p = len(names)
    factor = f"(meat.g / greatest(1, meat.g - 1)) * ((total.n - 1) / greatest(1, total.n - {p}))"
    one = " UNION ALL ".join(f"SELECT fit.grp, '{n}' AS term, b{i} AS beta, sqrt(greatest(0, {factor} * {sandwich(i, p)})) AS se FROM fit JOIN meat USING (grp) JOIN total USING (grp)" for i, n in enumerate(names))
    e = lambda b: f"exp(least(700, ({b}) * {scale}))"
    return f"(SELECT grp, term, beta, se, {e('beta')} AS \"or\", {e(f'beta - {Z} * se')} AS lo, {e(f'beta + {Z} * se')} AS hi, {tail('beta / se')} AS p FROM ({one}))"


def multinomial(rows: str, label: str, classes: Sequence[str], xs: Sequence[str], cluster: str = "message_id") -> str:
    """As :func:`logit`, for classes against the first; term j * p + i is x{i} of class j."""
    p, rest = len(xs), list(classes[1:])
    q = p * len(rest)
    eta = [" + ".join(f"b{j * p + i} * x{i}" for i in range(p)) for j in range(len(rest))]
    bottom = "(1 + " + " + ".join(f"exp({e})" for e in eta) + ")"
    mus = ", ".join(f"exp({e}) / {bottom} AS mu{j}" for j, e in enumerate(eta))
    xl, bl, kl = ", ".join(f"x{i}" for i in range(p)), ", ".join(f"b{i}" for i in range(q)), ", ".join(f"k{j}" for j in range(len(rest)))
    grads = [f"sum((k{j} - n * mu{j}) * x{i}) AS g{j * p + i}" for j in range(len(rest)) for i in range(p)]
    hess = [f"sum(n * mu{a // p} * ({int(a // p == b // p)} - mu{b // p}) * x{a % p} * x{b % p}) AS h{a}_{b}" for a in range(q) for b in range(a, q)]
    sums = ", ".join(grads + hess)
    inverse = "SELECT *, " + ", ".join(f"{int(i == j)}::DOUBLE AS e{j}_{i}" for j in range(q) for i in range(q))
    at_end = f"SELECT grp, {bl}, {sums} FROM (SELECT it.grp, {bl}, {xl}, n, {kl}, {mus} FROM it JOIN cells USING (grp) WHERE step = {STEPS}) GROUP BY grp, {bl}"
    return f"""WITH RECURSIVE base AS MATERIALIZED (SELECT 1 AS grp, {cluster} AS c_meat, {', '.join(f'({x})::DOUBLE AS x{i}' for i, x in enumerate(xs))}, count(*)::DOUBLE AS n, {', '.join(f"sum(({label} = '{c}')::INT)::DOUBLE AS k{j}" for j, c in enumerate(rest))} FROM {rows} GROUP BY ALL),
        cells AS MATERIALIZED (SELECT grp, {xl}, sum(n) AS n, {', '.join(f'sum(k{j}) AS k{j}' for j in range(len(rest)))} FROM base GROUP BY ALL),
        it AS (SELECT DISTINCT 0 AS step, grp, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(q))} FROM cells UNION ALL
               SELECT step + 1, grp, {', '.join(f'b{i} + g{i} AS b{i}' for i in range(q))} FROM ({_eliminated(f'SELECT step, grp, {bl}, {sums} FROM (SELECT step, it.grp, {bl}, {xl}, n, {kl}, {mus} FROM it JOIN cells USING (grp) WHERE step < {STEPS}) GROUP BY step, grp, {bl}', f'step, grp, {bl}', q, ['g'])})),
        fit AS (SELECT grp, {bl}, {', '.join(f'e{j}_{i} AS v{i}_{j}' for j in range(q) for i in range(q))} FROM ({_eliminated(f'{inverse} FROM ({at_end})', f'grp, {bl}', q, [f'e{j}_' for j in range(q)])})),
        scored AS (SELECT * FROM (SELECT base.*, {mus} FROM base JOIN fit USING (grp))),
        meat AS (SELECT grp, count(*) AS g, {', '.join(f'sum(u{a} * u{b}) AS m{a}_{b}' for a in range(q) for b in range(a, q))} FROM (SELECT grp, {', '.join(f'sum((k{a // p} - n * mu{a // p}) * x{a % p}) AS u{a}' for a in range(q))} FROM scored GROUP BY grp, c_meat) GROUP BY grp),
        total AS (SELECT grp, sum(n) AS n FROM cells GROUP BY grp)"""


def conditional(rows: str, stratum: str, critical: str, y: str, by: str = "1") -> str:
    """Conditional logit of one two-armed factor: each stratum's critical successes are noncentral hypergeometric. ``fit``: grp, b, se, used (strata), n."""
    return f"""WITH RECURSIVE counts AS (SELECT {by} AS grp, {stratum} AS s, count({y}) FILTER ({critical} = 1) AS n1, count({y}) FILTER ({critical} = 0) AS n0, count(*) FILTER ({critical} = 1 AND {y}) AS k1, count(*) FILTER ({y} AND {critical} IN (0, 1)) AS m FROM {rows} GROUP BY ALL),
        cells AS MATERIALIZED (SELECT grp, n1, n0, m, sum(k1)::DOUBLE AS k1, count(*)::DOUBLE AS c FROM counts WHERE n1 > 0 AND n0 > 0 AND m > 0 AND m < n1 + n0 GROUP BY ALL),
        ways AS MATERIALIZED (SELECT grp, n1, n0, m, k1, c, unnest(range(greatest(0, m - n0), least(n1, m) + 1)) AS k FROM cells),
        logs AS MATERIALIZED (SELECT *, -lgamma(k + 1) - lgamma(n1 - k + 1) - lgamma(m - k + 1) - lgamma(n0 - m + k + 1) AS w FROM ways),
        it AS (SELECT DISTINCT 0 AS step, grp, 0.0::DOUBLE AS b, 0.0::DOUBLE AS info FROM cells UNION ALL
               SELECT step + 1, grp, b + sum(k1 - c * mean) / sum(c * (square - mean * mean)), sum(c * (square - mean * mean))
               FROM (SELECT step, grp, b, n1, n0, m, k1, c, sum(e * k) / sum(e) AS mean, sum(e * k * k) / sum(e) AS square
                     FROM (SELECT it.step, it.grp, it.b, n1, n0, m, k1, c, k, exp(w - max(w) OVER (PARTITION BY it.grp, n1, n0, m) + k * it.b) AS e FROM it JOIN logs USING (grp) WHERE step < {STEPS})
                     GROUP BY step, grp, b, n1, n0, m, k1, c) GROUP BY step, grp, b),
        fit AS (SELECT grp, CASE WHEN NOT apart THEN b END AS b, CASE WHEN NOT apart THEN 1 / sqrt(info) END AS se, used, n, NOT apart AS converged
                FROM it JOIN (SELECT grp, sum(c)::BIGINT AS used, sum(c * (n1 + n0))::BIGINT AS n, sum(k1) IN (sum(c * greatest(0, m - n0)), sum(c * least(n1, m))) AS apart FROM cells GROUP BY grp) USING (grp) WHERE step = {STEPS})"""


def conditional_table(more: str = "") -> str:
    return f"""SELECT {more} 'critical' AS term, b AS beta, se, exp(b) AS "or", exp(b - {Z} * se) AS lo, exp(b + {Z} * se) AS hi, {tail('b / se')} AS p FROM fit"""
