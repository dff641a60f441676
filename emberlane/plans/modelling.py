"""Queries on fitted models, resampling and matching; SQL only where a closed form exists."""
from __future__ import annotations

from pyspark.sql import functions as F

from emberlane.functions import text as tx
from emberlane.operators import balance, inference, matched, matching
from emberlane.operators import label as lb
from emberlane.operators import sampling as sm
from emberlane.plans import fitted
from emberlane.plans.registry import query
from emberlane.plans.relational import CRIT, _ensemble_sql
from emberlane.schema import CLASSES, CONDITIONS

A, PAIRS, R = "fx_attempts", "fx_pairs", "fx_ratings"


def _covariates():
    return {"realized_cer": F.col("realized_cer"), "replicate_idx": F.col("replicate_idx") / 10.0, "crit": (F.col("corpus") == "CRIT").cast("double")}


@query("categorical_log_odds", A, doubles="cer_target log_odds odds_ratio", sql=f"""
    WITH t AS (SELECT round(cer_target, 1) AS cer_target, ln(count(*) FILTER (label = 'drift') / count(*) FILTER (label <> 'drift')::DOUBLE) AS o FROM {A} GROUP BY 1)
    SELECT t.cer_target, t.o - b.o AS log_odds, exp(t.o - b.o) AS odds_ratio FROM t, (SELECT o FROM t WHERE cer_target = 0) b WHERE t.cer_target <> 0""")
def _(a): return inference.categorical_dose(a)  # noqa: E704


_S = f"(SELECT message_id, model, realized_cer AS x, (label = 'drift')::INT - 1 / (1 + exp(-(-2.0 + 5.0 * realized_cer))) AS s FROM {A})"


@query("one_way_and_two_way_meat", A, doubles="m00 m01 m11", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS clustering, count(*) AS n_clusters, sum(a * a) AS m00, sum(a * b) AS m01, sum(b * b) AS m11 FROM (SELECT sum(s) AS a, sum(s * x) AS b FROM {_S} GROUP BY {k})" for n, k in (("message", "message_id"), ("model", "model"), ("both", "message_id, model"))))
def _(a): return inference.meats_at(a, (-2.0, 5.0))  # noqa: E704


_TERM = 'term, beta, se, "or", lo, hi, p'
_DOUBLES = 'beta se "or" lo hi p'
_ADJUSTED, _XS = ["intercept", "realized_cer", "replicate_idx", "crit"], ["1.0", "realized_cer", "replicate_idx / 10.0", "(corpus = 'CRIT')::INT"]
#: Digits that two independent Newton solves agree in, odds ratios in the thousands included.
FIT = 6


def _dose(x: str) -> str:
    return f"""{fitted.logit(A, ["1.0", x], "label = 'drift'")} SELECT {_TERM}, total.n::BIGINT AS n, meat.g AS n_clusters, true AS converged FROM {fitted.table(["intercept", x], "0.1")} t JOIN total USING (grp) JOIN meat USING (grp)"""


@query("clustered_logit_target", A, doubles=_DOUBLES, digits=FIT, sql=_dose("cer_target"))
def _(a): return inference.dose_model(a)  # noqa: E704


@query("clustered_logit_realised", A, doubles=_DOUBLES, digits=FIT, sql=_dose("realized_cer"))
def _(a): return inference.dose_model(a, "realized_cer")  # noqa: E704


@query("predicted_drift_grid", A, doubles="realized_cer predicted", digits=FIT, sql=fitted.logit(A, ["1.0", "realized_cer"], "label = 'drift'") + " SELECT x AS realized_cer, 1 / (1 + exp(-(b0 + b1 * x))) AS predicted FROM fit, (SELECT unnest([0, 0.1, 0.2, 0.3, 0.4])::DOUBLE AS x)")
def _(a): return inference.predicted_grid(a)  # noqa: E704


_V = [fitted.sandwich(1, 2, m) for m in ("meat", "by_model", "by_both")]


@query("two_way_cluster_slope", A, doubles="beta se_message_id se_model se_twoway lo hi", digits=FIT, sql=fitted.logit(A, ["1.0", "realized_cer"], "label = 'drift'", more_clusters=["by_model:model", "by_both:concat(message_id, '|', model)"]) + f"""
    SELECT *, beta - {fitted.Z} * se_twoway AS lo, beta + {fitted.Z} * se_twoway AS hi FROM (SELECT b1 AS beta, sqrt({_V[0]}) AS se_message_id, sqrt({_V[1]}) AS se_model,
        CASE WHEN {_V[0]} + {_V[1]} - {_V[2]} > 0 THEN sqrt({_V[0]} + {_V[1]} - {_V[2]}) ELSE greatest(sqrt({_V[0]}), sqrt({_V[1]})) END AS se_twoway, NOT {_V[0]} + {_V[1]} - {_V[2]} > 0 AS fallback,
        total.n::BIGINT AS n_obs, meat.g AS n_message_clusters, by_model.g AS n_model_clusters FROM fit JOIN total USING (grp) JOIN meat USING (grp) JOIN by_model USING (grp) JOIN by_both USING (grp))""")
def _(a): return inference.two_way_slope(a)  # noqa: E704


@query("multinomial_logit", A, doubles=_DOUBLES, digits=FIT, sql=f"""{fitted.multinomial(A, "label", CLASSES, _XS)} SELECT {_TERM}, true AS converged FROM {fitted.table([f"{c}:{t}" for c in CLASSES[1:] for t in _ADJUSTED])} t""")
def _(a): return inference.multinomial_model(a, _covariates())  # noqa: E704


@query("binary_contrast_logit", A, doubles=_DOUBLES, digits=FIT, sql=f"""{fitted.logit(f"(SELECT * FROM {A} WHERE label IN ('drift', 'degraded'))", _XS, "label = 'drift'")} SELECT {_TERM} FROM {fitted.table(_ADJUSTED)} t""")
def _(a): return inference.binary_contrast(a, "drift", "degraded", _covariates())  # noqa: E704


@query("adjusted_one_vs_rest", A, doubles=_DOUBLES, digits=FIT, sql=f"""{fitted.logit(f"(SELECT *, unnest({list(CLASSES)!r}) AS class FROM {A})", _XS, "label = class", by="class")} SELECT grp AS class, {_TERM}, 'clustered_logit' AS engine, true AS converged FROM {fitted.table(_ADJUSTED)} t""")
def _(a): return inference.one_versus_rest(a, _covariates())  # noqa: E704


_SHOWN = [c for c, *_ in CONDITIONS if c != "forced"]
_DECLARED = "(SELECT * FROM fx_interface WHERE NOT coalesce(abstained, false))"
_IS = [f"(condition = '{c}')::INT" for c in _SHOWN]


def _interface(kind: str, names: list[str], xs: list[str]) -> str:
    return f"""{fitted.logit(_DECLARED, xs, "label = 'drift'")} SELECT '{kind}' AS model, {_TERM}, true AS converged FROM {fitted.table(names)} t"""


_MAIN = (["intercept", *_SHOWN, "rate"], ["1.0", *_IS, "cer_target"])
_BOTH = ([*_MAIN[0], *[f"{c}:rate" for c in _SHOWN]], [*_MAIN[1], *[f"{c} * cer_target" for c in _IS]])


@query("mixed_one_vs_rest", A)
def _(a):
    """The prespecified covariates; message, model and corpus as crossed random intercepts, family as a fixed effect."""
    family = F.substring("model", 2, 9).cast("int") % 3
    rows = a.withColumn("char_len", (40 + F.col("l_partkey") % 97).cast("double"))
    xs = {
        "realized_cer": F.col("realized_cer"), "n_errors": F.round(F.col("realized_cer") * F.col("char_len")), "char_len": F.col("char_len"),
        "corrupted_negation": F.col("l_orderkey") % 11 == 0, "corrupted_numeral": F.col("l_orderkey") % 7 < 2, "family_1": family == 1, "family_2": family == 2,
    }
    return inference.mixed_one_versus_rest(rows, xs, "message_id", ("model", "corpus"))


@query("interface_condition_model", "fx_interface", doubles=_DOUBLES, digits=FIT, sql=f"SELECT * FROM ({_interface('main', *_MAIN)}) UNION ALL SELECT * FROM ({_interface('interaction', *_BOTH)})")
def _(i): return inference.interface_model(i)  # noqa: E704


_ARMS = "(SELECT a.*, pair_id, critical FROM {a} a JOIN (SELECT crit_message_id AS pair_id, unnest([crit_message_id, message_id]) AS message_id, unnest([1, 0]) AS critical FROM fx_pairs) USING (message_id))"
_KEY = "concat_ws('|', pair_id, cer_target::VARCHAR, replicate_idx, model)"


@query("conditional_logit_pairs", A, PAIRS, doubles=_DOUBLES, digits=FIT, sql=f"""{fitted.conditional(_ARMS.format(a=A), _KEY, "critical", "(label = 'drift')")} {fitted.conditional_table()}""".replace(" FROM fit", ", used AS n_discordant, n AS n_rows, true AS converged FROM fit"))
def _(a, p): return inference.matched_effect(balance.matched_rows(a, p), ["pair_id", "cer_target", "replicate_idx", "model"])  # noqa: E704


@query("conditional_logit_strata", A, PAIRS)
def _(a, p): return inference.matched_effect_strata(balance.matched_rows(a, p), ["pair_id", "cer_target", "replicate_idx"], {"realized_cer": F.col("realized_cer")})  # noqa: E704


_FREE = f"(SELECT * EXCLUDE (v0, v1, v2, v3, nf, nd, nx, most, tied, final, agreement, tie, tied_labels), final AS free, '' AS label FROM ({_ensemble_sql(repr('primary'), 'false')}))"
_LABELLED = f"(SELECT *, (free = 'drift')::INT AS drift_rule_free, (final = 'drift')::INT AS drift_rule_inclusive FROM ({_ensemble_sql(repr('primary'), src=_FREE)}))"
_MATCHED = f"(SELECT a.*, pair_id, critical, ['negation', 'recipient', 'refusal_consent', 'dose', 'grounded'][substr(pair_id, 4)::INT % 5 + 1] AS category FROM {_LABELLED} a JOIN (SELECT crit_message_id AS pair_id, unnest([crit_message_id, message_id]) AS message_id, unnest([1, 0]) AS critical FROM fx_pairs) USING (message_id))"
_CELL = ["pair_id", "cer_target", "replicate_idx", "model"]
_OUTCOMES = ["drift_rule_free", "drift_rule_inclusive"]


def _excess_rows(s, p):
    """Matched attempts with both outcomes and the category of their pair's probe."""
    t = lb.ensemble(lb.ensemble(s.drop("label"), "primary", rule_free=True).withColumnRenamed("label", "_free").drop("agreement", "tie", "tied_labels"), "primary")
    t = t.withColumns({"drift_rule_free": (F.col("_free") == "drift").cast("int"), "drift_rule_inclusive": (F.col("label") == "drift").cast("int")})
    names = F.array(*[F.lit(c) for c in ("negation", "recipient", "refusal_consent", "dose", "grounded")])
    return balance.matched_rows(t, p).withColumn("category", F.element_at(names, F.substring("pair_id", 4, 9).cast("int") % 5 + 1))


def _excess_sql(by: str, name: str) -> str:
    each = [f"SELECT * FROM ({fitted.conditional(_MATCHED, _KEY, 'critical', f'({o} = 1)', by=by)} SELECT grp AS {name}, '{o}' AS outcome, exp(b) AS odds_ratio, exp(b - {fitted.Z} * se) AS lo, exp(b + {fitted.Z} * se) AS hi, used AS n_pairs, n AS n_obs, converged FROM fit)" for o in _OUTCOMES]
    return " UNION ALL ".join(each)


@query("critical_excess_rule_free", "fx_signals", PAIRS, doubles=_DOUBLES, digits=FIT, sql=f"""{fitted.conditional(_MATCHED, _KEY, "critical", "(drift_rule_free = 1)")} {fitted.conditional_table()}""".replace(" FROM fit", ", used AS n_discordant, n AS n_rows, true AS converged FROM fit"))
def _(s, p):
    t = lb.ensemble(s.drop("label"), "primary", rule_free=True)
    return inference.matched_effect(balance.matched_rows(t, p), ["pair_id", "cer_target", "replicate_idx", "model"])


@query("critical_excess_pooled", "fx_signals", PAIRS, doubles="odds_ratio lo hi", digits=FIT, sql=f"SELECT * EXCLUDE (scope) FROM ({_excess_sql('1', 'scope')})")
def _(s, p): return matched.excess(_excess_rows(s, p), _CELL, _OUTCOMES)  # noqa: E704


@query("critical_excess_by_model", "fx_signals", PAIRS, doubles="odds_ratio lo hi", digits=FIT, sql=_excess_sql("model", "model"))
def _(s, p): return matched.excess(_excess_rows(s, p), _CELL[:3], _OUTCOMES, "model")  # noqa: E704


@query("critical_excess_by_category", "fx_signals", PAIRS, doubles="odds_ratio lo hi", digits=FIT, sql=_excess_sql("category", "category"))
def _(s, p): return matched.excess(_excess_rows(s, p), _CELL, _OUTCOMES, "category")  # noqa: E704


_POINTS = "count(*) FILTER (critical = 1) AS n_crit, count(*) FILTER (critical = 0) AS n_ctrl, count(DISTINCT message_id) FILTER (critical = 1) AS n_crit_items, avg(drift_rule_free) FILTER (critical = 1) AS p_crit, avg(drift_rule_free) FILTER (critical = 0) AS p_ctrl"


@query("critical_excess_points_by_category", "fx_signals", PAIRS, doubles="p_crit p_ctrl rd_pp", sql=f"SELECT *, 100 * (p_crit - p_ctrl) AS rd_pp FROM (SELECT category, {_POINTS} FROM {_MATCHED} GROUP BY category)")
def _(s, p): return matched.excess_points(_excess_rows(s, p), "drift_rule_free", "category")  # noqa: E704


_ANCHOR, _PRIOR = [f"m{i}" for i in range(7)], 1.1


@query("critical_excess_anchor", "fx_signals", PAIRS, doubles="odds_ratio lo hi prior", digits=FIT, sql=f"""
    {fitted.conditional(f"(SELECT * FROM {_MATCHED} WHERE model IN ({', '.join(map(repr, _ANCHOR))}))", _KEY, "critical", "(drift_rule_free = 1)")}
    SELECT exp(b) AS odds_ratio, exp(b - {fitted.Z} * se) AS lo, exp(b + {fitted.Z} * se) AS hi, used AS n_pairs, n AS n_obs, {_PRIOR}::DOUBLE AS prior, abs(exp(b) - {_PRIOR}) < 0.05 AS reproduces FROM fit""")
def _(s, p): return matched.anchor(_excess_rows(s, p), _CELL, "drift_rule_free", _ANCHOR, _PRIOR)  # noqa: E704


@query("matched_adjusted_logit", "fx_matched", digits=FIT)
def _(m): return matched.adjusted_effect(m, _CELL)  # noqa: E704


@query("matched_adjusted_logit_by_model", "fx_matched", digits=FIT)
def _(m): return matched.adjusted_effect(m, _CELL[:3], by="model")  # noqa: E704


@query("bootstrap_risk_difference_by_rate", "fx_matched")
def _(m): return matched.risk_difference_by_rate(m)  # noqa: E704


_SLOPES = fitted.logit(A, ["1.0", "realized_cer"], "label = 'drift'", by="model") + f", slopes AS (SELECT grp AS model, beta AS slope, se, total.n::BIGINT AS n FROM {fitted.table(['intercept', 'slope'])} t JOIN total USING (grp) WHERE term = 'slope')"


@query("per_model_slopes", A, doubles="slope se", digits=FIT, sql=f"{_SLOPES} SELECT model, slope, se, true AS converged, n FROM slopes")
def _(a): return inference.model_slopes(a)  # noqa: E704


_POOL = f"""{_SLOPES},
    t AS (SELECT slope AS y, greatest(pow((2 * 1.96 * se) / (2 * 1.96), 2), 1e-12) AS v FROM slopes), a AS (SELECT count(*) AS k, sum(1 / v) AS sw, sum(1 / v / v) AS sw2, sum(y / v) AS swy FROM t),
    q AS (SELECT k, sw, sw2, sum(pow(y - swy / sw, 2) / v) AS q FROM t, a GROUP BY ALL), u AS (SELECT k, q, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM q),
    r AS (SELECT k, q, tau2, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS pooled, 1 / sqrt(sum(1 / (v + tau2))) AS se FROM t, u GROUP BY ALL)
    SELECT k, pooled, se, pooled - 1.96 * se AS lo, pooled + 1.96 * se AS hi, tau2, q, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) * 100 ELSE 0 END AS i2 FROM r"""
#: k, pooled and se of the pooled slope.
POOLED = _POOL.replace("SELECT k, pooled, se, pooled - 1.96 * se AS lo, pooled + 1.96 * se AS hi, tau2, q, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) * 100 ELSE 0 END AS i2 FROM r", "SELECT k, pooled, se FROM r")


@query("pooled_model_slope", A, doubles="pooled se lo hi tau2 q i2", digits=FIT, sql=_POOL)
def _(a): return inference.pooled_slope(a)  # noqa: E704


@query("message_aggregated_glm", A, doubles=_DOUBLES, digits=FIT, sql=f"""{fitted.logit(f"(SELECT message_id, count(*) AS trials, count(*) FILTER (label = 'drift') AS k, avg(realized_cer) AS mean_rate FROM {A} GROUP BY message_id)", ["1.0", "mean_rate"], "k", trials="trials")} SELECT {_TERM} FROM {fitted.table(["intercept", "mean_rate"])} t""")
def _(a): return inference.aggregated_model(a)  # noqa: E704


@query("bootstrap_slope_by_message", A)
def _(a): return inference.slope_bootstrap(a)  # noqa: E704


@query("bootstrap_slope_by_model", A)
def _(a): return inference.slope_bootstrap(a, "model")  # noqa: E704


@query("bootstrap_risk_difference", A, PAIRS)
def _(a, p): return inference.risk_difference_bootstrap(balance.arm_sums(balance.matched_rows(a, p)))  # noqa: E704


@query("bootstrap_ece_auroc", A)
def _(a): return inference.ece_auroc_bootstrap(a)  # noqa: E704


def _cohorts(r):
    t = r.withColumns({"human": lb.human_label(F.col("rating_a"))[0], "auto": F.col("auto_label"), "message_id": F.substring("item_id", 4, 4)})
    return t, t


@query("bootstrap_prevalence_cluster", R)
def _(r): return inference.prevalence_bootstrap(*_cohorts(r))  # noqa: E704


@query("bootstrap_prevalence_parametric", R)
def _(r): return inference.prevalence_bootstrap(*_cohorts(r), method="parametric")  # noqa: E704


@query("bootstrap_model_slopes", A)
def _(a): return inference.slopes_bootstrap(inference.model_slopes(a))  # noqa: E704


@query("bootstrap_rate", A)
def _(a): return inference.rate_bootstrap(a)  # noqa: E704


@query("bootstrap_paired_difference", A)
def _(a): return inference.paired_rate_bootstrap(a, "corpus", "CRIT", "CTRL")  # noqa: E704


@query("bootstrap_curve_slopes", A)
def _(a): return inference.curve_bootstrap(a)  # noqa: E704


_MATCH = ["char_len", "word_count", "has_numeral", "has_negation"]
_TOK = "regexp_extract_all(p_name, '[A-Za-z0-9]+(?:''[A-Za-z]+)?')"
_NEGATED = f"lower(t) IN ({', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in tx.NEGATIONS)}) OR contains(lower(t), 'n''t')"


@query("greedy_match", "part", doubles=f"{' '.join(_MATCH)} {' '.join('crit_' + f for f in _MATCH)} match_distance", sql=f"""
    WITH RECURSIVE f AS (SELECT p_partkey, 'p' || p_partkey::VARCHAR AS id, length(p_name)::DOUBLE AS char_len, len({_TOK})::DOUBLE AS word_count,
                                (len(list_filter({_TOK}, lambda t: regexp_matches(t, '[0-9]'))) > 0)::INT::DOUBLE AS has_numeral,
                                (len(list_filter({_TOK}, lambda t: {_NEGATED})) > 0)::INT::DOUBLE AS has_negation FROM part),
    m AS (SELECT {", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END AS s_{f}" for f in _MATCH)} FROM f),
    z AS (SELECT f.*, [{", ".join(f"({f} - m_{f}) / s_{f}" for f in _MATCH)}] AS z, sha256('7|' || id) AS tie FROM f, m),
    c AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM z WHERE p_partkey % 20 = 0),
    d AS MATERIALIZED (SELECT r, o.id, round(list_sum(list_transform(list_zip(c.z, o.z), lambda q: (q[1] - q[2]) ** 2)), 9) AS d, o.tie FROM c, z o WHERE o.p_partkey % 20 > 0),
    g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS used, ''::VARCHAR AS id
          UNION ALL SELECT x.r, list_append(x.used, x.id), x.id FROM (
              SELECT d.r, any_value(g.used) AS used, arg_min(d.id, {{'d': d.d, 'tie': d.tie}}) AS id FROM g JOIN d ON d.r = g.r + 1 WHERE NOT list_contains(g.used, d.id) GROUP BY d.r) x)
    SELECT c.id AS crit_message_id, {", ".join(f"c.{f} AS crit_{f}" for f in _MATCH)}, o.id AS message_id, {", ".join(f"o.{f}" for f in _MATCH)}, sqrt(d.d) AS match_distance
    FROM g JOIN c USING (r) JOIN z o ON o.id = g.id JOIN d ON d.r = g.r AND d.id = g.id""")
def _(p):
    t = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("message_id"), F.col("p_name").alias("text"), "p_partkey")
    feats = tx.message_features(F.col("text"))
    t = t.select("message_id", "p_partkey", *[c.cast("double").alias(k) for k, c in feats.items()])
    return matching.greedy_controls(t.where("p_partkey % 20 = 0"), t.where("p_partkey % 20 > 0"), list(feats), 7, ["p_partkey"])


@query("power_simulation", A)
def _(a):
    """Power of a design of 30 messages and 3 replicates for the slope and intercept that the attempts show."""
    fit = {r["term"]: r["beta"] for r in inference.dose_model(a).collect()}
    return inference.power(30, 3, fit["cer_target"], fit["intercept"], 0.5, 200, 1, a.sparkSession)


@query("stability_verdict", A)
def _(a):
    dose = {r["term"]: r for r in inference.dose_model(a, "realized_cer").collect()}["realized_cer"]
    gee, pool, boot = inference.gee_slope(a).first(), inference.pooled_slope(a).first(), inference.slope_bootstrap(a).first()
    verdict = inference.stability(dose["beta"], [("gee", gee["slope"], gee["lo"], gee["hi"]), ("pooled", pool["pooled"], pool["lo"], pool["hi"]), ("bootstrap", boot["point"], boot["lo"], boot["hi"])])
    return inference._frame(a, [verdict])


@query("generic_bootstrap", A)
def _(a): return inference.resample(a, {"n": F.lit(1.0), "x": F.col("realized_cer")}, lambda s: s["x"] / s["n"])  # noqa: E704
