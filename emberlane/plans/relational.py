"""Queries on rates, labels, transitions, agreement, calibration, balance and sampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from emberlane import contracts as ct
from emberlane.operators import agreement as ag
from emberlane.operators import audit, balance, rates, transitions
from emberlane.operators import calibration as cal
from emberlane.operators import label as lb
from emberlane.operators import ranking as rk
from emberlane.operators import sampling as sm
from emberlane.plans.registry import query

A = "fx_attempts"
D = "CASE WHEN label = 'drift' THEN 1.0::DOUBLE ELSE 0 END"
LV = "round(cer_target, 1)"
HI = "(confidence >= 90)"
CRIT = "(crit_negation_flip OR crit_numeral_change OR crit_recipient_change OR crit_urgency_change OR crit_actionable_omission)"


@query("drift_rate_by_corpus_level", A, doubles="cer_target drift_rate", sql=f"SELECT corpus, {LV} AS cer_target, count(*) AS n, count(*) FILTER (label = 'drift') AS n_drift, avg({D}) AS drift_rate FROM {A} GROUP BY ALL")
def _(a): return rates.drift_rate(a, "corpus", "cer_target")  # noqa: E704


@query("drift_curve_overall", A, doubles="cer_target drift_rate", sql=f"SELECT {LV} AS cer_target, count(*) AS n, count(*) FILTER (label = 'drift') AS n_drift, avg({D}) AS drift_rate FROM {A} GROUP BY ALL")
def _(a): return rates.drift_rate(a, "cer_target")  # noqa: E704


@query("critical_threshold", A, doubles="critical_level", sql=f"SELECT min(l) AS critical_level FROM (SELECT {LV} AS l FROM {A} WHERE corpus = 'CRIT' GROUP BY 1 HAVING avg({D}) > 0.01)")
def _(a): return rates.critical_level(a)  # noqa: E704


_MIX = ", ".join(f"avg(CASE WHEN label = '{c}' THEN 1.0::DOUBLE ELSE 0 END) AS share_{c}" for c in ("faithful", "degraded", "drift"))


@query("label_mix_grouping_sets", A, doubles="share_faithful share_degraded share_drift", sql=f"""
    SELECT CASE WHEN grouping(corpus) = 1 AND grouping(model) = 1 THEN 'overall' WHEN grouping(corpus) = 0 THEN 'corpus' ELSE 'model' END AS scope,
           coalesce(corpus, model, 'all') AS value, count(*) AS n, {_MIX} FROM {A} GROUP BY GROUPING SETS ((), (corpus), (model))""")
def _(a): return rates.label_mix(a)  # noqa: E704


@query("generation_vs_model_weighted", A, doubles="generation_weighted model_weighted", sql=f"""
    SELECT corpus, 100 * sum(k) / sum(n) AS generation_weighted, 100 * avg(k / n) AS model_weighted, count(*) AS n_models
    FROM (SELECT corpus, model, count(*)::DOUBLE AS n, sum({D}) AS k FROM {A} GROUP BY ALL) GROUP BY corpus""")
def _(a): return rates.weighting_sensitivity(a)  # noqa: E704


@query("confidently_wrong", A, doubles="frac_drift_at_high_confidence confidently_wrong_rate", sql=f"""
    WITH t AS (SELECT coalesce(model, 'pooled') AS model, count(*) AS n, count(*) FILTER (label = 'drift') AS n_drift, count(*) FILTER (label = 'drift' AND {HI}) AS n_drift_high,
                      count(*) FILTER ({HI}) AS n_high, count(*) FILTER ({HI} AND label <> 'faithful') AS n_high_not_faithful
               FROM {A} WHERE confidence IS NOT NULL GROUP BY GROUPING SETS ((), (model)))
    SELECT *, n_drift_high::DOUBLE / nullif(n_drift, 0) AS frac_drift_at_high_confidence, n_high_not_faithful::DOUBLE / nullif(n_high, 0) AS confidently_wrong_rate FROM t""")
def _(a): return rates.confidently_wrong(a)  # noqa: E704


@query("missing_confidence_grid", A, doubles="cer_target", sql=f"""
    WITH t AS (SELECT model, {LV} AS cer_target, count(*) AS n, count(*) FILTER (confidence IS NULL) AS n_missing FROM {A} GROUP BY ALL)
    SELECT m.model, c.cer_target, coalesce(n, 0) AS n, coalesce(n_missing, 0) AS n_missing
    FROM (SELECT DISTINCT model FROM t) m CROSS JOIN (SELECT DISTINCT cer_target FROM t) c LEFT JOIN t ON t.model = m.model AND t.cer_target = c.cer_target""")
def _(a): return rates.missing_confidence_grid(a)  # noqa: E704


@query("missingness_enrichment", A, doubles="baseline drift_among_missing enrichment", sql=f"""
    WITH t AS (SELECT coalesce(model, 'pooled') AS model, count(*) AS n, count(*) FILTER (confidence IS NULL) AS n_missing, avg({D}) AS baseline,
                      avg({D}) FILTER (confidence IS NULL) AS drift_among_missing FROM {A} GROUP BY GROUPING SETS ((), (model)))
    SELECT *, drift_among_missing / nullif(baseline, 0) AS enrichment FROM t""")
def _(a): return rates.missingness_enrichment(a)  # noqa: E704


@query("corpus_overlap", A, sql=f"""
    WITH u AS (SELECT message_id, corpus FROM {A} UNION SELECT message_id, 'AUTH' FROM {A} WHERE corpus = 'CTRL'),
         f AS (SELECT message_id, bool_or(corpus = 'AUTH') AS a, bool_or(corpus = 'CRIT') AS r, bool_or(corpus = 'CTRL') AS t FROM u GROUP BY 1)
    SELECT count(*) AS n_distinct, count(*) FILTER (a) AS n_auth, count(*) FILTER (r) AS n_crit, count(*) FILTER (t) AS n_ctrl, count(*) FILTER (a AND r) AS auth_crit,
           count(*) FILTER (a AND t) AS auth_ctrl, count(*) FILTER (r AND t) AS crit_ctrl, count(*) FILTER (t AND NOT a) = 0 AS ctrl_in_auth, count(*) FILTER (r AND NOT a) = 0 AS crit_in_auth FROM f""")
def _(a):
    twin = a.where("corpus = 'CTRL'").withColumn("corpus", F.lit("AUTH"))
    return rates.corpus_overlap(a.unionByName(twin))


@query("panel_coverage", A, sql=f"""
    WITH t AS (SELECT count(DISTINCT model) AS n_model, count(DISTINCT corpus) AS n_corpus, count(DISTINCT {LV}) AS n_cer_target, count(DISTINCT label) AS n_label,
                      count(DISTINCT (model, corpus, {LV}, label)) AS nonempty FROM {A}) SELECT *, (n_model * n_corpus * n_cer_target * n_label)::BIGINT AS possible FROM t""")
def _(a): return rates.panel_coverage(a)  # noqa: E704


@query("realised_rate_summary", A, doubles="cer_target", sql=f"SELECT {LV} AS cer_target, round(avg(realized_cer), 4) AS mean, round(stddev_samp(realized_cer), 4) AS sd, count(*) AS n FROM {A} GROUP BY 1")
def _(a): return rates.realised_rates(a)  # noqa: E704


@query("dedup_row_distribution", A, sql=f"SELECT rows, count(*) AS n_messages FROM (SELECT count(*) AS rows FROM {A} WHERE corpus <> 'CTRL' GROUP BY message_id) GROUP BY 1")
def _(a): return rates.rows_per_message(a)  # noqa: E704


@query("message_aggregate_counts", A, doubles="mean_rate", sql=f"SELECT message_id, count(*) AS n, count(*) FILTER (label = 'drift') AS k, avg(realized_cer) AS mean_rate FROM {A} GROUP BY 1")
def _(a): return rates.message_counts(a)  # noqa: E704


@query("wilson_by_cell", A, doubles="cer_target percent lo hi", sql=f"""
    WITH t AS (SELECT corpus, {LV} AS cer_target, count(*)::DOUBLE AS n, avg({D}) AS p FROM {A} GROUP BY ALL), c AS (SELECT 1.959963984540054::DOUBLE AS z)
    SELECT corpus, cer_target, n::BIGINT AS n, 100 * p AS percent, 100 * ((p + z * z / 2 / n) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)) AS lo,
           100 * ((p + z * z / 2 / n) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)) AS hi FROM t, c""")
def _(a): return rates.wilson_by_cell(a)  # noqa: E704


@query("ols_slope_pp", A, doubles="slope_pp", sql=f"SELECT model, 10 * regr_slope(100 * r, 100 * x) AS slope_pp, count(*) AS n_levels FROM (SELECT model, {LV} AS x, avg({D}) AS r FROM {A} GROUP BY ALL) GROUP BY 1")
def _(a): return rates.curve_slopes(a)  # noqa: E704


@query("slope_summary", A, doubles="min median max", sql=f"""
    SELECT min(s) AS min, quantile_cont(s, 0.5) AS median, max(s) AS max, count(s) AS k
    FROM (SELECT 10 * regr_slope(100 * r, 100 * x) AS s FROM (SELECT model, {LV} AS x, avg({D}) AS r FROM {A} GROUP BY ALL) GROUP BY model)""")
def _(a): return rates.slope_summary(rates.curve_slopes(a))  # noqa: E704


_I = "fx_interface"
_DEC = "coalesce(abstained, false)"


@query("interface_rates", _I, doubles="declined_rate faithful_rate degraded_rate drift_rate", sql=f"""
    WITH t AS (SELECT condition, coalesce(corpus, 'all') AS corpus, count(*) AS n, count(*) FILTER ({_DEC}) AS n_declined,
                      {', '.join(f"count(*) FILTER (NOT {_DEC} AND label = '{c}')::DOUBLE AS k_{c}" for c in ('faithful', 'degraded', 'drift'))}
               FROM {_I} GROUP BY GROUPING SETS ((condition), (condition, corpus)))
    SELECT condition, corpus, n, n_declined, n_declined::DOUBLE / n AS declined_rate, {', '.join(f'k_{c} / nullif(n - n_declined, 0) AS {c}_rate' for c in ('faithful', 'degraded', 'drift'))} FROM t""")
def _(i): return rates.interface_rates(i)  # noqa: E704


@query("interface_throughput_by_level", _I, doubles="cer_target faithful_throughput", sql=f"SELECT condition, {LV} AS cer_target, count(*) AS n, avg(CASE WHEN NOT {_DEC} AND label = 'faithful' THEN 1.0::DOUBLE ELSE 0 END) AS faithful_throughput FROM {_I} GROUP BY ALL")
def _(i): return rates.throughput(i)  # noqa: E704


@query("candidate_recovery", _I, doubles="primary_rate any_rate lift", sql=f"""
    WITH t AS (SELECT coalesce({LV}::VARCHAR, 'all') AS scope, count(*) AS n, avg((label = 'faithful')::INT::DOUBLE) AS primary_rate, avg((label = 'faithful' OR coalesce(any_candidate_faithful, false))::INT::DOUBLE) AS any_rate
               FROM {_I} WHERE condition = 'candidate_list' GROUP BY GROUPING SETS ((), ({LV}))) SELECT *, any_rate - primary_rate AS lift FROM t""")
def _(i): return rates.candidate_recovery(i)  # noqa: E704


_TR = """CASE WHEN raw_label = 'faithful' AND label = 'faithful' THEN 'no_benefit' WHEN raw_label = 'degraded' AND label = 'faithful' THEN 'rescue' WHEN raw_label = 'degraded' AND label = 'drift' THEN 'silent_failure'
    WHEN raw_label = 'faithful' AND label = 'drift' THEN 'llm_induced_harm' WHEN raw_label = 'degraded' AND label = 'degraded' THEN 'no_correction' ELSE 'other__' || raw_label || '_to_' || label END"""
_KEY = "(message_id, corpus, cer_target, replicate_idx)"
_CELLS = ("no_benefit", "rescue", "silent_failure", "llm_induced_harm", "no_correction")
_NET = "CASE WHEN llm_induced_harm + silent_failure > 0 THEN rescue::DOUBLE / (llm_induced_harm + silent_failure) WHEN rescue > 0 THEN 'infinity'::DOUBLE END AS faithful_gained_per_drift_introduced"


@query("transition_matrix", A, "fx_raw", doubles="share", sql=f"""
    WITH t AS (SELECT corpus, {_TR} AS transition, count(*) AS n FROM {A} JOIN fx_raw USING {_KEY} GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY corpus) AS share FROM t""")
def _(a, r): return transitions.transition_counts(a, r, "corpus")  # noqa: E704


@query("transition_overall", A, "fx_raw", doubles="share", sql=f"WITH t AS (SELECT {_TR} AS transition, count(*) AS n FROM {A} JOIN fx_raw USING {_KEY} GROUP BY ALL) SELECT *, n / sum(n) OVER () AS share FROM t")
def _(a, r): return transitions.transition_counts(a, r)  # noqa: E704


_NETSQL = "SELECT {by} count(raw_label) AS n_matched, count(*) FILTER (raw_label IS NULL) AS n_unmatched, " + ", ".join(f"count(*) FILTER (t = '{c}') AS {c}" for c in _CELLS) + " FROM (SELECT *, {tr} AS t FROM {src} LEFT JOIN fx_raw USING {key}) GROUP BY ALL"


@query("net_metric_by_corpus_level", A, "fx_raw", doubles="cer_target faithful_gained_per_drift_introduced", sql="SELECT *, " + _NET + " FROM (" + _NETSQL.format(by="corpus, round(cer_target, 1) AS cer_target,", tr=_TR, src=A, key=_KEY) + ")")
def _(a, r): return transitions.net_by(a, r, "corpus", "cer_target")  # noqa: E704


@query("net_metric_ranking", _I, "fx_raw", doubles="faithful_gained_per_drift_introduced", sql=f"""
    WITH t AS (SELECT *, {_NET} FROM ({_NETSQL.format(by='condition,', tr=_TR, src=f'(SELECT * FROM {_I} WHERE NOT {_DEC})', key=_KEY)})),
         d AS (SELECT condition, count(*) FILTER ({_DEC}) AS n_declined FROM {_I} GROUP BY 1)
    SELECT row_number() OVER (ORDER BY faithful_gained_per_drift_introduced DESC NULLS LAST, condition) AS rank, condition, n_matched, n_declined, rescue, llm_induced_harm, silent_failure, faithful_gained_per_drift_introduced
    FROM t JOIN d USING (condition)""")
def _(i, r): return transitions.net_ranking(i, r)  # noqa: E704


@query("benefit_harm_by_condition", _I, "fx_raw", doubles="cer_target faithful_gained_per_drift_introduced", sql=f"""
    SELECT *, {_NET} FROM ({_NETSQL.format(by='condition, corpus, round(cer_target, 1) AS cer_target,', tr=_TR, src=f'(SELECT * FROM {_I} WHERE NOT {_DEC})', key=_KEY)}
    UNION ALL BY NAME SELECT *, 'all' AS corpus, NULL::DOUBLE AS cer_target FROM ({_NETSQL.format(by='condition,', tr=_TR, src=f'(SELECT * FROM {_I} WHERE NOT {_DEC})', key=_KEY)}))""")
def _(i, r): return transitions.benefit_harm_by_condition(i, r)  # noqa: E704


def _vote_sql(nli: str, emb: str, crit: str = CRIT, tau: str = "0.5") -> str:
    f, b = f"nli_{nli}_fwd", f"nli_{nli}_bwd"
    return f"""CASE WHEN fluency_raw < {tau} THEN 'degraded' WHEN {f} = 'contradict' OR {b} = 'contradict' OR {crit} THEN 'drift'
        WHEN {f} = 'entail' AND {b} = 'entail' THEN 'faithful' WHEN cos_{emb} < 0.75 THEN 'drift' ELSE 'faithful' END"""


def _ensemble_sql(policy: str, crit: str = CRIT, tau: str = "0.5", src: str = "fx_signals", more: str = "") -> str:
    votes = ", ".join(f"{_vote_sql(a, b, crit, tau)} AS v{i}" for i, (a, b) in enumerate(lb.EVALUATORS))
    n = lambda c: "(" + " + ".join(f"(v{i} = '{c}')::INT" for i in range(4)) + ")"
    first = "CASE " + " ".join(f"WHEN list_contains(tied, v{i}) THEN v{i}" for i in range(4)) + " END"
    mild = "CASE WHEN list_contains(tied, 'faithful') THEN 'faithful' WHEN list_contains(tied, 'degraded') THEN 'degraded' ELSE 'drift' END"
    severe = "CASE WHEN list_contains(tied, 'drift') THEN 'drift' WHEN list_contains(tied, 'degraded') THEN 'degraded' ELSE 'faithful' END"
    return f"""SELECT *, CASE WHEN {policy} = 'primary' THEN {first} WHEN {policy} = 'drift_averse' THEN {mild} ELSE {severe} END AS final, most / 4.0::DOUBLE AS agreement, len(tied) > 1 AS tie, array_to_string(tied, '|') AS tied_labels
        FROM (SELECT *, list_filter(['degraded', 'drift', 'faithful'], lambda c: CASE c WHEN 'faithful' THEN nf WHEN 'degraded' THEN nd ELSE nx END = most) AS tied
              FROM (SELECT *, greatest(nf, nd, nx) AS most FROM (SELECT *, {n('faithful')} AS nf, {n('degraded')} AS nd, {n('drift')} AS nx FROM (SELECT * EXCLUDE (label), {votes} FROM {src} {more}))))"""


S = "fx_signals"


@query("label_v1", S, sql=f"""
    SELECT CASE WHEN nli_deberta_fwd = 'contradict' OR nli_deberta_bwd = 'contradict' THEN 'drift' WHEN nli_deberta_fwd = 'entail' AND nli_deberta_bwd = 'entail' THEN 'faithful' WHEN cos_mpnet >= 0.75 THEN 'faithful' ELSE 'degraded' END AS v1, corpus, count(*) AS n FROM {S} GROUP BY ALL""")
def _(s):
    v = lb.ordinal_label(F.col("nli_deberta_fwd"), F.col("nli_deberta_bwd"), F.col("cos_mpnet"))
    return s.groupBy(v.alias("v1"), "corpus").agg(F.count(F.lit(1)).alias("n"))


_FIRED = "concat_ws('+', " + ", ".join(f"CASE WHEN crit_{c} THEN '{c}' END" for c in ("negation_flip", "numeral_change", "recipient_change", "urgency_change", "actionable_omission")) + ")"


@query("label_v2_reason", S, sql=f"""
    SELECT {_vote_sql('deberta', 'mpnet')} AS v2, CASE WHEN nli_deberta_fwd = 'contradict' OR nli_deberta_bwd = 'contradict' THEN 'nli_contradiction' WHEN {_FIRED} <> '' THEN 'critical_rule:' || {_FIRED}
        WHEN nli_deberta_fwd = 'entail' AND nli_deberta_bwd = 'entail' THEN 'nli_bidirectional_entailment' WHEN cos_mpnet < 0.75 THEN 'cosine_below_threshold' ELSE 'cosine_at_or_above_threshold' END AS reason, count(*) AS n FROM {S} GROUP BY ALL""")
def _(s):
    f, b, c = F.col("nli_deberta_fwd"), F.col("nli_deberta_bwd"), F.col("cos_mpnet")
    return s.groupBy(lb.vote("deberta", "mpnet").alias("v2"), lb.label_reason(f, b, c).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _by_vote(t):
    return t.groupBy("label", "agreement", "tie", "tied_labels").agg(F.count(F.lit(1)).alias("n"))


for _p in lb.POLICIES:
    query(f"ensemble_vote_{_p}", S, doubles="agreement", sql=f"SELECT final AS label, agreement, tie, tied_labels, count(*) AS n FROM ({_ensemble_sql(repr(_p))}) GROUP BY ALL")(lambda s, p=_p: _by_vote(lb.ensemble(s, p)))


@query("rule_free_relabel", S, doubles="agreement", sql=f"SELECT final AS label, agreement, tie, tied_labels, count(*) AS n FROM ({_ensemble_sql(repr('primary'), 'false')}) GROUP BY ALL")
def _(s): return _by_vote(lb.ensemble(s, "primary", rule_free=True))  # noqa: E704


@query("tau_policy_sweep", S, doubles="tau", sql=f"""
    SELECT tau, policy, final AS label, count(*) AS n FROM ({_ensemble_sql('policy', tau='tau', more="CROSS JOIN (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS tau) CROSS JOIN (SELECT unnest(['primary', 'drift_averse', 'severity']) AS policy)")}) GROUP BY ALL""")
def _(s): return lb.sweep(s)  # noqa: E704


@query("critical_flag_masks", S, sql=f"SELECT {CRIT} AS any_critical, crit_numeral_change AND NOT (crit_negation_flip OR crit_recipient_change OR crit_urgency_change OR crit_actionable_omission) AS only_numeral, count(*) AS n FROM {S} GROUP BY ALL")
def _(s): return s.groupBy(lb.any_critical().alias("any_critical"), lb.only_critical("crit_numeral_change").alias("only_numeral")).agg(F.count(F.lit(1)).alias("n"))  # noqa: E704


_LOW = "(cos_mpnet < 0.75 OR cos_minilm < 0.75)"
_BD, _BR = ("(nli_deberta_fwd = 'entail' AND nli_deberta_bwd = 'entail')", "(nli_roberta_fwd = 'entail' AND nli_roberta_bwd = 'entail')")
_INT, _OUT = "concat('Message ', cast(l_partkey % 7 AS varchar), '.')", "concat('message ', cast(l_orderkey % 7 AS varchar), CASE WHEN l_suppkey % 3 = 0 THEN ' and some more words' ELSE '' END)"
_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g'))"
_ZERO = f"""(SELECT *, CASE WHEN {CRIT} THEN 'critical_substitution' WHEN {_NORM.format('i')} = {_NORM.format('o')} THEN 'formatting' WHEN NOT {_LOW} AND ({_BD} OR {_BR}) THEN 'paraphrase'
    WHEN length(o) >= 1.5 * length(i) THEN 'overgenerative' ELSE 'other' END AS cause FROM (SELECT *, {_INT} AS i, {_OUT} AS o FROM {S} WHERE realized_cer = 0 AND label = 'drift'))"""


def _zero(s):
    i = F.concat(F.lit("Message "), (F.col("l_partkey") % 7).cast("string"), F.lit("."))
    o = F.concat(F.lit("message "), (F.col("l_orderkey") % 7).cast("string"), F.when(F.col("l_suppkey") % 3 == 0, " and some more words").otherwise(""))
    return audit.zero_error_drift(s, lb.zero_error_cause(i, o))


@query("zero_cer_causes", S, sql=f"""
    SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(corpus) = 0 THEN 'corpus' ELSE 'overall' END AS scope, coalesce(model, corpus, 'all') AS value, CASE cause WHEN 'other' THEN 'unresolved_or_mixed' ELSE cause END AS cause, count(*) AS n
    FROM {_ZERO} GROUP BY GROUPING SETS ((cause), (cause, model), (cause, corpus))""")
def _(s): return audit.cause_counts(_zero(s))  # noqa: E704


@query("zero_cer_examples", S, sql=f"""
    SELECT cause, place, message_id FROM (SELECT cause, message_id, row_number() OVER (PARTITION BY cause ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, message_id) AS place FROM {_ZERO}) WHERE place <= 10""")
def _(s): return audit.cause_examples(_zero(s), ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "message_id"))  # noqa: E704


@query("unresolved_split", S, sql=f"""
    SELECT CASE WHEN 'contradict' IN (nli_deberta_fwd, nli_deberta_bwd, nli_roberta_fwd, nli_roberta_bwd) THEN 'nli_contradiction_driven' WHEN {_LOW} THEN 'cosine_driven_low_similarity' ELSE 'entailment_gate_failed_high_cosine' END AS reason,
           count(*) AS n, count(*) FILTER (cos_mpnet BETWEEN 0.75 - 0.05 AND 0.75 + 0.05 OR cos_minilm BETWEEN 0.75 - 0.05 AND 0.75 + 0.05) AS n_borderline, count(*) FILTER ({_LOW}) AS n_low_cosine, count(*) FILTER ({_BD}) AS n_deberta_entails
    FROM {_ZERO} WHERE cause = 'other' GROUP BY 1""")
def _(s): return audit.unresolved(_zero(s))  # noqa: E704


@query("zero_cer_scope_split", S, doubles="share_target_zero", sql=f"SELECT count(*) AS n, count(*) FILTER (cer_target = 0) AS n_target_zero, count(*) FILTER (cer_target = 0)::DOUBLE / count(*) AS share_target_zero FROM {_ZERO}")
def _(s): return audit.scope_split(_zero(s))  # noqa: E704


R = "fx_ratings"
_MAP = "CASE lower(trim({0})) WHEN 'faithful' THEN 'faithful' WHEN 'degraded' THEN 'degraded' WHEN 'drift' THEN 'drift' WHEN 'message-critical drift' THEN 'drift' WHEN 'message-critical' THEN 'drift' END"
_MC = "CASE WHEN {1} IS NOT NULL THEN lower(trim({0})) LIKE 'message-critical%' END"
_RATED = f"(SELECT *, {_MAP.format('rating_a')} AS la, {_MAP.format('rating_b')} AS lb, {_MAP.format('rating_adj')} AS lj FROM {R})"


def _rated(r):
    return r.withColumns({"human": lb.human_label(F.col("rating_a"))[0], "second": lb.human_label(F.col("rating_b"))[0], "auto": F.col("auto_label")})


@query("label_source_precedence", R, sql=f"""
    SELECT coalesce(rating_adj, CASE WHEN la = lb THEN la END, auto_label) AS final_label, CASE WHEN rating_adj IS NOT NULL THEN 'human' WHEN la = lb THEN 'judge' ELSE 'nli' END AS label_source,
           coalesce(rating_adj, CASE WHEN la = lb THEN la END, auto_label) = 'drift' AND corpus = 'CRIT' AS critical, count(*) AS n FROM {_RATED} GROUP BY ALL""")
def _(r):
    t = _rated(r).withColumns({"judge": F.when(F.col("human") == F.col("second"), F.col("human")), "category": F.when(F.col("corpus") == "CRIT", "message_critical").otherwise("other")})
    return lb.with_source(t, "rating_adj", "judge", "auto_label").groupBy("final_label", "label_source", "critical").agg(F.count(F.lit(1)).alias("n"))


@query("two_rater_merge", R, doubles="raw_agreement", sql=f"""
    SELECT count(*) AS n_items, avg(coalesce(lower(trim(a.rating_a)) = lower(trim(b.rating_b)), false)::INT::DOUBLE) AS raw_agreement
    FROM (SELECT item_id, rating_a FROM {R} WHERE corpus <> 'CTRL') a FULL JOIN (SELECT item_id, rating_b FROM {R} WHERE corpus <> 'AUTH') b USING (item_id)""")
def _(r): return ag.raw_agreement(ag.merge_ratings(r.where("corpus != 'CTRL'").select("item_id", F.col("rating_a").alias("rating")), r.where("corpus != 'AUTH'").select("item_id", F.col("rating_b").alias("rating"))))  # noqa: E704


@query("consensus", R, sql=f"""
    SELECT CASE WHEN la = lb THEN la ELSE lj END AS consensus, CASE WHEN la = lb THEN {_MC.format('rating_a', 'la')} AND {_MC.format('rating_b', 'lb')} ELSE {_MC.format('rating_adj', 'lj')} END AS consensus_critical,
           CASE WHEN la = lb THEN 'agreed' WHEN lj IS NOT NULL THEN 'adjudicated' ELSE 'unresolved' END AS status, count(*) AS n FROM {_RATED} GROUP BY ALL""")
def _(r): return ag.consensus(r).groupBy("consensus", "consensus_critical", "status").agg(F.count(F.lit(1)).alias("n"))  # noqa: E704


@query("adjudication_list", R, sql=f"SELECT item_id FROM {_RATED} WHERE la IS DISTINCT FROM lb")
def _(r): return ag.disagreement_list(r)  # noqa: E704


@query("disagreement_matrix", R, sql=f"SELECT la AS human, lb AS second, count(*) AS n FROM {_RATED} WHERE la IS DISTINCT FROM lb GROUP BY ALL")
def _(r): return rates.disagreements(_rated(r), "human", "second")  # noqa: E704


@query("validation_frame", R, sql=f"SELECT h.item_id, rating_a, auto_label, auto_label IS NOT NULL AS has_automated_label FROM {R} h LEFT JOIN (SELECT item_id, auto_label FROM {R} WHERE corpus <> 'CTRL') USING (item_id)".replace("SELECT h.item_id, rating_a, auto_label, auto_label", "SELECT h.item_id, h.rating_a, m.auto_label, m.auto_label").replace("USING (item_id)", "m USING (item_id)"))
def _(r): return ag.validation_frame(r.select("item_id", "rating_a"), r.where("corpus != 'CTRL'").select("item_id", "auto_label"))  # noqa: E704


_KAPPA = """WITH t AS (SELECT {by} {a} AS a, {b} AS b FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), n AS (SELECT {by} count(*)::DOUBLE AS n, sum((a = b)::INT) AS s FROM t GROUP BY ALL),
    m AS (SELECT {by} sum(ca * cb) AS e FROM (SELECT {by} c, count(*) FILTER (a = c)::DOUBLE AS ca, count(*) FILTER (b = c)::DOUBLE AS cb FROM t, (SELECT unnest(['faithful', 'degraded', 'drift']) AS c) GROUP BY ALL) GROUP BY ALL)"""


@query("kappa_overall", R, doubles="agreement kappa", sql=_KAPPA.format(by="", a="la", b="lb", src=_RATED) + " SELECT n::BIGINT AS n, s / n AS agreement, (s / n - e / n / n) / nullif(1 - e / n / n, 0) AS kappa FROM n, m")
def _(r): return ag.agreement(_rated(r), "human", "second")  # noqa: E704


@query("stratified_diagnostics", R, doubles="agreement kappa", sql=_KAPPA.format(by="corpus,", a="la", b="auto_label", src=_RATED) + " SELECT corpus, n::BIGINT AS n, s / n AS agreement, (s / n - e / n / n) / nullif(1 - e / n / n, 0) AS kappa, n < 30 AS small_stratum FROM n JOIN m USING (corpus)")
def _(r): return ag.stratified_diagnostics(_rated(r), "corpus")  # noqa: E704


@query("kappa_by_class", R, doubles="kappa", sql=f"""
    WITH t AS (SELECT c AS class, count(*)::DOUBLE AS n, avg((la = c)::INT::DOUBLE) AS pa, avg((lb = c)::INT::DOUBLE) AS pb, avg((la = c AND lb = c)::INT::DOUBLE) AS pab FROM {_RATED}, (SELECT unnest(['faithful', 'degraded', 'drift']) AS c) WHERE la IS NOT NULL AND lb IS NOT NULL GROUP BY 1)
    SELECT class, n::BIGINT AS n, (1 - pa - pb + 2 * pab - pa * pb - (1 - pa) * (1 - pb)) / nullif(1 - pa * pb - (1 - pa) * (1 - pb), 0) AS kappa FROM t""")
def _(r): return ag.class_kappa(_rated(r), "human", "second")  # noqa: E704


_CONF = f"""(SELECT {{by}} h AS human, a AS auto, coalesce(sum(w) FILTER (la = h AND auto_label = a), 0)::DOUBLE AS weight
    FROM (SELECT *, {{w}} AS w FROM {_RATED}), (SELECT unnest(['faithful', 'degraded', 'drift']) AS h), (SELECT unnest(['faithful', 'degraded', 'drift']) AS a) GROUP BY ALL)"""


@query("confusion_weighted", R, doubles="weight", sql="SELECT * FROM " + _CONF.format(by="", w="sampling_weight"))
def _(r): return ag.confusion(_rated(r), "human", "auto", weight="sampling_weight")  # noqa: E704


def _metrics_sql(by: str, w: str) -> str:
    return f"""WITH m AS (SELECT {by} c AS class, sum(weight) FILTER (human = c AND auto = c) AS tp, sum(weight) FILTER (human = c AND auto <> c) AS fn, sum(weight) FILTER (human <> c AND auto = c) AS fp, sum(weight) FILTER (human <> c AND auto <> c) AS tn
            FROM {_CONF.format(by=by, w=w)}, (SELECT unnest(['faithful', 'degraded', 'drift']) AS c) GROUP BY ALL)
        SELECT {by} class, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(tp / nullif(tp + fp, 0), 0) AS ppv, coalesce(tn / nullif(tn + fn, 0), 0) AS npv, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM m"""


_M = "sensitivity specificity ppv npv f1 support"


@query("class_metrics", R, doubles=_M, sql=_metrics_sql("", "1.0"))
def _(r): return ag.class_metrics(_rated(r), "human", "auto")  # noqa: E704


@query("class_metrics_by_stratum", R, doubles=_M, sql=_metrics_sql("corpus,", "sampling_weight"))
def _(r): return ag.class_metrics(_rated(r), "human", "auto", "corpus", weight="sampling_weight")  # noqa: E704


@query("macro_weighted_f1", R, doubles="macro_f1 weighted_f1", sql=f"SELECT avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM ({_metrics_sql('', '1.0')})")
def _(r): return ag.macro_f1(_rated(r), "human", "auto")  # noqa: E704


_DET = "(m11 * (m22 * m33 - m23 * m32) - m12 * (m21 * m33 - m23 * m31) + m13 * (m21 * m32 - m22 * m31))"
_P = [f"(greatest(0, ({x}) / {_DET}))" for x in (
    "q1 * (m22 * m33 - m32 * m23) - m21 * (q2 * m33 - m32 * q3) + m31 * (q2 * m23 - m22 * q3)",
    "m11 * (q2 * m33 - m32 * q3) - q1 * (m12 * m33 - m32 * m13) + m31 * (m12 * q3 - q2 * m13)",
    "m11 * (m22 * q3 - q2 * m23) - m21 * (m12 * q3 - q2 * m13) + q1 * (m12 * m23 - m22 * m13)",
)]
_CL = ("faithful", "degraded", "drift")


@query("corrected_prevalence_point", R, doubles="naive corrected", sql=f"""
    WITH c AS (SELECT * FROM {_CONF.format(by='', w='1.0')}), m AS (SELECT {', '.join(f"sum(weight) FILTER (human = '{h}' AND auto = '{a}') / sum(weight) FILTER (human = '{h}') AS m{i + 1}{j + 1}" for i, h in enumerate(_CL) for j, a in enumerate(_CL))} FROM c),
         q AS (SELECT {', '.join(f"avg((auto_label = '{a}')::INT::DOUBLE) AS q{j + 1}" for j, a in enumerate(_CL))} FROM {R}), p AS (SELECT *, {', '.join(f'{e} AS p{i + 1}' for i, e in enumerate(_P))} FROM m, q)
    SELECT class, naive, corrected FROM ({' UNION ALL '.join(f"SELECT '{c}' AS class, q{i + 1} AS naive, p{i + 1} / (p1 + p2 + p3) AS corrected FROM p" for i, c in enumerate(_CL))})""")
def _(r): return ag.corrected_prevalence(r, _rated(r)).select("class", "naive", "corrected")  # noqa: E704


_CF = f"(SELECT model, message_id, confidence / 100 AS c, label = 'faithful' AS y FROM {A} WHERE confidence IS NOT NULL)"
_LEFT = "(CASE WHEN c >= 0.9 THEN 9 WHEN c >= 0.8 THEN 8 WHEN c >= 0.7 THEN 7 WHEN c >= 0.6 THEN 6 WHEN c >= 0.5 THEN 5 WHEN c >= 0.4 THEN 4 WHEN c >= 0.3 THEN 3 WHEN c >= 0.2 THEN 2 WHEN c >= 0.1 THEN 1 ELSE 0 END)"
_RIGHT = "(CASE WHEN c <= 0.1 THEN 0 WHEN c <= 0.2 THEN 1 WHEN c <= 0.3 THEN 2 WHEN c <= 0.4 THEN 3 WHEN c <= 0.5 THEN 4 WHEN c <= 0.6 THEN 5 WHEN c <= 0.7 THEN 6 WHEN c <= 0.8 THEN 7 WHEN c <= 0.9 THEN 8 ELSE 9 END)"
_ECE = "SELECT {by} sum(n * abs(y - c)) / sum(n) AS ece, sum(n)::BIGINT AS n FROM (SELECT {by} {bin} AS b, avg(c) AS c, avg(y::INT::DOUBLE) AS y, count(*)::DOUBLE AS n FROM {src} GROUP BY ALL) GROUP BY ALL"


@query("ece_v1_by_model", A, doubles="ece", sql=_ECE.format(by="model,", bin=_LEFT, src=_CF))
def _(a): return cal.binned_error(cal.calibration_frame(a), "confidence", "correct", "model")  # noqa: E704


@query("ece_v2_equal_frequency", A, doubles="ece", sql=f"""
    WITH f AS (SELECT * FROM {_CF}), e AS (SELECT list_distinct(list_concat([0.0::DOUBLE], quantile_cont(c, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), [1.0::DOUBLE])) AS e FROM f)
    SELECT sum(n * abs(y - c)) / sum(n) AS ece, sum(n)::BIGINT AS n FROM (SELECT len(list_filter(list_sort(e)[2:-2], lambda x: x <= c)) AS b, avg(c) AS c, avg(y::INT::DOUBLE) AS y, count(*)::DOUBLE AS n FROM (SELECT f.c, f.y, e.e FROM f, e) GROUP BY 1)""".replace("SELECT len(", "SELECT len(").replace("avg(c) AS c, avg(y::INT::DOUBLE) AS y, count(*)::DOUBLE AS n FROM (SELECT f.c, f.y, e.e FROM f, e) GROUP BY 1", "avg(c) AS c, avg(y::INT::DOUBLE) AS y, count(*)::DOUBLE AS n FROM (SELECT f.c, f.y, e.e FROM f, e) g GROUP BY 1"))
def _(a): return cal.equal_frequency_error(cal.calibration_frame(a), "confidence", "correct")  # noqa: E704


for _name, _bin, _closed in (("left", _LEFT, "left"), ("right", _RIGHT, "right")):
    query(f"reliability_{_name}_closed", A, doubles="mean_score share_hit", sql=f"SELECT model, {_bin}::BIGINT AS bin, avg(c) AS mean_score, avg(y::INT::DOUBLE) AS share_hit, count(*) AS n FROM {_CF} GROUP BY ALL")(lambda a, c=_closed: cal.reliability(cal.calibration_frame(a), "confidence", "correct", "model", closed=c))

_AUC = "SELECT {by} sum(pos * (coalesce(below, 0) + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM (SELECT *, sum(neg) OVER ({part} ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (SELECT {by} c, count(*) FILTER (y)::DOUBLE AS pos, count(*) FILTER (NOT y)::DOUBLE AS neg FROM {src} GROUP BY ALL)) GROUP BY ALL"


@query("auroc_by_model", A, doubles="auroc", sql=_AUC.format(by="model,", part="PARTITION BY model", src=_CF))
def _(a): return cal.auroc(cal.calibration_frame(a), "confidence", "correct", "model")  # noqa: E704


_DF = f"(SELECT {LV} AS cer_target, 1 - confidence / 100 AS c, label = 'drift' AS y, confidence FROM {A} WHERE confidence IS NOT NULL)"


@query("drift_calibration_block", A, doubles="cer_target drift_auroc ece_drift fnr sens spec", sql=f"""
    WITH n AS (SELECT {LV} AS cer_target, count(*) AS n, count(*) FILTER (label = 'drift') AS n_drift_all, count(*) FILTER (label = 'drift' AND confidence IS NOT NULL) AS n_drift_scored, count(confidence) AS n_scored, count(*) FILTER (confidence IS NULL) AS n_missing_conf,
                      count(*) FILTER (label = 'drift' AND confidence < 90)::DOUBLE AS tp, count(*) FILTER (label <> 'drift' AND confidence >= 90)::DOUBLE AS tn, count(*) FILTER (label <> 'drift' AND confidence IS NOT NULL) AS neg FROM {A} GROUP BY 1),
         r AS ({_AUC.format(by='cer_target,', part='PARTITION BY cer_target', src=_DF)}), e AS ({_ECE.format(by='cer_target,', bin=_LEFT, src=_DF)})
    SELECT cer_target, n.n, n_drift_all, n_drift_scored, n_scored, n_missing_conf, auroc AS drift_auroc, ece AS ece_drift, 1 - tp / nullif(n_drift_scored, 0) AS fnr, tp / nullif(n_drift_scored, 0) AS sens, tn / nullif(neg, 0) AS spec, auroc IS NULL AS degenerate
    FROM n LEFT JOIN r USING (cer_target) LEFT JOIN e USING (cer_target)""")
def _(a): return cal.drift_calibration(a.withColumn("cer_target", rates.level()), "cer_target")  # noqa: E704


@query("random_effects_pool", A, doubles="pooled se lo hi tau2 q i2", sql=f"""
    WITH y AS (SELECT avg({D}) AS y, count(*)::DOUBLE AS n FROM {A} GROUP BY model), e AS (SELECT y, y - 1.96 * sqrt(y * (1 - y) / n) AS lo, y + 1.96 * sqrt(y * (1 - y) / n) AS hi FROM y),
         v AS (SELECT y, greatest(((hi - lo) / (2 * 1.96)) ** 2, 1e-12) AS v FROM e), a AS (SELECT count(*) AS k, sum(1 / v) AS sw, sum(1 / v / v) AS sw2, sum(y / v) AS swy FROM v),
         q AS (SELECT k, sw, sw2, sum((y - swy / sw) ** 2 / v) AS q FROM v, a GROUP BY ALL), t AS (SELECT *, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM q),
         r AS (SELECT k, q, tau2, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS pooled, 1 / sqrt(sum(1 / (v + tau2))) AS se FROM v, t GROUP BY ALL)
    SELECT k, pooled, se, pooled - 1.96 * se AS lo, pooled + 1.96 * se AS hi, tau2, q, greatest(0, (q - (k - 1)) / q) * 100 AS i2 FROM r""")
def _(a):
    t = rates.drift_rate(a, "model").withColumn("h", 1.96 * F.sqrt(F.col("drift_rate") * (1 - F.col("drift_rate")) / F.col("n")))
    return cal.random_effects(t.select("drift_rate", (F.col("drift_rate") - F.col("h")).alias("lo"), (F.col("drift_rate") + F.col("h")).alias("hi")), "drift_rate", "lo", "hi")


@query("smd_balance", A, doubles="mean_a mean_b smd", sql=f"""
    WITH t AS (SELECT corpus = 'CRIT' AS arm, realized_cer::DOUBLE AS realized_cer, replicate_idx::DOUBLE AS replicate_idx, confidence FROM {A} WHERE corpus <> 'AUTH'), u AS (UNPIVOT t ON realized_cer, replicate_idx, confidence INTO NAME covariate VALUE x),
         m AS (SELECT covariate, avg(x) FILTER (arm) AS mean_a, avg(x) FILTER (NOT arm) AS mean_b, var_pop(x) FILTER (arm) AS va, var_pop(x) FILTER (NOT arm) AS vb FROM u GROUP BY 1)
    SELECT covariate, mean_a, mean_b, CASE WHEN va + vb = 0 THEN 0 ELSE (mean_a - mean_b) / sqrt((va + vb) / 2) END AS smd FROM m""")
def _(a): return balance.balance_table(a.where("corpus != 'AUTH'").withColumn("arm", F.col("corpus") == "CRIT"), "arm", ["realized_cer", "replicate_idx", "confidence"])  # noqa: E704


@query("match_distance_summary", A, doubles="min median mean max", sql=f"SELECT min(d) AS min, quantile_cont(d, 0.5) AS median, avg(d) AS mean, max(d) AS max FROM (SELECT abs(realized_cer - cer_target) AS d FROM {A})")
def _(a): return balance.distance_summary(a.select(F.abs(F.col("realized_cer") - F.col("cer_target")).alias("d")), "d")  # noqa: E704


_MAPQ = "(SELECT crit_message_id AS pair_id, crit_message_id AS message_id, 1 AS critical FROM fx_pairs UNION ALL SELECT crit_message_id, message_id, 0 FROM fx_pairs)"
_ARMS = f"(SELECT pair_id, {{by}} count(*) FILTER (critical = 1) AS n_crit, count(*) FILTER (critical = 1 AND label = 'drift') AS k_crit, count(*) FILTER (critical = 0) AS n_ctrl, count(*) FILTER (critical = 0 AND label = 'drift') AS k_ctrl FROM {A} JOIN {_MAPQ} USING (message_id) GROUP BY ALL)"


@query("pair_arm_stats", A, "fx_pairs", sql="SELECT * FROM " + _ARMS.format(by=""))
def _(a, p): return balance.arm_sums(balance.matched_rows(a, p))  # noqa: E704


_RDQ = "SELECT {by} sum(n_crit)::BIGINT AS n_crit, sum(n_ctrl)::BIGINT AS n_ctrl, sum(k_crit) / sum(n_crit) - sum(k_ctrl) / sum(n_ctrl) AS rd, 1000 * (sum(k_crit) / sum(n_crit) - sum(k_ctrl) / sum(n_ctrl)) AS per_thousand FROM {src} GROUP BY ALL"


@query("risk_difference_point", A, "fx_pairs", doubles="rd per_thousand", sql=_RDQ.format(by="", src=_ARMS.format(by="")))
def _(a, p): return balance.risk_difference(balance.arm_sums(balance.matched_rows(a, p)))  # noqa: E704


@query("risk_difference_by_level", A, "fx_pairs", doubles="cer_target rd per_thousand", sql=_RDQ.format(by="cer_target,", src=_ARMS.format(by=f"{LV} AS cer_target,")))
def _(a, p):
    m = balance.matched_rows(a, p).withColumn("cer_target", rates.level())
    return balance.risk_difference(balance.arm_sums(m, "cer_target"), "cer_target")


@query("pair_candidates_join", A, "fx_pairs", doubles="cer_target", sql=f"""
    WITH t AS (SELECT pair_id, critical, {LV} AS cer_target, label, row_number() OVER (PARTITION BY pair_id, critical, {LV} ORDER BY replicate_idx, model, label, l_orderkey, l_suppkey) AS r FROM {A} JOIN {_MAPQ} USING (message_id))
    SELECT c.pair_id, c.cer_target, c.label AS crit_label, o.label AS ctrl_label FROM t c JOIN t o ON c.pair_id = o.pair_id AND c.cer_target = o.cer_target AND c.critical = 1 AND o.critical = 0 AND c.r = 1 AND o.r = 1""")
def _(a, p): return balance.pair_candidates(a, p)  # noqa: E704


@query("reference_arm_pairs", A, sql=f"""
    SELECT corpus, 'forced' AS condition, count(*) AS n, count(DISTINCT message_id) AS n_messages FROM {A}
    WHERE replicate_idx < 4 AND ((corpus = 'AUTH' AND message_id LIKE 'msg1%') OR corpus IN ('CRIT', 'CTRL')) GROUP BY ALL""")
def _(a):
    auth = a.where("corpus = 'AUTH' and message_id like 'msg1%'").select("message_id", "corpus").distinct()
    probes = a.where("corpus in ('CRIT', 'CTRL')").select("message_id", "corpus").distinct()
    t = balance.reference_arm(a, auth, probes, 4)
    return t.groupBy("corpus", "condition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("message_id").alias("n_messages"))


@query("resume_anti_join", A, sql=f"SELECT count(*) AS n FROM {A} WHERE (message_id, model) NOT IN (SELECT DISTINCT message_id, model FROM {A} WHERE replicate_idx = 0 AND label = 'drift')")
def _(a): return balance.resume(a, a.where("replicate_idx = 0 and label = 'drift'").select("message_id", "model").distinct(), ["message_id", "model"]).agg(F.count(F.lit(1)).alias("n"))  # noqa: E704


@query("checked_merge", A, "fx_raw", sql=f"SELECT raw_label, count(*) AS n FROM {A} JOIN fx_raw USING {_KEY} GROUP BY 1")
def _(a, r): return ct.merge_checked(a, r, ["message_id", "corpus", "cer_target", "replicate_idx"], unmatched="drop").groupBy("raw_label").agg(F.count(F.lit(1)).alias("n"))  # noqa: E704


@query("dictionary_lookup", A, sql=f"SELECT CASE label WHEN 'faithful' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END::BIGINT AS severity, count(*) AS n FROM {A} GROUP BY 1")
def _(a):
    lookup = F.create_map(*[x for k, v in (("faithful", 0), ("degraded", 1), ("drift", 2)) for x in (F.lit(k), F.lit(v).cast("long"))])
    return a.groupBy(lookup[F.col("label")].alias("severity")).agg(F.count(F.lit(1)).alias("n"))


_SZ = "(SELECT source, count(*) AS size FROM documents GROUP BY 1)"
_HAM = "SELECT source, size, (floor(q) + CASE WHEN row_number() OVER (ORDER BY q - floor(q) DESC, source) <= {n} - sum(floor(q)) OVER () THEN 1 ELSE 0 END)::BIGINT AS alloc FROM (SELECT *, {n} * {cap} / sum({cap}) OVER () AS q FROM {src})"


@query("hamilton_allocation", "documents", sql=_HAM.format(n=97, cap="size::DOUBLE", src=_SZ))
def _(d): return sm.hamilton(d.groupBy("source").agg(F.count(F.lit(1)).alias("size")), "source", 97)  # noqa: E704


@query("floor_allocation", "documents", sql=f"SELECT source, size, alloc + 1 AS alloc FROM ({_HAM.format(n='(97 - (SELECT count(DISTINCT source) FROM documents))', cap='(size - 1)::DOUBLE', src=_SZ)})")
def _(d): return sm.hamilton_with_floor(d.groupBy("source").agg(F.count(F.lit(1)).alias("size")), "source", 97)  # noqa: E704


@query("stratified_hash_sample", "documents", sql=f"""
    SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws('|', '7', doc_id::VARCHAR)), doc_id) AS r FROM documents) JOIN ({_HAM.format(n=97, cap='size::DOUBLE', src=_SZ)}) USING (source) WHERE r <= alloc""")
def _(d): return sm.proportional_sample(d.select("doc_id", "source"), "source", 97, "7", "doc_id").select("doc_id", "source")  # noqa: E704


@query("equal_quota_sample", "documents", sql="""
    SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws('|', '3', doc_id::VARCHAR)), doc_id) AS r FROM documents) WHERE r <= greatest(1, 50 // (SELECT count(DISTINCT lang) FROM documents))""")
def _(d): return sm.equal_quota_sample(d.select("doc_id", "lang"), "lang", 50, "3", "doc_id").select("doc_id", "lang")  # noqa: E704


_ID = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("panel_with_weights", A, doubles="sampling_weight", sql=f"""
    SELECT model, corpus, label, sum(w) AS sampling_weight, count(*) AS n FROM (SELECT model, corpus, label, count(*) OVER p / least(count(*) OVER p, 3)::DOUBLE AS w,
           row_number() OVER (p ORDER BY sha256(concat_ws('|', '11', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR)), {_ID}) AS r FROM {A} WINDOW p AS (PARTITION BY model, corpus, label)) WHERE r <= 3 GROUP BY ALL""")
def _(a): return sm.weighted_panel(a, ["model", "corpus", "label"], 3, "11", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").groupBy("model", "corpus", "label").agg(F.sum("sampling_weight").alias("sampling_weight"), F.count(F.lit(1)).alias("n"))  # noqa: E704


@query("hash_shuffle_ids", R, sql=f"SELECT item_id, row_number() OVER (ORDER BY sha256(concat_ws('|', '5', item_id)), item_id) AS place FROM {R}")
def _(r): return sm.shuffle_items(r.select("item_id"), "5")  # noqa: E704


@query("length_terciles", "documents", sql="""
    WITH e AS (SELECT list_sort(list_distinct(quantile_cont(length(text)::DOUBLE, [0, 1.0 / 3, 2.0 / 3, 1]))) AS e FROM documents)
    SELECT CASE WHEN len(e) <= 2 THEN 'short' WHEN len(e) = 3 THEN CASE WHEN length(text) <= e[2] THEN 'short' ELSE 'long' END WHEN length(text) <= e[2] THEN 'short' WHEN length(text) <= e[3] THEN 'medium' ELSE 'long' END AS length_bin, count(*) AS n FROM documents, e GROUP BY 1""")
def _(d): return sm.length_terciles(d, F.col("text")).groupBy("length_bin").agg(F.count(F.lit(1)).alias("n"))  # noqa: E704


@query("numbered_blinded_sheet", R, sql=f"SELECT 'M' || lpad((row_number() OVER (ORDER BY corpus, item_id))::VARCHAR, 7, '0') AS item_id, rating_a AS shown, '' AS rating, '' AS notes FROM {R}")
def _(r): return sm.blinded(sm.number_items(r.withColumnRenamed("item_id", "source_id").withColumn("shown", F.col("rating_a")), "M", ["corpus", "source_id"], 7), ["shown"])  # noqa: E704


@query("unblinding_key", R, sql=f"SELECT 'M' || lpad((row_number() OVER (ORDER BY corpus, item_id))::VARCHAR, 7, '0') AS item_id, item_id AS source_id, corpus, auto_label FROM {R}")
def _(r): return sm.unblinding_key(sm.number_items(r.withColumnRenamed("item_id", "source_id"), "M", ["corpus", "source_id"], 7), ["source_id", "corpus", "auto_label"])  # noqa: E704


@query("selection_provenance", A, sql=f"""
    SELECT provenance, count(*) AS n FROM (SELECT message_id, model, CASE WHEN bool_or(s) AND bool_or(c) THEN 'both' WHEN bool_or(s) THEN 'stratified' ELSE 'message_critical' END AS provenance
    FROM (SELECT DISTINCT message_id, model, replicate_idx = 0 AS s, corpus = 'CRIT' AS c FROM {A} WHERE replicate_idx = 0 OR corpus = 'CRIT') GROUP BY ALL) GROUP BY 1""")
def _(a): return sm.union_with_provenance(a.where("replicate_idx = 0").select("message_id", "model"), a.where("corpus = 'CRIT'").select("message_id", "model"), ["message_id", "model"]).groupBy("provenance").agg(F.count(F.lit(1)).alias("n"))  # noqa: E704


@query("dedupe_keep_first", A, sql=f"SELECT message_id, model, label, l_orderkey FROM {A} QUALIFY row_number() OVER (PARTITION BY message_id, model ORDER BY {_ID}, label) = 1")
def _(a): return sm.first_by_key(a, ["message_id", "model"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "label"]).select("message_id", "model", "label", "l_orderkey")  # noqa: E704


@query("id_set_operations", A, sql=f"""
    WITH a AS (SELECT DISTINCT message_id FROM {A} WHERE corpus = 'AUTH' AND label = 'drift'), b AS (SELECT DISTINCT message_id FROM {A} WHERE confidence IS NULL)
    SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(t):
    a, b = t.where("corpus = 'AUTH' and label = 'drift'").select("message_id").distinct(), t.where("confidence is null").select("message_id").distinct()
    n = lambda op, x: x.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return n("union", a.union(b).distinct()).union(n("intersect", a.intersect(b))).union(n("except", a.subtract(b)))


@query("bh_adjust", A, doubles="p q", sql=f"""
    WITH p AS (SELECT model, avg({D}) * avg({D}) AS p FROM {A} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, model) AS r, count(*) OVER () AS m FROM p)
    SELECT model, p, least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r""")
def _(a): return rk.benjamini_hochberg(rates.drift_rate(a, "model").select("model", (F.col("drift_rate") * F.col("drift_rate")).alias("p")), "p", "model")  # noqa: E704


@query("nearest_to_level", A, doubles="level gap", sql=f"""
    SELECT level, arg_min(message_id, (abs(x - level), message_id)) AS message_id, min(abs(x - level)) AS gap FROM (SELECT message_id, avg(realized_cer) AS x FROM {A} GROUP BY 1), (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS level) GROUP BY 1""")
def _(a): return rk.nearest_to_level(a.groupBy("message_id").agg(F.avg("realized_cer").alias("x")), (0.1, 0.2, 0.3), "x", "message_id")  # noqa: E704


@query("span_extremes", A, doubles="x", sql=f"""
    SELECT message_id, x, least(2 * row_number() OVER (ORDER BY x, message_id) - 1, 2 * row_number() OVER (ORDER BY x DESC, message_id DESC)) AS turn FROM (SELECT message_id, avg(realized_cer) AS x FROM {A} GROUP BY 1) ORDER BY turn LIMIT 6""")
def _(a): return rk.span_extremes(a.groupBy("message_id").agg(F.avg("realized_cer").alias("x")), "x", "message_id", 6)  # noqa: E704


@query("outcome_guard", _I, sql=f"SELECT condition, CASE WHEN {_DEC} THEN 'declined' ELSE label END AS outcome, count(*) AS n FROM {_I} GROUP BY ALL")
def _(i): return i.groupBy("condition", lb.outcome(F.col("label"), F.col("abstained")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))  # noqa: E704


_CAND = "l_suppkey % 6 = 4"


@query("any_candidate_faithful", A, sql=f"""
    WITH t AS (SELECT message_id, label, CASE WHEN {_CAND} THEN label = 'faithful' OR (length(message_id) + l_orderkey % 4) % 3 = 0 OR (length(message_id) + l_orderkey % 5) % 3 = 0 END AS any_candidate_faithful FROM {A})
    SELECT any_candidate_faithful, label, count(*) AS n FROM t GROUP BY ALL""")
def _(a):
    c = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c")
    good = (F.length("message_id") + F.col("c")) % 3 == 0
    labels = a.select("message_id").distinct().select("message_id", c).select(F.col("message_id").alias("intended_text"), F.concat(F.lit("c"), F.col("c").cast("string")).alias("output_message"), F.when(good, "faithful").otherwise("drift").alias("label"))
    name = lambda k: F.concat(F.lit("c"), (F.col("l_orderkey") % k).cast("string"))
    rows = a.withColumn("row_id", F.monotonically_increasing_id()).withColumns({"intended_text": F.col("message_id"), "candidates": F.when(F.expr(_CAND), F.array(name(4), name(5)))})
    rows = rows.select("row_id", "intended_text", "candidates", "label")
    return lb.any_candidate_faithful(rows, labels, ("row_id",)).groupBy("any_candidate_faithful", "label").agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_apply", S, sql=f"SELECT {_vote_sql('roberta', 'minilm')} AS vote, count(*) AS n FROM {S} GROUP BY 1")
def _(s):
    key = ["nli_roberta_fwd", "nli_roberta_bwd", "cos_minilm", "fluency_raw", *lb.CRIT_COLUMNS]
    return ct.dedupe_apply(s, key, lambda d: d.withColumn("vote", lb.vote("roberta", "minilm"))).groupBy("vote").agg(F.count(F.lit(1)).alias("n"))


@query("ordered_classes", A, sql=f"SELECT row_number() OVER (ORDER BY CASE label WHEN 'faithful' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END) AS place, label, count(*) AS n FROM {A} GROUP BY label")
def _(a):
    from pyspark.sql import Window as W

    rank = F.array_position(F.array(*[F.lit(c) for c in _CL]), F.col("label"))
    t = a.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.row_number().over(W.orderBy(rank)).cast("long").alias("place"), "label", "n")


@query("null_drop_counts", A, sql=f"SELECT count(*) FILTER (confidence IS NOT NULL) AS kept, count(*) FILTER (confidence IS NULL) AS dropped FROM {A}")
def _(a):
    kept, dropped = ct.drop_nulls_counted(a, ["confidence"])
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.lit(dropped).cast("long").alias("dropped"))


@query("power_target_sizing", R, sql=f"""
    WITH c AS (SELECT count(*) AS n FROM {R} WHERE corpus = 'CRIT'), s AS (SELECT *, row_number() OVER (ORDER BY sha256(concat_ws('|', '13', item_id)), item_id) AS r FROM {R} WHERE corpus <> 'CRIT')
    SELECT item_id, 'stratified' AS provenance FROM s, c WHERE r <= greatest(0, 6000 - c.n) UNION ALL SELECT item_id, 'message_critical' FROM {R} WHERE corpus = 'CRIT'""")
def _(r):
    critical = r.where("corpus = 'CRIT'")
    n = critical.count()
    rest = sm.shuffle_items(r.where("corpus != 'CRIT'").select("item_id"), "13").where(F.col("place") <= max(0, 6000 - n))
    return sm.union_with_provenance(rest, critical, ["item_id"])
