"""The composed run as one query: digests written, read back, and held against the SQL of each of their blocks."""
from __future__ import annotations

from emberlane.operators import digests
from emberlane.plans import registry
from emberlane.plans.modelling import FIT, _covariates
from emberlane.plans.registry import query
from emberlane.plans.relational import _zero
from emberlane.scratch import Scratch

_TERMS = ("beta", "se", "lo", "hi", "p")
#: Section, block, the registered query that builds the same, its key columns, and the values that are compared.
CHECKED = (
    ("drift_curve", "overall", "drift_curve_overall", ("cer_target",), ("n", "n_drift", "drift_rate")),
    ("drift_curve", "by_corpus", "drift_rate_by_corpus_level", ("corpus", "cer_target"), ("n", "n_drift", "drift_rate")),
    ("drift_curve", "critical_level", "critical_threshold", (), ("critical_level",)),
    ("calibration", "ece", "ece_v1_by_model", ("model",), ("ece", "n")),
    ("calibration", "auroc", "auroc_by_model", ("model",), ("auroc", "n_pos", "n_neg")),
    ("mixed_model", "one_versus_rest", "adjusted_one_vs_rest", ("class", "term"), _TERMS),
    ("multinomial", "coefficients", "multinomial_logit", ("term",), _TERMS),
    ("multinomial", "drift_vs_degraded", "binary_contrast_logit", ("term",), _TERMS),
    ("confidence", "predicted_drift", "predicted_drift_grid", ("realized_cer",), ("predicted",)),
    ("dependence_sensitivity", "anchor", "clustered_logit_realised", ("term",), _TERMS),
    ("dependence_sensitivity", "per_model_pooled", "pooled_model_slope", (), ("pooled", "se", "tau2")),
    ("benefit_harm", "overall", "transition_overall", ("transition",), ("n", "share")),
)


def _sql() -> str:
    parts = []
    for section, block, name, keys, values in CHECKED:
        key = f"concat_ws('|', {', '.join(f'{k}::VARCHAR' for k in keys)})" if keys else "''"
        parts += [f"SELECT '{section}.{block}' AS block, {key} AS key, '{v}' AS metric, ({v})::DOUBLE AS value FROM ({registry.ORACLE[name]}) q" for v in values]
    return f"SELECT block, key, metric, round(value, {FIT}) AS value FROM ({' UNION ALL '.join(parts)}) q WHERE value IS NOT NULL"


@query("composed_run", "fx_attempts", "fx_raw", "fx_signals", digits=FIT)
def _(a, raw, signals):
    spark = a.sparkSession
    path = Scratch(spark).folder
    digests.compose(a, raw, _zero(signals), _covariates(), path)
    rows = []
    for section, block, _, keys, values in CHECKED:
        for r in digests.read_section(spark, path, section)[block]:
            key = "|".join(str(r[k]) for k in keys)
            rows += [(f"{section}.{block}", key, v, float(r[v])) for v in values if r[v] is not None]
    if not all(digests.unchanged(spark, path).values()):
        raise ValueError("a digest is not what the log says")
    return spark.createDataFrame(rows, "block string, key string, metric string, value double")


registry.ORACLE["composed_run"] = _sql()
