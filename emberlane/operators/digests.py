"""The composed analysis: every result block of one attempts table, built side by side and written as digests."""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.operators import audit, inference, rates, transitions
from emberlane.operators import calibration as cal
from emberlane.scratch import Scratch
from emberlane.sources import io

#: Blocks that run at the same time; they share the cluster, and most are a few small jobs in turn.
AT_ONCE = 6
#: Percent that an estimator's slope may lie off the anchor's and still count as stable (fixed value).
STABLE_WITHIN = 10.0

#: Columns of the attempts that the blocks read; covariates come besides.
READ = ("model", "message_id", "corpus", "cer_target", "replicate_idx", "realized_cer", "confidence", "label")

Blocks = dict[str, Callable[[], DataFrame]]


def patterns(a: DataFrame, covariates: list[str]) -> DataFrame:
    """Attempts that are equal in all that the fits read, counted once (``_rows``)."""
    return a.groupBy("model", "message_id", "realized_cer", "label", *covariates).agg(F.count(F.lit(1)).alias("_rows"))


def sections(a: DataFrame, raw: DataFrame | None, audited: DataFrame, t: DataFrame, xs: dict[str, Column], draws: int) -> dict[str, Blocks]:
    """What each section of the run consists of; every block is a frame of few rows. Fits read the :func:`patterns` ``t``."""
    n = F.col("_rows")
    scores = cal.calibration_frame(a)
    out: dict[str, Blocks] = {
        "drift_curve": {
            "overall": lambda: rates.drift_rate(a, "cer_target"), "by_corpus": lambda: rates.drift_rate(a, "corpus", "cer_target"),
            "critical_level": lambda: rates.critical_level(a), "weighting": lambda: rates.weighting_sensitivity(a), "label_mix": lambda: rates.label_mix(a),
        },
        "zero_cer_audit": {"causes": lambda: audit.cause_counts(audited)},
        "calibration": {
            "ece": lambda: cal.binned_error(scores, "confidence", "correct", "model"), "auroc": lambda: cal.auroc(scores, "confidence", "correct", "model"),
            "intervals": lambda: inference.ece_auroc_bootstrap(a, draws),
        },
        "mixed_model": {"one_versus_rest": lambda: inference.one_versus_rest(t, xs, n)},
        "multinomial": {
            "coefficients": lambda: inference.multinomial_model(t, xs, n), "drift_vs_degraded": lambda: inference.binary_contrast(t, "drift", "degraded", xs, n),
            "drift_vs_faithful": lambda: inference.binary_contrast(t, "drift", "faithful", xs, n),
        },
        "confidence": {
            "confidently_wrong": lambda: rates.confidently_wrong(a), "missing": lambda: rates.missing_confidence_grid(a),
            "predicted_drift": lambda: inference.predicted_grid(t, weight=n),
        },
        "dependence_sensitivity": {
            "anchor": lambda: inference.dose_model(t, "realized_cer", n), "per_model_pooled": lambda: inference.pooled_slope(t, weight=n), "per_model": lambda: inference.model_slopes(t, weight=n),
            "gee": lambda: inference.gee_slope(t, weight=n), "bootstrap_message": lambda: inference.slope_bootstrap(t, "message_id", draws=draws, weight=n),
            "bootstrap_model": lambda: inference.slope_bootstrap(t, "model", draws=draws, weight=n),
        },
    }
    if raw is not None:
        out["benefit_harm"] = {"overall": lambda: transitions.transition_counts(a, raw), "by_group": lambda: transitions.net_by(a, raw, "corpus", "cer_target")}
    return out


def stability(blocks: dict[str, list[dict]]) -> dict:
    """Whether the slopes of all estimators agree with the message-clustered anchor, and whose intervals hold it."""
    anchor = next(r["beta"] for r in blocks["anchor"] if r["term"] == "realized_cer")
    pool, gee = blocks["per_model_pooled"][0], blocks["gee"][0]
    found = [("per_model_pooled", pool["pooled"], pool["lo"], pool["hi"]), ("gee", gee["slope"], gee["lo"], gee["hi"])]
    found += [(k, blocks[k][0]["point"], blocks[k][0]["lo"], blocks[k][0]["hi"]) for k in ("bootstrap_message", "bootstrap_model")]
    slopes = [f for f in found if f[1] is not None]
    return {**inference.stability(anchor, slopes, STABLE_WITHIN), "anchor": anchor, "holds_anchor": {k: lo <= anchor <= hi for k, _, lo, hi in slopes}}


def compose(attempts: DataFrame, raw: DataFrame | None, audited: DataFrame, xs: dict[str, Column], path: str, draws: int = 500) -> dict[str, str]:
    """Build all sections and write them: a digest a section, ``stats.json`` with all of them, and a provenance log.

    The attempts are stored once, the columns that are read, for every table of rates; so are their :func:`patterns`, which
    the fits read. Blocks run :data:`AT_ONCE` at a time; only their few rows reach the
    driver. Returns the digests' hashes by section. Without raw decode labels the benefit section says that it was skipped.
    """
    spark = attempts.sparkSession
    with Scratch(spark) as scratch:
        own = {k: f"_x{i}" for i, k in enumerate(xs)}
        a = scratch.keep(attempts.select(*READ, *[xs[k].alias(c) for k, c in own.items()]))
        t = scratch.keep(patterns(a, list(own.values())))
        xs = {k: F.col(c) for k, c in own.items()}
        plan = [(s, b, make) for s, blocks in sections(a, raw, audited, t, xs, draws).items() for b, make in blocks.items()]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            rows = list(pool.map(lambda p: [r.asDict(recursive=True) for r in p[2]().collect()], plan))
        n, messages = a.agg(F.count(F.lit(1)), F.count_distinct(F.when(F.col("corpus") == "AUTH", F.col("message_id")))).first()
    out: dict[str, dict] = {}
    for (section, block, _), found in zip(plan, rows, strict=True):
        out.setdefault(section, {})[block] = found
    out["dependence_sensitivity"]["stability"] = stability(out["dependence_sensitivity"])
    out.setdefault("benefit_harm", {"skipped": True, "reason": "no raw decode labels"})
    meta = {"n_rows": n, "n_auth_messages": messages, "draws": draws, **io.run_facts(spark)}
    hashes = {}
    for section, blocks in out.items():
        hashes[section] = io.write_digest(spark, blocks, f"{path}/{section}.json")
        io.log_provenance(spark, f"{path}/log", section, {"sha256": hashes[section], **meta})
    io.write_digest(spark, {"_meta": meta, **out}, f"{path}/stats.json")
    return hashes


def read_section(spark, path: str, section: str) -> dict:  # noqa: ANN001
    return json.loads(io.read_text(spark, f"{path}/{section}.json") or "{}")


def unchanged(spark, path: str) -> dict[str, bool]:  # noqa: ANN001
    """Which digests still have the hash that the log says they were written with."""
    log = io.read_provenance(spark, f"{path}/log")
    return {s: hashlib.sha256((io.read_text(spark, f"{path}/{s}.json") or "").encode()).hexdigest() == e["sha256"] for s, e in log.items()}
