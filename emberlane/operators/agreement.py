"""Rater agreement, consensus, class metrics and prevalence correction."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.contracts import assert_domain, assert_unique, assert_weights
from emberlane.functions.stats import kappa, share
from emberlane.operators.label import human_label
from emberlane.schema import CLASSES, LOW_RATE_BAND, SMALL_STRATUM


def _clean(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def merge_ratings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sheets (item_id, rating) side by side, all items; agree where both rated and equal after trim and lower case."""
    for sheet in (a, b):
        assert_unique(sheet, ["item_id"], "rating sheet")
    both = a.select("item_id", F.col("rating").alias("rating_a")).join(b.select("item_id", F.col("rating").alias("rating_b")), "item_id", "full_outer")
    same = F.col("rating_a").isNotNull() & F.col("rating_b").isNotNull() & (_clean("rating_a") == _clean("rating_b"))
    return both.withColumn("agree", F.coalesce(same, F.lit(False)))


def raw_agreement(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("n_items"), F.avg(F.col("agree").cast("double")).alias("raw_agreement"))


def consensus(df: DataFrame, a: str = "rating_a", b: str = "rating_b", adjudicator: str = "rating_adj") -> DataFrame:
    """label, critical and status of each item: agreed, adjudicated, or unresolved."""
    (la, ca), (lb, cb), (lj, cj) = (human_label(F.col(c)) for c in (a, b, adjudicator))
    agreed = F.coalesce(la == lb, F.lit(False))
    status = F.when(agreed, "agreed").when(lj.isNotNull(), "adjudicated").otherwise("unresolved")
    return df.withColumns({"consensus": F.when(agreed, la).otherwise(lj), "consensus_critical": F.when(agreed, ca & cb).otherwise(cj), "status": status})


def disagreement_list(df: DataFrame, a: str = "rating_a", b: str = "rating_b") -> DataFrame:
    """Items for the adjudicator, blinded: labels differ, or only one rater gave one."""
    (la, _), (lb, _) = human_label(F.col(a)), human_label(F.col(b))
    return df.where(~la.eqNullSafe(lb)).select("item_id")


def source_mismatches(sheet: DataFrame, key: DataFrame, column: str) -> DataFrame:
    """Items of a sheet whose source differs from the key's, or that the key doesn't know."""
    k = key.select("item_id", F.col(column).alias("_key"))
    return sheet.join(k, "item_id", "left").where(~F.col(column).eqNullSafe(F.col("_key"))).select("item_id")


def validation_frame(human: DataFrame, automatic: DataFrame, on_missing: str = "mark") -> DataFrame:
    """Every human row with its automatic label; rows without one are marked, or raise. The row count never changes."""
    assert_unique(automatic, ["item_id"], "automatic labels")
    out = human.join(automatic, "item_id", "left").withColumn("has_automated_label", F.col("auto_label").isNotNull())
    if on_missing == "raise" and out.where("not has_automated_label").limit(1).count():
        raise ValueError("items without an automatic label")
    return out


def agreement(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """n, percent agreement and kappa of two label columns, items with both, by any keys; one aggregation."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    marg = [F.count_if(F.col(x) == c).alias(f"_{i}_{c}") for i, x in enumerate((a, b)) for c in CLASSES]
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("_same"), *marg)
    po = share(F.col("_same"), F.col("n"))
    pe = sum((share(F.col(f"_0_{c}"), F.col("n")) * share(F.col(f"_1_{c}"), F.col("n")) for c in CLASSES), F.lit(0.0))
    return n.select(*by, "n", po.alias("agreement"), kappa(po, pe).alias("kappa"))


def class_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa of each class against the rest: rows (class, n, kappa) from one scan."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = [F.count_if(c).alias(f"{k}_{n}") for k in CLASSES for n, c in (("a", F.col(a) == k), ("b", F.col(b) == k), ("ab", (F.col(a) == k) & (F.col(b) == k)))]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *cells)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), *[F.col(f"{k}_{x}").alias(x) for x in ("a", "b", "ab")]) for k in CLASSES]))
    t = one.select("n", each.alias("_c")).select("n", "_c.*")
    pa, pb, pab = (share(F.col(x), F.col("n")) for x in ("a", "b", "ab"))
    return t.select("class", "n", kappa(1 - pa - pb + 2 * pab, pa * pb + (1 - pa) * (1 - pb)).alias("kappa"))


def confusion(df: DataFrame, human: str, auto: str, *by: str, weight: str | None = None) -> DataFrame:
    """Human x automatic counts (or summed weights), every cell of the class grid present; labels outside the classes raise."""
    for c in (human, auto):
        assert_domain(df, c, CLASSES, "confusion")
    if weight:
        assert_weights(df, weight, "confusion")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = [F.sum(F.when((F.col(human) == h) & (F.col(auto) == a), w).otherwise(0.0)).alias(f"{h}__{a}") for h in CLASSES for a in CLASSES]
    wide = df.groupBy(*by).agg(*cells)
    each = F.array(*[F.struct(F.lit(h).alias("human"), F.lit(a).alias("auto"), F.col(f"{h}__{a}").alias("weight")) for h in CLASSES for a in CLASSES])
    return wide.select(*by, F.explode(each).alias("_c")).select(*by, "_c.*")


def class_metrics(df: DataFrame, human: str, auto: str, *by: str, weight: str | None = None) -> DataFrame:
    """One-versus-rest metrics per class; a zero denominator gives 0. Strata keep the whole class list."""
    cells = confusion(df, human, auto, *by, weight=weight)
    each = F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class")
    t = cells.select("*", each)
    h, a = F.col("human") == F.col("class"), F.col("auto") == F.col("class")
    s = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0))
    n = t.groupBy(*by, "class").agg(s(h & a).alias("tp"), s(h & ~a).alias("fn"), s(~h & a).alias("fp"), s(~h & ~a).alias("tn"))
    safe = lambda p, q: F.coalesce(F.try_divide(p, q), F.lit(0.0))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return n.select(
        *by, "class", safe(tp, tp + fn).alias("sensitivity"), safe(tn, tn + fp).alias("specificity"), safe(tp, tp + fp).alias("ppv"), safe(tn, tn + fn).alias("npv"),
        safe(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"),
    )


def macro_f1(df: DataFrame, human: str, auto: str, weight: str | None = None) -> DataFrame:
    m = class_metrics(df, human, auto, weight=weight)
    return m.agg(F.avg("f1").alias("macro_f1"), share(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def stratified_diagnostics(df: DataFrame, by: str, human: str = "human", auto: str = "auto") -> DataFrame:
    """Agreement, kappa and a small-stratum flag by corpus, cer_band or model."""
    if by not in ("corpus", "cer_band", "model"):
        raise ValueError(f"unknown stratum {by!r}")
    if by == "cer_band":
        df = df.withColumn("cer_band", F.when(F.col("cer_target") <= LOW_RATE_BAND, "low").otherwise("high"))
    return agreement(df, human, auto, by).withColumn("small_stratum", F.col("n") < SMALL_STRATUM)


def solve_prevalence(auto: np.ndarray, cells: np.ndarray) -> dict:
    """True class shares from automatic counts and the human x automatic matrix: solve, clip, renormalise; what fell back is told."""
    k = len(CLASSES)
    rows = cells.sum(1)
    m = np.where(rows[:, None] > 0, cells / np.where(rows > 0, rows, 1)[:, None], np.eye(k))
    q = auto / auto.sum() if auto.sum() > 0 else np.zeros(k)
    try:
        p, singular = np.linalg.solve(m.T, q), False
    except np.linalg.LinAlgError:
        p, singular = np.linalg.lstsq(m.T, q, rcond=None)[0], True
    kept = np.clip(p, 0, None)
    shares = kept / kept.sum() if kept.sum() > 0 else np.full(k, 1 / k)
    return {"naive": q, "corrected": shares, "clipped": bool((p < 0).any()), "singular": singular, "identity_rows": [c for c, r in zip(CLASSES, rows, strict=True) if r <= 0]}


def matrix_of(cells: DataFrame) -> np.ndarray:
    m = np.zeros((len(CLASSES), len(CLASSES)))
    for r in cells.collect():
        m[CLASSES.index(r["human"]), CLASSES.index(r["auto"])] = r["weight"]
    return m


def corrected_prevalence(cohort: DataFrame, validated: DataFrame, by: str | None = None, weight: str | None = None, pooled_only: bool = False) -> DataFrame:
    """Naive and corrected class shares of the cohort, overall or by a key.

    ``pooled_only`` uses the pooled matrix for every key, as the first panel analysis did. Else, by key, a stratum's own matrix
    serves where it has :data:`SMALL_STRATUM` items and every human class, else the pooled one. Only class counts (nine per stratum) reach the driver.
    """
    spark = cohort.sparkSession
    pooled = matrix_of(confusion(validated, "human", "auto", weight=weight))
    keys = [by] if by else []
    counts = cohort.groupBy(*keys).agg(*[F.count_if(F.col("auto_label") == c).alias(c) for c in CLASSES]).collect()
    own = {}
    if by:
        sizes = {r[by]: r["n"] for r in validated.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
        for r in confusion(validated, "human", "auto", by, weight=weight).collect():
            own.setdefault(r[by], np.zeros((3, 3)))[CLASSES.index(r["human"]), CLASSES.index(r["auto"])] = r["weight"]
        own = {} if pooled_only else {k: m for k, m in own.items() if sizes.get(k, 0) >= SMALL_STRATUM and (m.sum(1) > 0).all()}
    rows = []
    for r in counts:
        key = r[by] if by else "all"
        got = solve_prevalence(np.array([r[c] for c in CLASSES], dtype=float), own.get(key, pooled))
        rows += [(str(key), c, float(got["naive"][i]), float(got["corrected"][i]), "own" if key in own else "pooled", got["clipped"], got["singular"]) for i, c in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "stratum string, class string, naive double, corrected double, matrix string, clipped boolean, singular boolean")


def unique_sheet(sheets: list[DataFrame]) -> DataFrame:
    """Several rating sheets as one; an item id that occurs twice raises."""
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return assert_unique(out, ["item_id"], "rating sheets")


def rater_pool(rater_a: DataFrame, rater_b: DataFrame, key: DataFrame) -> DataFrame:
    """Items that both raters have, with their mapped classes, the texts of the first sheet and the key's provenance where there is any."""
    a = rater_a.select("item_id", human_label(F.col("rating"))[0].alias("class_a"), *[c for c in rater_a.columns if c not in ("item_id", "rating")])
    b = rater_b.select("item_id", human_label(F.col("rating"))[0].alias("class_b"))
    return assert_unique(a, ["item_id"], "first rater").join(assert_unique(b, ["item_id"], "second rater"), "item_id").join(key, "item_id", "left")


def agreed_only(pool: DataFrame) -> DataFrame:
    """Items with one class from both raters, as ``label``."""
    return pool.where("class_a is not null and class_a = class_b").withColumn("label", F.col("class_a"))
