"""The composed run writes what its blocks say, remembers their hashes, and skips what it has no input for."""
import pytest
from pyspark.sql import functions as F

from emberlane.functions import tables
from emberlane.operators import digests, glm, inference
from emberlane.plans.modelling import _covariates
from emberlane.plans.relational import _zero
from emberlane.plans.registry import view
from emberlane.sources import io

SF = "/root/testdata/sf0.001"


def test_digests_read_back_and_log(spark, tmp_path):
    a, signals = view(spark, SF, "fx_attempts"), view(spark, SF, "fx_signals")
    hashes = digests.compose(a, None, _zero(signals), _covariates(), str(tmp_path), draws=20)
    assert set(hashes) == {"benefit_harm", "drift_curve", "zero_cer_audit", "calibration", "mixed_model", "multinomial", "confidence", "dependence_sensitivity"}
    curve = digests.read_section(spark, str(tmp_path), "drift_curve")
    want = {r["x"]: (r["n"], r["k"]) for r in a.groupBy(F.round("cer_target", 1).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "drift").alias("k")).collect()}
    assert {r["cer_target"]: (r["n"], r["n_drift"]) for r in curve["overall"]} == want
    stats = digests.read_section(spark, str(tmp_path), "stats")
    assert stats["benefit_harm"]["skipped"] and stats["_meta"]["n_rows"] == a.count() and stats["drift_curve"] == curve
    verdict = stats["dependence_sensitivity"]["stability"]
    assert set(verdict["holds_anchor"]) <= {"per_model_pooled", "gee", "bootstrap_message", "bootstrap_model"} and isinstance(verdict["stable"], bool)
    assert all(digests.unchanged(spark, str(tmp_path)).values())
    io.write_text(spark, "{}", f"{tmp_path}/calibration.json")
    assert [s for s, ok in digests.unchanged(spark, str(tmp_path)).items() if not ok] == ["calibration"]


def test_table_function_in_sql(spark):
    tables.register(spark)
    rows = [(1, "go", ["stop", " go ", None, "  "]), (2, None, ["x"]), (3, "y", None), (4, "z", [])]
    df = spark.createDataFrame(rows, "id long, intended string, candidates array<string>")
    got = spark.sql("SELECT id, c.* FROM {df}, LATERAL candidate_rows(intended, candidates) c", df=df).collect()
    assert sorted((r["id"], r["place"], r["candidate"], r["faithful"]) for r in got) == [(1, 1, "stop", False), (1, 2, " go ", True), (2, 1, "x", False)]


FITS = {
    "slopes": lambda t, xs, n: [tuple(r) for r in inference.model_slopes(t, weight=n).orderBy("model").collect()],
    "gee": lambda t, xs, n: [tuple(map(float, v)) for k, v in glm.gee_exchangeable(t, (F.col("label") == "drift").cast("double"), {"one": F.lit(1.0), "x": F.col("realized_cer")}, "message_id", 1, n).items() if k in ("beta", "se")],
    "multinomial": lambda t, xs, n: [tuple(r) for r in inference.multinomial_model(t, xs, n).collect()],
}


@pytest.mark.parametrize("name", FITS)
def test_fits_of_counted_patterns_are_those_of_their_rows(spark, name):
    xs = {"realized_cer": F.col("realized_cer")}
    a = view(spark, SF, "fx_attempts").select("model", "message_id", "realized_cer", "label", F.col("realized_cer").alias("_x0")).coalesce(1).persist()
    t = digests.patterns(a.unionByName(a), ["_x0"]).coalesce(1).persist()
    assert t.count() < 2 * a.count() == t.agg(F.sum("_rows")).first()[0]
    for x, y in zip(FITS[name](a.unionByName(a), xs, None), FITS[name](t, {"realized_cer": F.col("_x0")}, F.col("_rows")), strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and (abs(u - v) <= 1e-6 * max(1.0, abs(u)) or (u != u and v != v)))
    a.unpersist()
    t.unpersist()
