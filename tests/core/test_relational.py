"""Every registered query with SQL against DuckDB on the driver's tables, and hand-made edge cases."""
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane import contracts as ct
from emberlane.fixtures import view
from emberlane.functions import text as tx
from emberlane.operators import agreement as ag
from emberlane.operators import calibration as cal
from emberlane.operators import label as lb
from emberlane.operators import rates, sampling, transitions
from emberlane.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _rows(df, cols):
    clean = df[cols].astype(object).where(df[cols].notna(), None)
    return clean.astype(str).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLE[name]).df()
    cols = sorted(ours.columns)
    assert sorted(theirs.columns) == cols
    a, b = _rows(ours, cols), _rows(theirs, cols)
    assert len(a) == len(b) and a.equals(b), a.compare(b).head() if len(a) == len(b) else (len(a), len(b))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_probe_set_runs_over_all_turns(spark):
    rows = registry.QUERIES["probe_set"](spark, DATA).collect()
    turns = view(spark, DATA, "conversations").count()
    assert sum(r["drift_type"] is None for r in rows) == turns and len({r["message_id"] for r in rows}) == len(rows)


def test_probe_ids_stay_apart_beyond_four_digits(spark):
    from emberlane.operators import corpus

    ids = [r["message_id"] for r in corpus.probe_set(spark.range(10_002).select(F.col("id").alias("seed_id"), F.lit("all is well").alias("text"))).select("message_id").collect()]
    assert len(set(ids)) == 10_002 and {"probe_0000", "probe_10001"} <= set(ids)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("name", ["cer_text", "normalise_text", "sentence_form", "clean_examples", "critical_flags_lexical", "changed_words"])
def test_text_pairs_of_any_script_are_read(spark, duck, name):
    n = duck.sql("SELECT count(*) FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'").fetchall()[0][0]
    assert registry.QUERIES[name](spark, DATA).count() == n


def test_edit_rates_of_any_script_against_brute_force(spark):
    texts = {(r["conv_id"], r["turn"]): (r["intended_text"], r["output_message"]) for r in view(spark, DATA, "fx_reply_pairs").collect()}
    wide = {k: (a, b) for k, (a, b) in texts.items() if not (a + b).isascii()}
    out = {(r["conv_id"], r["turn"]): (r["cer"], r["ned"]) for r in registry.QUERIES["cer_text"](spark, DATA).collect()}
    assert wide and out.keys() == texts.keys()
    for k, (a, b) in wide.items():
        ta, tb = (x.strip(" ").upper() for x in (a, b))
        want = (_distance(a, b) / len(a) if a else 0.0, _distance(ta, tb) / max(len(ta), len(tb), 1))
        assert out[k] == pytest.approx(want, abs=1e-8)


def one(df):
    return df.first().asDict()


def test_confidently_wrong_denominators(spark):
    df = spark.createDataFrame([("a", "faithful", 50.0), ("a", "faithful", None), ("b", "drift", 95.0)], "model string, label string, confidence double")
    out = {r["model"]: r for r in rates.confidently_wrong(df).collect()}
    assert out["a"]["frac_drift_at_high_confidence"] is None and out["a"]["n"] == 1
    assert out["b"]["frac_drift_at_high_confidence"] == 1.0 and out["pooled"]["confidently_wrong_rate"] == 1.0


def test_critical_level_is_strict(spark):
    rows = [("CRIT", 0.1, "drift" if i < 1 else "faithful") for i in range(100)] + [("CRIT", 0.2, "drift" if i < 2 else "faithful") for i in range(100)]
    df = spark.createDataFrame(rows, "corpus string, cer_target double, label string")
    assert one(rates.critical_level(df))["critical_level"] == 0.2
    assert one(rates.critical_level(df, 0.5))["critical_level"] is None


def test_net_metric_edges(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 0, 0), (1, 1, 1)], "r int, h int, s int")
    got = [r[0] for r in df.select(transitions.net_metric(F.col("r"), F.col("h"), F.col("s"))).collect()]
    assert got == [math.inf, None, 0.5]


def test_votes_and_ties(spark):
    base = {"nli_deberta_fwd": "entail", "nli_deberta_bwd": "entail", "nli_roberta_fwd": "contradict", "nli_roberta_bwd": "entail", "cos_mpnet": 0.9, "cos_minilm": 0.9, "fluency_raw": 0.5}
    base |= dict.fromkeys(("crit_negation_flip", "crit_numeral_change", "crit_recipient_change", "crit_urgency_change", "crit_actionable_omission"), False)
    df = spark.createDataFrame([base])
    got = {p: one(lb.ensemble(df, p)) for p in lb.POLICIES}
    assert {p: r["label"] for p, r in got.items()} == {"primary": "faithful", "drift_averse": "faithful", "severity": "drift"}
    assert got["primary"]["agreement"] == 0.5 and got["primary"]["tie"] and got["primary"]["tied_labels"] == "drift|faithful"
    with pytest.raises(ValueError, match="unknown policy"):
        lb.ensemble(df, "other")


def test_kappa_is_null_for_one_class(spark):
    df = spark.createDataFrame([("drift", "drift")] * 3, "a string, b string")
    assert one(ag.agreement(df, "a", "b"))["kappa"] is None and one(ag.agreement(df, "a", "b"))["agreement"] == 1.0


def test_class_metrics_zero_denominators(spark):
    df = spark.createDataFrame([("faithful", "faithful"), ("degraded", "faithful")], "h string, a string")
    got = {r["class"]: r for r in ag.class_metrics(df, "h", "a").collect()}
    assert got["drift"]["sensitivity"] == 0.0 and got["degraded"]["ppv"] == 0.0 and got["faithful"]["ppv"] == 0.5
    with pytest.raises(ct.ContractError, match="outside"):
        ag.confusion(df.withColumn("h", F.lit("odd")), "h", "a")


def test_prevalence_solves_and_falls_back():
    m = np.array([[8.0, 1, 1], [1, 8, 1], [1, 1, 8]])
    true = np.array([0.5, 0.3, 0.2])
    got = ag.solve_prevalence(m.T @ true / 10 * 1000, m)
    assert np.allclose(got["corrected"], true) and not got["clipped"]
    assert ag.solve_prevalence(np.array([1.0, 0, 0]), np.zeros((3, 3)))["identity_rows"] == ["faithful", "degraded", "drift"]
    assert ag.solve_prevalence(np.array([1.0, 1, 1]), np.ones((3, 3)))["singular"]


def test_auroc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (0.9, True)], "s double, y boolean")
    assert one(cal.auroc(df, "s", "y"))["auroc"] == pytest.approx(0.875)
    assert one(cal.auroc(df.where("y"), "s", "y"))["auroc"] is None


def test_bins_at_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.29, 0.3, 1.0)], "s double")
    assert [tuple(r) for r in df.select(cal.left_closed(F.col("s")), cal.right_closed(F.col("s"))).collect()] == [(0, 0), (1, 0), (2, 2), (3, 2), (9, 9)]


def test_random_effects_edges(spark):
    df = spark.createDataFrame([(0.3, 0.2, 0.4)], "y double, lo double, hi double")
    got = one(cal.random_effects(df, "y", "lo", "hi"))
    assert got["pooled"] == pytest.approx(0.3) and got["tau2"] == 0 and got["k"] == 1


def test_hamilton_bounds(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "g string, size long")
    assert {r["g"]: r["alloc"] for r in sampling.hamilton(df, "g", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    assert min(r["alloc"] for r in sampling.hamilton_with_floor(df, "g", 3).collect()) == 1
    with pytest.raises(ValueError, match="units"):
        sampling.hamilton_with_floor(df, "g", 2)


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ct.ContractError, match="missing"):
        ct.require_columns(df, ["x"], "t")
    with pytest.raises(ct.ContractError, match="repeats"):
        ct.merge_checked(df, df.withColumnRenamed("v", "w"), ["k"])
    with pytest.raises(ct.ContractError, match="without a partner"):
        ct.merge_checked(df, spark.createDataFrame([(2, "z")], "k int, w string"), ["k"], unmatched="raise")
    with pytest.raises(ct.ContractError, match="nulls"):
        ct.assert_no_nulls(spark.createDataFrame([(None,), (float("nan"),)], "x double"), ["x"], "t")


def test_reply_and_candidates(spark):
    raw = ['{"message": "hi", "confidence": "x"}', "plain ", None, '{"message": " STOP "}', '{"candidates": ["a", ""]}', 'x "candidates": ["b", "c"] {']
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(tx.parse_reply(F.col("raw"), "STOP").alias("r"), tx.parse_candidates(F.col("raw")).alias("c"))
    got = df.collect()
    assert [(r["r"]["output_message"], r["r"]["confidence"], r["r"]["abstained"]) for r in got[:4]] == [("hi", None, False), ("plain", None, False), ("", None, False), (" STOP ", None, True)]
    assert got[4]["c"] == ["a"] and got[5]["c"] == ["b", "c"] and got[0]["c"] is None


def test_corruption_flags(spark):
    df = spark.createDataFrame([("I do not want 5 pills", [5, 6]), ("I do not want 5 pills", [14]), ("abc", []), ("abc", None)], "t string, p array<int>")
    got = [tuple(r[0]) for r in df.select(tx.corruption_flags("t", "p")).collect()]
    assert got == [(0, True, False), (0, False, True), (0, False, False), (0, False, False)]


def test_fixture_views_have_unique_keys(spark):
    raw = view(spark, DATA, "fx_raw")
    ct.assert_unique(raw, ["message_id", "corpus", "cer_target", "replicate_idx"], "fx_raw")


def test_noise_deals_messages_before_multiplying_them(spark):
    """What is shuffled is a message once, not once for each rate and replicate."""
    from emberlane.operators import noise

    df = spark.createDataFrame([(f"m{i}", "AUTH", "HELLO") for i in range(4)], "message_id string, corpus string, text string")
    out = noise.exposure(df, np.eye(len(noise.ALPHABET)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and "Generate" not in plan.split("Repartition", 1)[1]


def test_off_grid_summary_reads_texts_once(spark):
    from emberlane.operators import noise

    seen = spark.sparkContext.accumulator(0)

    def read(i):
        seen.add(1)
        return "A" * i + "?" * (i % 3)

    df = spark.range(1, 31).select(F.udf(read, "string")("id").alias("text"))
    got = noise.off_grid_summary(df).first()
    shares = [(i % 3) / (i + i % 3) for i in range(1, 31)]
    assert got["n"] == 30 and got["mean"] == pytest.approx(np.mean(shares)) and got["median"] == pytest.approx(np.median(shares))
    assert seen.value == 30


def test_words_are_counted_as_texts_are_read_once(spark):
    from pyspark.sql import functions as F

    from emberlane.operators import corpus

    seen = spark.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return x

    docs = spark.createDataFrame([(1, "The the cat"), (2, "a cat's 12"), (3, None), (4, "")], "doc_id long, text string")
    passing = docs.withColumn("text", F.udf(one, "string")("text"))
    got = {r["doc_id"]: r["mean_word_freq"] for r in corpus.mean_word_frequency(passing, "doc_id", "text").collect()}
    given = corpus.mean_word_frequency(docs, "doc_id", "text", corpus.word_frequencies(docs, "text")).collect()
    assert got == {r["doc_id"]: r["mean_word_freq"] for r in given} and got[3] == got[4] == 0 and seen.value == 4
