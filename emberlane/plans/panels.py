"""Queries on samples, panels, pools, examples, prompts and the fits that go with them."""
from __future__ import annotations

from pyspark.sql import functions as F

from emberlane import contracts as ct
from emberlane.functions import tables
from emberlane.functions import text as tx
from emberlane.operators import agreement as ag
from emberlane.operators import balance, corpus, glm, inference, rates
from emberlane.operators import calibration as cal
from emberlane.operators import label as lb
from emberlane.operators import ranking as rk
from emberlane.operators import sampling as sm
from emberlane.plans import fitted
from emberlane.plans.modelling import _DOUBLES, _TERM, FIT
from emberlane.plans.registry import query
from emberlane.plans.relational import _CL, _CONF, _P, _RATED, _rated
from emberlane.plans.texts import _LINES
from emberlane.schema import CLASSES

A, R, P, M = "fx_attempts", "fx_ratings", "fx_reply_pairs", "fx_matched"


def _share(src: str, keys: str, n: str, size: str, by: str, key: str, extra: int = 0) -> str:
    """Largest-remainder shares ``k`` of ``n`` by ``size`` among the rows of ``src``, within ``by``."""
    over = f"PARTITION BY {by}" if by else ""
    ranked = f"SELECT *, floor(q)::BIGINT AS f, row_number() OVER ({over} ORDER BY q - floor(q) DESC, {key}) AS place FROM (SELECT *, {n} AS units, {n} * {size} / sum({size}) OVER ({over}) AS q FROM {src})"
    return f"SELECT {keys}, {extra} + f + (place <= units - sum(f) OVER ({over}))::INT AS k FROM ({ranked})"


@query("two_stage_sample", "documents", sql=f"""
    WITH d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
         e AS (SELECT list_sort(list_distinct(quantile_cont(length(text)::DOUBLE, [0, 1.0 / 3, 2.0 / 3, 1]))) AS e FROM d),
         b AS (SELECT doc_id, source, CASE WHEN len(e) <= 2 THEN 'short' WHEN len(e) = 3 THEN CASE WHEN length(text) <= e[2] THEN 'short' ELSE 'long' END WHEN length(text) <= e[2] THEN 'short' WHEN length(text) <= e[3] THEN 'medium' ELSE 'long' END AS length_bin FROM d, e),
         a AS ({_share('(SELECT source, count(*)::DOUBLE AS size FROM b GROUP BY source)', 'source', '60', 'size', '', 'source')}),
         h AS ({_share('(SELECT source, length_bin, size, a.k AS total FROM (SELECT source, length_bin, count(*)::DOUBLE AS size FROM b GROUP BY ALL) JOIN a USING (source))', 'source, length_bin', 'total', 'size', 'source', 'length_bin')})
    SELECT source, length_bin, doc_id FROM b JOIN h USING (source, length_bin) QUALIFY row_number() OVER (PARTITION BY source, length_bin ORDER BY sha256(concat_ws('|', '19', doc_id::VARCHAR)), doc_id) <= k""")
def _(d): return sm.two_stage_sample(d.where("text is not null"), "source", "text", 60, "19", "doc_id").select("source", "length_bin", "doc_id")  # noqa: E704


_CANDIDATES = f"""(WITH t AS (SELECT pair_id, critical, round(cer_target, 1) AS cer_target, label, row_number() OVER (PARTITION BY pair_id, critical, round(cer_target, 1) ORDER BY replicate_idx, model, label) AS r FROM {M})
    SELECT c.pair_id, c.cer_target, c.label AS crit_label, o.label AS ctrl_label FROM t c JOIN t o ON c.pair_id = o.pair_id AND c.cer_target = o.cer_target AND c.critical = 1 AND o.critical = 0 AND c.r = 1 AND o.r = 1)"""


@query("pair_draw_items", A, "fx_pairs", doubles="cer_target", sql=f"""
    WITH q AS (SELECT greatest(1, 30 // count(DISTINCT cer_target)) AS k FROM {_CANDIDATES}),
         d AS (SELECT * FROM {_CANDIDATES}, q QUALIFY row_number() OVER (PARTITION BY cer_target ORDER BY sha256(concat_ws('|', '29', pair_id)), pair_id) <= k)
    SELECT pair_id, cer_target, corpus, CASE corpus WHEN 'CRIT' THEN crit_label ELSE ctrl_label END AS automated_label FROM d, (SELECT unnest(['CRIT', 'CTRL']) AS corpus)""")
def _(a, p): return sm.pair_items(sm.equal_quota_sample(balance.pair_candidates(a, p), "cer_target", 30, "29", "pair_id"))  # noqa: E704


_SUB = "(SELECT message_id, corpus, round(cer_target, 1) AS cer_target, replicate_idx, CASE WHEN length(message_id) < 6 THEN 'short' ELSE 'long' END AS category FROM fx_attempts)"


@query("substudy_exposures", A, doubles="cer_target", sql=f"""
    WITH r AS (SELECT DISTINCT message_id FROM {A} WHERE corpus IN ('CRIT', 'CTRL')), m AS (SELECT message_id, min(category) AS category FROM {_SUB} WHERE corpus = 'AUTH' AND message_id NOT IN (SELECT message_id FROM r) GROUP BY 1),
         k AS ({_share('(SELECT category, count(*) AS size FROM m GROUP BY 1)', 'category', '(40 - (SELECT count(DISTINCT category) FROM m))', '(size - 1)::DOUBLE', '', 'category', 1)}), c AS (SELECT message_id FROM m JOIN k USING (category) QUALIFY row_number() OVER (PARTITION BY category ORDER BY sha256(concat_ws('|', '31', message_id)), message_id) <= k)
    SELECT message_id, corpus, cer_target, replicate_idx, count(*) AS n FROM {_SUB} WHERE replicate_idx < 4 AND (corpus IN ('CRIT', 'CTRL') OR message_id IN (SELECT message_id FROM c)) GROUP BY ALL""")
def _(a):
    t = a.select("message_id", "corpus", F.round("cer_target", 1).alias("cer_target"), "replicate_idx", F.when(F.length("message_id") < 6, "short").otherwise("long").alias("category"))
    probes = t.where("corpus in ('CRIT', 'CTRL')")
    rows = sm.substudy_rows(t.where("corpus = 'AUTH'"), probes, probes, 40, "31", "category", 4)
    return rows.groupBy("message_id", "corpus", "cer_target", "replicate_idx").agg(F.count(F.lit(1)).alias("n"))


def _pool(r):
    a = r.select("item_id", F.col("rating_a").alias("rating"), F.concat(F.lit("say "), "item_id", F.lit(" now")).alias("intended_text"))
    return ag.rater_pool(a, r.where("corpus != 'CTRL'").select("item_id", F.col("rating_b").alias("rating")), r.where("corpus = 'CRIT'").select("item_id", "corpus", (F.col("sampling_weight") / 10).alias("realized_cer")))


_POOL = f"(SELECT r.item_id, la AS class_a, lb AS class_b, concat('say ', r.item_id, ' now') AS intended_text, CASE WHEN corpus = 'CRIT' THEN corpus END AS corpus, CASE WHEN corpus = 'CRIT' THEN sampling_weight / 10 END AS realized_cer FROM {_RATED} r WHERE corpus <> 'CTRL')"


@query("rater_pool", R, doubles="realized_cer", sql=f"SELECT * FROM {_POOL}")
def _(r): return _pool(r)  # noqa: E704


_CLEAN = f"(SELECT class_a AS label, item_id, realized_cer AS x FROM {_POOL} WHERE class_a = class_b AND realized_cer IS NOT NULL AND length(intended_text) BETWEEN 10 AND 80)"


@query("validated_examples", R, sql=f"""
    WITH c AS (SELECT * FROM {_CLEAN}), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(x - 0.2), item_id) AS r FROM c WHERE label <> 'drift'), n1 AS (SELECT label, 0 AS place, item_id FROM n WHERE r = 1),
         m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(x - 0.3), item_id) AS r FROM c WHERE label <> 'drift' AND item_id NOT IN (SELECT item_id FROM n1)), d AS (SELECT * FROM c WHERE label = 'drift'),
         d1 AS (SELECT label, 0 AS place, item_id FROM d ORDER BY x, item_id LIMIT 1), d2 AS (SELECT label, 1 AS place, item_id FROM d WHERE item_id NOT IN (SELECT item_id FROM d1) ORDER BY x DESC, item_id LIMIT 1)
    SELECT * FROM n1 UNION ALL SELECT label, 1, item_id FROM m WHERE r = 1 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2""")
def _(r):
    t = ag.agreed_only(_pool(r)).where("realized_cer is not null")
    return rk.validated_examples(t, "intended_text", "realized_cer", 2, (0.2, 0.3))


_BANK = [("repair", "Return only the corrected sentence."), ("complete", "Return only the completed sentence.")]


@query("built_prompts", P, sql=f"""
    SELECT conv_id, turn, depth, CASE depth {' '.join(f"WHEN '{n}' THEN '{s}'" for n, s in _BANK)} END AS system, concat('Input: ', intended_text, chr(10), 'Output:', chr(10), 'Confidence: N') AS "user"
    FROM (SELECT *, CASE WHEN turn % 4 < 2 THEN 'repair' ELSE 'complete' END AS depth FROM {P})""")
def _(p):
    bank = p.sparkSession.createDataFrame(_BANK, "name string, system string")
    rows = p.withColumn("depth", F.when(F.col("turn") % 4 < 2, "repair").otherwise("complete"))
    return tx.prompts(rows, bank, "depth", F.col("intended_text"), "\nConfidence: N").select("conv_id", "turn", "depth", "system", "user")


def _refused(what) -> bool:  # noqa: ANN001
    try:
        what().count()
    except ValueError:
        return True
    return False


@query("refusals", A, P, sql="SELECT * FROM (VALUES ('unknown_prompt', true), ('score_null', true), ('score_above_one', true), ('score_fine', false), ('too_many_units', true)) AS t(case_name, refused)")
def _(a, p):
    spark = a.sparkSession
    bank = spark.createDataFrame(_BANK, "name string, system string")
    scores = a.select((F.col("confidence") / 100).alias("s"), (F.col("label") == "faithful").alias("hit"))
    sizes = a.groupBy("model").agg(F.count(F.lit(1)).alias("size"))
    cases = {
        "unknown_prompt": lambda: tx.prompts(p.withColumn("depth", F.lit("nope")), bank, "depth", F.col("intended_text"), ""),
        "score_null": lambda: cal.expected_error(scores, "s", "hit"), "score_above_one": lambda: cal.expected_error(scores.select((F.col("s") * 100).alias("s"), "hit").where("s is not null"), "s", "hit"),
        "score_fine": lambda: cal.expected_error(scores.where("s is not null"), "s", "hit"), "too_many_units": lambda: sm.hamilton_with_floor(sizes, "model", 10**12),
    }
    return spark.createDataFrame([(k, _refused(f)) for k, f in cases.items()], "case_name string, refused boolean")


@query("expected_error_checked", A, doubles="ece", sql=f"""
    SELECT sum(n * abs(y - c)) / sum(n) AS ece, sum(n)::BIGINT AS n FROM (SELECT least(9, floor(s * 10 + 1e-9)) AS b, avg(s) AS c, avg(hit::INT::DOUBLE) AS y, count(*)::DOUBLE AS n FROM (SELECT confidence / 100 AS s, label = 'faithful' AS hit FROM {A} WHERE confidence IS NOT NULL) GROUP BY 1)""")
def _(a): return cal.expected_error(a.where("confidence is not null").select((F.col("confidence") / 100).alias("s"), (F.col("label") == "faithful").alias("hit")), "s", "hit")  # noqa: E704


def _prevalence_sql(by: str, w: str, own: str) -> str:
    """Corrected shares by Cramer's rule for each corpus, from its own matrix where ``own`` says so, else from the pooled one."""
    cells = lambda src: ", ".join(f"sum(weight) FILTER (human = '{h}' AND auto = '{a}') / sum(weight) FILTER (human = '{h}') AS m{i + 1}{j + 1}" for i, h in enumerate(_CL) for j, a in enumerate(_CL)) + f" FROM {src}"
    return f"""WITH pooled AS (SELECT {cells(_CONF.format(by='', w=w))}), each AS (SELECT corpus, {cells(_CONF.format(by='corpus,', w=w))} GROUP BY corpus),
        big AS (SELECT corpus FROM {_RATED} GROUP BY corpus HAVING {own}),
        m AS (SELECT corpus, 'own' AS matrix, * EXCLUDE (corpus) FROM each WHERE corpus IN (SELECT corpus FROM big) UNION ALL SELECT corpus, 'pooled', pooled.* FROM (SELECT DISTINCT corpus FROM {R} WHERE corpus NOT IN (SELECT corpus FROM big)), pooled),
        q AS (SELECT corpus, {', '.join(f"avg((auto_label = '{a}')::INT::DOUBLE) AS q{j + 1}" for j, a in enumerate(_CL))} FROM {R} GROUP BY corpus), p AS (SELECT *, {', '.join(f'{e} AS p{i + 1}' for i, e in enumerate(_P))} FROM m JOIN q USING (corpus))
    SELECT corpus AS stratum, class, naive, corrected, matrix, clipped, false AS singular FROM ({' UNION ALL '.join(f"SELECT corpus, matrix, '{c}' AS class, q{i + 1} AS naive, p{i + 1} / (p1 + p2 + p3) AS corrected, least(p1, p2, p3) <= 0 AS clipped FROM p" for i, c in enumerate(_CL))})"""


@query("corrected_prevalence_by_corpus", R, doubles="naive corrected", sql=_prevalence_sql("corpus", "sampling_weight", "count(*) FILTER (la IS NOT NULL) >= 30 AND count(DISTINCT la) = 3"))
def _(r): return ag.corrected_prevalence(r, _rated(r), by="corpus", weight="sampling_weight")  # noqa: E704


@query("corrected_prevalence_first_layout", R, doubles="naive corrected", sql=_prevalence_sql("corpus", "1.0", "false"))
def _(r): return ag.corrected_prevalence(r, _rated(r), by="corpus", pooled_only=True)  # noqa: E704


_NUMBER = "substr(model, 2)::INT"
_PRESCRIBED = ["intercept", "realized_cer", "corrupted_numeral", "corrupted_negation", "char_len", "family_b", "family_c"]


@query("multinomial_prescribed", M, doubles=_DOUBLES, digits=FIT, sql=f"""{fitted.multinomial(M, "label", CLASSES, ["1.0", "realized_cer", "corrupted_numeral", "corrupted_negation", "char_len / 100", f"({_NUMBER} % 3 = 1)::INT", f"({_NUMBER} % 3 = 2)::INT"])}
    SELECT {_TERM}, true AS converged FROM {fitted.table([f"{c}:{t}" for c in CLASSES[1:] for t in _PRESCRIBED])} t""")
def _(m):
    number = F.substring("model", 2, 9).cast("int") % 3
    xs = {"realized_cer": F.col("realized_cer"), "corrupted_numeral": F.col("corrupted_numeral"), "corrupted_negation": F.col("corrupted_negation"), "char_len": F.col("char_len") / 100, "family_b": (number == 1).cast("double"), "family_c": (number == 2).cast("double")}
    return inference.multinomial_model(m, xs)


_CELLS = f"(SELECT message_id AS g, realized_cer AS x, (label = 'drift')::INT::DOUBLE AS y, count(*)::DOUBLE AS w FROM {A} GROUP BY ALL)"
_POINT = """(SELECT g, step, b0, b1, sum(w) AS m, sum(w * r) AS r, sum(w * r * r) AS rr, sum(w * d) AS d0, sum(w * d * x) AS d1, sum(w * d * r) AS e0, sum(w * d * x * r) AS e1, sum(w * d * d) AS v00, sum(w * d * d * x) AS v01, sum(w * d * d * x * x) AS v11
    FROM (SELECT *, sqrt(mu * (1 - mu)) AS d, (y - mu) / sqrt(mu * (1 - mu)) AS r FROM (SELECT c.*, t.step, t.b0, t.b1, 1 / (1 + exp(-(t.b0 + t.b1 * x))) AS mu FROM {src} t, cells c)) GROUP BY g, step, b0, b1)"""
_WORKING = """(SELECT *, 1 / (1 - alpha) AS a, -alpha / (1 - alpha) / (1 + (m - 1) * alpha) AS b FROM (SELECT *, greatest(-0.99, least(0.99, sum((r * r - rr) / 2) OVER () / greatest(1, sum(m * (m - 1) / 2) OVER () - 2) / (sum(rr) OVER () / greatest(1, sum(m) OVER () - 2)))) AS alpha FROM {point}))"""
_INFO = "sum(a * v00 + b * d0 * d0) AS h00, sum(a * v01 + b * d0 * d1) AS h01, sum(a * v11 + b * d1 * d1) AS h11"


@query("gee_slope", A, doubles="slope se lo hi alpha", digits=5, sql=f"""
    WITH RECURSIVE cells AS MATERIALIZED {_CELLS}, it AS (SELECT 0 AS step, -2.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 UNION ALL
        SELECT step + 1, b0 + (h11 * u0 - h01 * u1) / (h00 * h11 - h01 * h01), b1 + (h00 * u1 - h01 * u0) / (h00 * h11 - h01 * h01)
        FROM (SELECT step, b0, b1, sum(a * e0 + b * d0 * r) AS u0, sum(a * e1 + b * d1 * r) AS u1, {_INFO} FROM {_WORKING.format(point=_POINT.format(src='(SELECT * FROM it WHERE step < 40)'))} GROUP BY step, b0, b1)),
    z AS (SELECT any_value(b1) AS slope, any_value(alpha) AS alpha, count(*) AS n_groups, {_INFO}, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11
          FROM (SELECT *, a * e0 + b * d0 * r AS s0, a * e1 + b * d1 * r AS s1 FROM {_WORKING.format(point=_POINT.format(src='(SELECT * FROM it WHERE step = 40)'))})),
    f AS (SELECT slope, alpha, n_groups, sqrt(h01 * h01 * m00 - 2 * h01 * h00 * m01 + h00 * h00 * m11) / abs(h00 * h11 - h01 * h01) AS se FROM z)
    SELECT slope, se, slope - {fitted.Z} * se AS lo, slope + {fitted.Z} * se AS hi, alpha, 'exchangeable' AS cov_struct_used, n_groups FROM f""")
def _(a): return inference.gee_slope(a)  # noqa: E704


@query("mixed_drift_curve", A, digits=5)
def _(a): return inference.mixed_curve(a)  # noqa: E704


@query("example_picker", A, sql=f"""
    WITH s1 AS (SELECT message_id FROM {A} WHERE label = 'drift' AND corpus = 'CRIT' ORDER BY message_id, model, l_orderkey, l_partkey LIMIT 1),
         s2 AS (SELECT message_id FROM {A} WHERE label = 'degraded' AND corpus = 'AUTH' AND message_id NOT IN (SELECT message_id FROM s1) ORDER BY message_id, model, l_orderkey, l_partkey LIMIT 1),
         s3 AS (SELECT message_id FROM {A} WHERE label = 'drift' AND corpus = 'AUTH' AND message_id NOT IN (SELECT message_id FROM s1 UNION ALL SELECT message_id FROM s2) ORDER BY message_id, model, l_orderkey, l_partkey LIMIT 1)
    SELECT 0::BIGINT AS spec, message_id FROM s1 UNION ALL SELECT 1, message_id FROM s2 UNION ALL SELECT 2, message_id FROM s3""")
def _(a): return rk.first_per_spec(a, [{"label": "drift", "corpus": "CRIT"}, {"label": "degraded", "corpus": "AUTH"}, {"label": "drift", "corpus": "AUTH"}], ["message_id", "model", "l_orderkey", "l_partkey"])  # noqa: E704


@query("exposure_misses", A, "fx_raw", sql=f"""
    SELECT corpus, count(*) AS n, count(*) FILTER (raw_label IS NULL) AS n_without_exposure FROM {A} LEFT JOIN (SELECT message_id, corpus, cer_target, replicate_idx, raw_label FROM fx_raw WHERE replicate_idx < 3) USING (message_id, corpus, cer_target, replicate_idx) GROUP BY corpus""")
def _(a, x):
    key = ["message_id", "corpus", "cer_target", "replicate_idx"]
    return ct.merge_checked(a, x.where("replicate_idx < 3").select(*key, "raw_label"), key).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw_label").isNull()).alias("n_without_exposure"))


@query("first_layout_analysis", "fx_signals", doubles="value", sql="""
    WITH t AS (SELECT *, CASE WHEN nli_deberta_fwd = 'contradict' OR nli_deberta_bwd = 'contradict' THEN 'drift' WHEN nli_deberta_fwd = 'entail' AND nli_deberta_bwd = 'entail' THEN 'faithful' WHEN cos_mpnet >= 0.75 THEN 'faithful' ELSE 'degraded' END AS v1 FROM fx_signals)
    SELECT 'drift_rate' AS metric, round(cer_target, 1)::VARCHAR AS key, count(*) AS n, avg((v1 = 'drift')::INT::DOUBLE) AS value FROM t GROUP BY 2
    UNION ALL SELECT 'share', v1, count(*), count(*)::DOUBLE / (SELECT count(*) FROM t) FROM t GROUP BY v1
    UNION ALL SELECT 'threshold', 'CRIT', 1, min(l) FROM (SELECT round(cer_target, 1) AS l FROM t WHERE corpus = 'CRIT' GROUP BY 1 HAVING avg((v1 = 'drift')::INT::DOUBLE) > 0.01)""")
def _(s):
    t = s.withColumn("label", lb.ordinal_label(F.col("nli_deberta_fwd"), F.col("nli_deberta_bwd"), F.col("cos_mpnet")))
    by = rates.drift_rate(t, "cer_target").select(F.lit("drift_rate").alias("metric"), F.col("cer_target").cast("string").alias("key"), "n", F.col("drift_rate").alias("value"))
    n = t.agg(F.count(F.lit(1)).alias("_n"))
    share = t.groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select(F.lit("share").alias("metric"), F.col("label").alias("key"), "n", (F.col("n") / F.col("_n")).alias("value"))
    edge = rates.critical_level(t).select(F.lit("threshold").alias("metric"), F.lit("CRIT").alias("key"), F.lit(1).cast("long").alias("n"), F.col("critical_level").alias("value"))
    return by.unionByName(share).unionByName(edge)


@query("quasi_newton_multinomial", A, digits=4, doubles="beta", sql=f"""{fitted.multinomial(A, "label", CLASSES, ["1.0", "realized_cer"])} SELECT term, beta FROM {fitted.table([f"{c}:{t}" for c in CLASSES[1:] for t in ("intercept", "realized_cer")])} t""")
def _(a):
    base = a.groupBy(F.lit(1.0).alias("_x0"), F.col("realized_cer").alias("_x1")).agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.count_if(F.col("label") == c).cast("double").alias(f"_k{j}") for j, c in enumerate(CLASSES[1:])])
    names = [f"{c}:{t}" for c in CLASSES[1:] for t in ("intercept", "realized_cer")]
    return a.sparkSession.createDataFrame([(n, float(b)) for n, b in zip(names, glm._quasi_newton(base, 2, 2), strict=True)], "term string, beta double")


@query("anti_membership", P, sql=f"""
    SELECT conv_id, turn FROM {P} WHERE conv_id NOT IN (SELECT conv_id FROM {P} WHERE conv_id % 5 = 0) AND intended_text NOT IN (SELECT intended_text FROM {P} WHERE turn = 0 AND conv_id % 3 = 0)""")
def _(p):
    t = balance.resume(p, p.where("conv_id % 5 = 0"), ["conv_id"])
    return balance.resume(t, p.where("turn = 0 and conv_id % 3 = 0"), ["intended_text"]).select("conv_id", "turn")


@query("injected_signals", P, doubles="length_ratio", sql=f"SELECT conv_id, turn, length(output_message)::DOUBLE / greatest(1, length(intended_text)) AS length_ratio, left(intended_text, 1) = left(output_message, 1) AS same_start FROM {P}")
def _(p):
    @F.pandas_udf("boolean")
    def same_start(a, b):  # noqa: ANN001, ANN202
        return a.str[:1] == b.str[:1]

    fns = {"length_ratio": lambda a, b: F.length(b).cast("double") / F.greatest(F.lit(1), F.length(a)), "same_start": same_start}
    return lb.injected_signals(p, fns).select("conv_id", "turn", "length_ratio", "same_start")


_OFFERS = f"(SELECT conv_id, turn, intended_text, output_message, conv_id % 4 = 0 AS abstained, CASE WHEN turn % 4 < 2 THEN [upper(intended_text), output_message] END AS candidates FROM {P})"


@query("candidate_rows", P, sql=f"""
    SELECT conv_id, turn, place::INT AS place, candidate, trim(candidate) = trim(intended_text) AS faithful
    FROM (SELECT conv_id, turn, intended_text, unnest([concat(intended_text, '?'), output_message, ' ', intended_text]) AS candidate, unnest([1, 2, 3, 4]) AS place FROM {P} WHERE turn % 4 < 2) WHERE trim(candidate) <> ''""")
def _(p):
    """Each offered candidate as a row, by a table function called from SQL."""
    tables.register(p.sparkSession)
    offers = "CASE WHEN turn % 4 < 2 THEN array(concat(intended_text, '?'), output_message, ' ', intended_text) END"
    return p.sparkSession.sql(f"SELECT conv_id, turn, c.* FROM {{p}}, LATERAL candidate_rows(intended_text, {offers}) c", p=p)


@query("substudy_labels", P, sql=f"""
    SELECT conv_id, turn, CASE WHEN NOT abstained THEN CASE WHEN intended_text = output_message THEN 'faithful' ELSE 'drift' END END AS label,
           CASE WHEN NOT abstained AND candidates IS NOT NULL THEN intended_text = output_message OR list_contains(candidates, intended_text) END AS any_candidate_faithful FROM {_OFFERS}""")
def _(p):
    offers = F.when(F.col("turn") % 4 < 2, F.array(F.upper("intended_text"), F.col("output_message")))
    rows = p.withColumns({"abstained": F.col("conv_id") % 4 == 0, "candidates": offers})
    return lb.substudy_labels(rows, ["conv_id", "turn"], lambda a, b: F.when(a == b, "faithful").otherwise("drift")).select("conv_id", "turn", "label", "any_candidate_faithful")


_ESC = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
_FORM = f"""'<tr><td>' || {_ESC.format('url')} || '</td><td>' || {_ESC.format('html')} || '</td><td><input name="r' || page_id || '"></td></tr>'"""


@query("rating_form_rows", "pages", sql=f"SELECT page_id, {_FORM} AS form_row FROM pages")
def _(p):
    cell = lambda c: F.concat(F.lit("<td>"), tx.html_escape(F.col(c)), F.lit("</td>"))
    return p.select("page_id", F.concat(F.lit("<tr>"), cell("url"), cell("html"), F.lit('<td><input name="r'), F.col("page_id").cast("string"), F.lit('"></td></tr>')).alias("form_row"))


@query("section_word_counts", "documents", sql=f"SELECT category, count(*) AS lines, sum(len(regexp_extract_all(line, '[^ ]+')))::BIGINT AS words FROM (SELECT *, coalesce(last_value(CASE WHEN length(line) < 20 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'Uncategorized') AS category FROM {_LINES}) WHERE length(line) >= 20 GROUP BY category")
def _(d):
    t = corpus.headed_lines(d, F.length("line") < 20, F.col("line").contains("©"))
    return t.groupBy("category").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)))).alias("words"))
