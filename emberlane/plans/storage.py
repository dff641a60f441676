"""Queries on readers and writers: each writes through a sink, reads back through a source, and must find what SQL finds in the tables."""
from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane import contracts as ct
from emberlane.operators import agreement as ag
from emberlane.operators import calibration as cal
from emberlane.operators import inference, noise
from emberlane.plans.modelling import FIT, POOLED
from emberlane.plans.registry import query
from emberlane.scratch import Scratch
from emberlane.sources import io, memo

R, A, P = "fx_ratings", "fx_attempts", "fx_reply_pairs"


def _place(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; what is written there goes when the driver ends."""
    return f"{Scratch(spark).folder}/{name}"


_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@query("parquet_checkpoint", "orders", doubles="o_totalprice", sql=f"SELECT {_ORDERS} FROM orders")
def _(o):
    path = _place(o.sparkSession, "parquet")
    io.write_parquet(o.select(*_ORDERS.split(", "), F.col("o_orderstatus").alias("part")), path, ["part"])
    return io.frame(o.sparkSession, path, _ORDERS.split(", "))


@query("frame_or_path", "nation", sql="SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(n):
    path = _place(n.sparkSession, "frame")
    io.write_parquet(n, path)
    return io.frame(n.sparkSession, n, ["n_nationkey", "n_name"]).unionByName(io.frame(n.sparkSession, path, ["n_nationkey", "n_name"]))


@query("csv_round_trip", P, sql=f"SELECT conv_id, turn, intended_text FROM {P}")
def _(p):
    t = p.select("conv_id", "turn", "intended_text")
    path = _place(p.sparkSession, "csv")
    io.write_csv(t, path)
    return io.read_csv(p.sparkSession, path, ["conv_id", "intended_text"], t.schema)


@query("rating_sheets_union", R, sql=f"SELECT item_id, trim(rating_a) AS rating FROM {R}")
def _(r):
    spark, t = r.sparkSession, r.select("item_id", F.trim("rating_a").alias("rating"))
    paths = [_place(spark, "sheet") for _ in range(2)]
    io.write_csv(t.where("item_id <= 'S0005000'"), paths[0])
    io.write_csv(t.where("item_id > 'S0005000'"), paths[1])
    return io.read_sheets(spark, paths)


@query("jsonl_round_trip", P, sql=f"SELECT conv_id, turn, output_message FROM {P}")
def _(p):
    spark, t = p.sparkSession, p.select("conv_id", "turn", "output_message")
    path = _place(spark, "jsonl")
    t.select(F.to_json(F.struct(*t.columns)).alias("value")).unionByName(spark.range(5).select(F.lit("").alias("value"))).write.text(path)  # blank lines among them
    return io.read_jsonl(spark, path, t.schema)


@query("runner_outputs", P, sql=f"SELECT conv_id, turn, 'tag' AS model, output_message FROM {P} WHERE conv_id % 7 > 0")
def _(p):
    spark = p.sparkSession
    t = p.select("conv_id", "turn", F.lit(None).cast("string").alias("model"), F.when(F.col("conv_id") % 7 == 0, "__ERROR__ timeout").otherwise(F.col("output_message")).alias("output_message"))
    at = f"{_place(spark, 'runs')}"
    lines = t.select(F.to_json(F.struct(*t.columns)).alias("value")).unionByName(spark.range(3).select(F.lit('{"conv_id": 1, "turn"').alias("value")))
    lines.write.text(f"{at}/parts")
    fs, folder = io._file(spark, f"{at}/parts")
    for k, part in enumerate(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
        fs.rename(part, io._file(spark, f"{at}/tag_shard{k}.jsonl")[1])
    return io.read_outputs(spark, f"{at}/tag_shard*.jsonl", t.schema).select("conv_id", "turn", "model", "output_message")


@query("jsonl_shards", "orders", sql="SELECT shard::INT AS shard, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1) * 6 // count(*) OVER () AS shard FROM orders) GROUP BY 1")
def _(o):
    path = _place(o.sparkSession, "shards")
    io.write_shards(o.select("o_orderkey", "o_custkey"), path, 6, ["o_orderkey", "o_custkey"])
    t = o.sparkSession.read.schema("o_orderkey long, o_custkey long, shard int").json(path)
    return t.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


_PROBE = ["message_id", "category", "source_category", "intended_text", "drift_type", "dangerous_variant"]


@query("probe_bank", "nation", sql="""
    WITH p AS (SELECT concat('probe_', n_nationkey) AS message_id, n_name AS text FROM nation),
         h AS (SELECT sha256('[' || string_agg('{"category": "c", "dangerous_variant": null, "drift_type": null, "intended_text": "' || text || '", "message_id": "' || message_id || '", "source_category": "s"}', ', ' ORDER BY message_id) || ']') AS bank_sha256 FROM p)
    SELECT message_id, text AS intended_text, bank_sha256 FROM p, h""")
def _(n):
    spark = n.sparkSession
    items = [dict(zip(_PROBE, (f"probe_{r['n_nationkey']}", "c", "s", r["n_name"], None, None), strict=True)) for r in n.collect()]
    items.sort(key=lambda x: x["message_id"])
    path = _place(spark, "probes") + ".json"
    bank = io.freeze_probes(spark, items, path)
    return io.read_probes(spark, path).select("message_id", "intended_text", F.lit(bank).alias("bank_sha256"))


@query("matrix_round_trip", "fx_words", doubles="p", sql="""
    WITH w AS (SELECT intended, selected, count(*) AS n FROM fx_words WHERE intended BETWEEN 'A' AND 'Z' AND selected BETWEEN 'A' AND 'Z' GROUP BY ALL)
    SELECT intended, selected, n / sum(n) OVER (PARTITION BY intended) AS p FROM w""")
def _(w):
    """The confusion matrix of the words' first two letters, written and read back."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    spark, path = w.sparkSession, _place(w.sparkSession, "matrix")
    counts = w.where(F.col("intended").between("A", "Z") & F.col("selected").between("A", "Z")).groupBy("intended", "selected").count()
    m = np.zeros((26, 26))
    for r in counts.collect():  # a cell of the matrix a row
        m[letters.index(r["intended"]), letters.index(r["selected"])] = r["count"]
    io.write_matrix(spark, m / np.maximum(1, m.sum(1, keepdims=True)), letters, path)
    back = io.read_matrix(spark, path, letters)
    return spark.createDataFrame([(letters[i], letters[j], float(back[i, j])) for i, j in zip(*np.nonzero(back), strict=True)], "intended string, selected string, p double")


@query("resumable_signals", P, doubles="length_ratio", sql=f"""
    SELECT conv_id, turn, length(output_message)::DOUBLE / greatest(1, length(intended_text)) AS length_ratio, len(string_split(output_message, ' '))::BIGINT AS n_parts, true AS resumed FROM {P}""")
def _(p):
    """Signals of pairs in a memo: a first run is stopped after some blocks, the second scores what is left."""
    spark, at = p.sparkSession, _place(p.sparkSession, "memo")
    texts = ["intended_text", "output_message"]
    ratio = lambda t: t.withColumn("length_ratio", F.length("output_message").cast("double") / F.greatest(F.lit(1), F.length("intended_text")))
    parts = lambda t: t.withColumn("n_parts", F.size(F.split("output_message", " ")).cast("long"))
    calls: list[int] = []

    def stopped(t: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 3:
            raise InterruptedError
        return ratio(t)

    pairs = p.withColumn(memo.KEY, memo.pair_key(*map(F.col, texts))).select(memo.KEY, *texts).dropDuplicates([memo.KEY])
    block = max(1, pairs.count() // 4)
    try:
        memo.scored(p, texts, {"ratio": (stopped, ["length_ratio"])}, at, block)
    except InterruptedError:
        pass
    kept = len(memo.Memo(spark, at, "ratio").blocks())
    out = memo.scored(p, texts, {"ratio": (ratio, ["length_ratio"]), "parts": (parts, ["n_parts"])}, at, block)
    return out.select("conv_id", "turn", "length_ratio", "n_parts", F.lit(kept == 2).alias("resumed"))


@query("digest_blocks", A, doubles="drift_rate", sql=f"SELECT corpus, count(*) AS n, avg((label = 'drift')::INT::DOUBLE) AS drift_rate, 2.5::DOUBLE AS plain FROM {A} GROUP BY corpus")
def _(a):
    spark, path = a.sparkSession, _place(a.sparkSession, "digest") + ".json"
    block = a.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == "drift").cast("double")).alias("drift_rate"))
    io.write_digest(spark, {"by_corpus": block, "plain": np.float64(2.5), "set": {2, 1}}, path)
    said = json.loads(io.read_text(spark, path))
    assert said["set"] == [1, 2]
    return spark.createDataFrame([(r["corpus"], r["n"], r["drift_rate"], said["plain"]) for r in said["by_corpus"]], "corpus string, n long, drift_rate double, plain double")


@query("provenance_log", "region", sql="""
    SELECT r_name AS name, length(r_name)::BIGINT AS n, sha256(r_name) AS file_sha256, true AS again FROM region""")
def _(r):
    spark, at = r.sparkSession, _place(r.sparkSession, "log")
    for x in r.collect():
        io.write_text(spark, x["r_name"], f"{at}/{x['r_regionkey']}.txt")
        io.log_provenance(spark, f"{at}/log", x["r_name"], {"n": np.int64(len(x["r_name"])), "file_sha256": io.file_sha256(spark, f"{at}/{x['r_regionkey']}.txt"), **io.run_facts(spark)})
        io.log_provenance(spark, f"{at}/log", x["r_name"], {"again": True})
    log = io.read_provenance(spark, f"{at}/log")
    return spark.createDataFrame([(k, v["n"], v["file_sha256"], v["again"]) for k, v in log.items()], "name string, n long, file_sha256 string, again boolean")


@query("claim_check", A, sql=f"""
    SELECT 'n' AS claim, (count(*) + 1)::VARCHAR AS text FROM {A} UNION ALL SELECT 'forbidden', 'TODO'""")
def _(a):
    spark, at, n = a.sparkSession, _place(a.sparkSession, "claims"), a.count()
    io.write_digest(spark, {"n": n + 1, "rate": {"all": 0.125}}, f"{at}/digest.json")
    io.write_text(spark, f"There are {n} attempts; 12.5% drift. TODO", f"{at}/text.md")
    missing = io.claims_missing(spark, f"{at}/digest.json", {"n": "{}", "rate.all": "{:.1%}"}, [f"{at}/text.md"], ["TODO", "FIXME"])
    return spark.createDataFrame(missing, "claim string, text string")


@query("adapted_for_rating", P, doubles="cer confidence_share", sql=f"""
    SELECT concat_ws('|', 'm', concat('c', conv_id::VARCHAR, '-', turn::VARCHAR), '0.2') AS item_key, 'm' AS source_model, 'AUTH' AS corpus, 0.2::DOUBLE AS cer, intended_text AS reference, output_message AS candidate, (turn % 100) / 100.0::DOUBLE AS confidence_share FROM {P}""")
def _(p):
    t = p.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message_id"), F.lit("m").alias("model"), F.lit("AUTH").alias("corpus"), F.lit(0.2).alias("cer_target"), "intended_text", "output_message", (F.col("turn") % 100).cast("double").alias("confidence"))
    return io.for_rating(t)


def _raises(what) -> bool:  # noqa: ANN001
    try:
        out = what()
        if isinstance(out, DataFrame):
            out.count()
    except (ct.ContractError, ValueError):
        return True
    return False


@query("contract_failures", A, R, sql="""
    SELECT * FROM (VALUES ('missing_column', true), ('columns_there', false), ('nulls', true), ('no_nulls', false), ('outside_domain', true), ('inside_domain', false), ('repeated_key', true), ('unmatched_row', true), ('all_matched', false), ('negative_weight', true), ('weights_fine', false)) AS t(check_name, raised)""")
def _(a, r):
    models = a.select("model").distinct()
    checks = {
        "missing_column": lambda: ct.require_columns(a, ["nope"], "a"), "columns_there": lambda: ct.require_columns(a, ["model"], "a"),
        "nulls": lambda: ct.assert_no_nulls(a, ["confidence"], "a"), "no_nulls": lambda: ct.assert_no_nulls(a, ["model", "realized_cer"], "a"),
        "outside_domain": lambda: ct.assert_domain(a, "label", ["drift"], "a"), "inside_domain": lambda: ct.assert_domain(a, "label", ["drift", "degraded", "faithful"], "a"),
        "repeated_key": lambda: ct.assert_unique(a, ["model"], "a"), "unmatched_row": lambda: ct.merge_checked(a, models.where("model != 'm1'").withColumn("x", F.lit(1)), ["model"], unmatched="raise"),
        "all_matched": lambda: ct.merge_checked(a, models.withColumn("x", F.lit(1)), ["model"], unmatched="raise"),
        "negative_weight": lambda: ct.assert_weights(r.withColumn("sampling_weight", -F.col("sampling_weight")), "sampling_weight", "r"), "weights_fine": lambda: ct.assert_weights(r, "sampling_weight", "r"),
    }
    return a.sparkSession.createDataFrame([(k, _raises(f)) for k, f in checks.items()], "check_name string, raised boolean")


@query("strict_merge", A, "part", sql=f"SELECT message_id, l_partkey, l_orderkey, l_linenumber, p_name FROM {A} JOIN part ON p_partkey = l_partkey")
def _(a, p):
    t = a.select("message_id", "l_partkey", "l_orderkey", "l_linenumber")
    return ct.merge_checked(t, p.select(F.col("p_partkey").alias("l_partkey"), "p_name"), ["l_partkey"], unmatched="raise")


@query("allocation_report", A, doubles="rate substitution insertion deletion", sql=f"SELECT r AS rate, r * 0.9 AS substitution, r * 0.05 AS insertion, r * 0.05 AS deletion FROM (SELECT DISTINCT round(cer_target, 1) AS r FROM {A})")
def _(a):
    rates = sorted(x[0] for x in a.select(F.round("cer_target", 1)).distinct().collect())
    return a.sparkSession.createDataFrame([(r, *noise.allocation(r).values()) for r in rates], "rate double, substitution double, insertion double, deletion double")


@query("source_mismatches", R, sql=f"SELECT item_id FROM {R} WHERE corpus = 'AUTH' AND item_id LIKE '%7'")
def _(r):
    key = r.select("item_id", "corpus").withColumn("corpus", F.when((F.col("corpus") == "AUTH") & F.col("item_id").endswith("7"), "CTRL").otherwise(F.col("corpus")))
    return ag.source_mismatches(r.select("item_id", "corpus"), key, "corpus")


@query("digest_rebuild", A, doubles="pooled se", digits=FIT, sql=POOLED)
def _(a):
    """A pooled slope rebuilt from the slopes that a digest stores."""
    spark, at = a.sparkSession, _place(a.sparkSession, "rebuild") + ".json"
    io.write_digest(spark, {"slopes": inference.model_slopes(a), "pooled": None}, at)
    pool = lambda t: cal.random_effects(t.select("slope", (F.col("slope") - 1.96 * F.col("se")).alias("lo"), (F.col("slope") + 1.96 * F.col("se")).alias("hi")), "slope", "lo", "hi")
    made = io.rebuild_block(spark, at, "pooled", "slopes", pool)[0]
    return spark.createDataFrame([(made["k"], made["pooled"], made["se"])], "k long, pooled double, se double")
