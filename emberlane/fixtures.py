"""Views over the driver's tables that stand in for labelled attempts: one SQL text each, valid in Spark and DuckDB."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "fx_attempts": """
        SELECT concat('m', cast(l_suppkey % 20 AS string)) AS model, concat('msg', cast(l_partkey % 200 AS string)) AS message_id,
               CASE WHEN l_partkey % 200 < 160 THEN 'AUTH' WHEN l_partkey % 200 < 180 THEN 'CRIT' ELSE 'CTRL' END AS corpus,
               cast(cast(round(l_discount * 100) AS int) % 5 AS double) / 10 AS cer_target, l_linenumber - 1 AS replicate_idx,
               greatest(cast(0 AS double), cast(cast(round(l_discount * 100) AS int) % 5 AS double) / 10 + (l_tax - 0.04) / 2) AS realized_cer,
               CASE WHEN l_quantity = 50 THEN NULL ELSE cast(100 - l_quantity AS double) END AS confidence,
               CASE WHEN (cast(round(l_extendedprice * 100) AS bigint) % 100) < 5 + 12 * (cast(round(l_discount * 100) AS int) % 5) THEN 'drift'
                    WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'degraded' ELSE 'faithful' END AS label,
               l_orderkey, l_partkey, l_suppkey, l_linenumber
        FROM lineitem""",
    "fx_raw": """
        SELECT message_id, corpus, cer_target, replicate_idx, CASE WHEN sum(l_orderkey) % 10 < 10 - 20 * cer_target THEN 'faithful' ELSE 'degraded' END AS raw_label
        FROM fx_attempts GROUP BY message_id, corpus, cer_target, replicate_idx""",
    "fx_signals": """
        SELECT model, message_id, corpus, cer_target, replicate_idx, label, realized_cer, l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CASE l_orderkey % 5 WHEN 0 THEN 'contradict' WHEN 1 THEN 'neutral' ELSE 'entail' END AS nli_deberta_fwd,
               CASE l_partkey % 6 WHEN 0 THEN 'contradict' WHEN 1 THEN 'neutral' ELSE 'entail' END AS nli_deberta_bwd,
               CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'contradict' WHEN 1 THEN 'neutral' ELSE 'entail' END AS nli_roberta_fwd,
               CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN 'contradict' WHEN 1 THEN 'neutral' ELSE 'entail' END AS nli_roberta_bwd,
               cast((l_partkey * 7 + l_suppkey) % 101 AS double) / 100 AS cos_mpnet, cast((l_partkey * 7 + l_suppkey + l_linenumber * 3) % 101 AS double) / 100 AS cos_minilm,
               cast((l_orderkey * 13 + l_suppkey) % 101 AS double) / 100 AS fluency_raw,
               l_orderkey % 17 = 0 AS crit_negation_flip, l_orderkey % 19 = 0 AS crit_numeral_change, l_orderkey % 23 = 0 AS crit_recipient_change,
               l_orderkey % 29 = 0 AS crit_urgency_change, l_orderkey % 31 = 0 AS crit_actionable_omission
        FROM fx_attempts""",
    "fx_pairs": """
        SELECT DISTINCT concat('msg', cast(l_partkey % 200 AS string)) AS crit_message_id, concat('msg', cast(l_partkey % 200 + 20 AS string)) AS message_id
        FROM lineitem WHERE l_partkey % 200 >= 160 AND l_partkey % 200 < 180""",
    "fx_matched": """
        SELECT a.*, p.pair_id, p.critical, CASE WHEN a.label = 'drift' THEN 1 ELSE 0 END AS drift,
               CASE cast(substr(p.pair_id, 4) AS int) % 5 WHEN 0 THEN 'negation' WHEN 1 THEN 'recipient' WHEN 2 THEN 'refusal_consent' WHEN 3 THEN 'dose' ELSE 'grounded' END AS category,
               cast(40 + a.l_partkey % 97 AS double) AS char_len, cast(round(a.realized_cer * (40 + a.l_partkey % 97)) AS double) AS n_errors,
               CASE WHEN a.l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS corrupted_negation, CASE WHEN a.l_orderkey % 7 < 2 THEN 1 ELSE 0 END AS corrupted_numeral
        FROM fx_attempts a JOIN (SELECT crit_message_id AS pair_id, crit_message_id AS message_id, 1 AS critical FROM fx_pairs
                                 UNION ALL SELECT crit_message_id, message_id, 0 FROM fx_pairs) p ON a.message_id = p.message_id""",
    "fx_ratings": """
        SELECT concat('S', lpad(cast(o_orderkey AS string), 7, '0')) AS item_id,
               CASE WHEN o_orderkey % 10 < 5 THEN ' Faithful' WHEN o_orderkey % 10 < 7 THEN 'degraded' WHEN o_orderkey % 10 < 9 THEN 'Drift' ELSE 'message-critical drift' END AS rating_a,
               CASE WHEN o_custkey % 5 = 0 THEN 'drift' WHEN o_orderkey % 10 < 5 THEN 'faithful ' WHEN o_orderkey % 10 < 7 THEN 'Degraded' ELSE 'drift' END AS rating_b,
               CASE WHEN o_custkey % 2 = 0 THEN 'faithful' ELSE NULL END AS rating_adj,
               CASE WHEN o_custkey % 7 = 0 THEN 'drift' WHEN o_orderkey % 10 < 5 THEN 'faithful' WHEN o_orderkey % 10 < 7 THEN 'degraded' ELSE 'drift' END AS auto_label,
               cast(1 + o_custkey % 4 AS double) AS sampling_weight, CASE WHEN o_orderstatus = 'F' THEN 'AUTH' WHEN o_orderstatus = 'O' THEN 'CRIT' ELSE 'CTRL' END AS corpus
        FROM (SELECT o_orderkey, min(o_custkey) AS o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_orderkey) t""",
    "fx_reply_pairs": """
        SELECT a.conv_id, a.turn, a.text AS intended_text, b.text AS output_message
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
        WHERE a.role = 'user' AND b.role = 'assistant'""",
    "fx_interface": """
        SELECT model, message_id, corpus, cer_target, replicate_idx, realized_cer, label,
               CASE l_suppkey % 6 WHEN 0 THEN 'forced' WHEN 1 THEN 'minimal_edit' WHEN 2 THEN 'copy_when_uncertain' WHEN 3 THEN 'abstain_enabled' WHEN 4 THEN 'candidate_list' ELSE 'expansion' END AS condition,
               l_suppkey % 6 = 3 AND l_orderkey % 4 = 0 AS abstained,
               CASE WHEN l_suppkey % 6 = 4 AND l_orderkey % 3 > 0 THEN l_orderkey % 3 = 1 OR label = 'faithful' ELSE NULL END AS any_candidate_faithful
        FROM fx_attempts""",
    "fx_words": """
        SELECT p_partkey, p_name, upper(substr(p_name, 1, 1)) AS intended, upper(substr(p_name, 2, 1)) AS selected FROM part""",
}
#: Tables and views each view reads.
_READS = {"fx_attempts": ["lineitem"], "fx_pairs": ["lineitem"], "fx_ratings": ["orders"], "fx_reply_pairs": ["conversations"], "fx_words": ["part"]}
_READS["fx_matched"] = ["fx_attempts", "fx_pairs"]
_READS |= dict.fromkeys(("fx_raw", "fx_signals", "fx_interface"), ["fx_attempts"])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or fixture view as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    inputs = {t: view(spark, sf_dir, t) for t in _READS[name]}
    for t in inputs:
        sql = re.sub(rf"\b{t}\b(?= a\b| b\b|\s|\)|$)", "{" + t + "}", sql)
    return spark.sql(sql, **inputs)


def with_views(sql: str) -> str:
    """DuckDB text: the fixture views that ``sql`` names, as common table expressions before it."""
    need: list[str] = []

    def add(name: str) -> None:
        for t in _READS[name]:
            if t in VIEWS:
                add(t)
        if name not in need:
            need.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
