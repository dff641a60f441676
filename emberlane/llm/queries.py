"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm import (
    conversation, exact_dedup, jaccard_join, language, lm_score, mixing, oracle_sql, packing, quality, quality_rules, substring_dedup, tokens, topk, vector_codes,
)
from emberlane.llm.common import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_remainder(n: int, value: int) -> Callable[[Column], Column]:
    """crc32 of the id as text leaves ``value`` when divided by ``n``."""
    return lambda c: F.crc32(c.cast("string").cast("binary")) % n == value


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"), id_remainder(3, 1))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), id_remainder(5, 0))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").withColumn("x", topk.scaled(F.col("embedding")))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.stupid_backoff(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backed_off", F.round("mean_log_score", 6).alias("mean_log_score"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    norm = exact_dedup.ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return exact_dedup.exact_groups(docs.withColumn("text_sha256", F.sha2(norm, 256)), carry=["text_sha256"], digest="text_sha256")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation.damaged(_table(spark, sf_dir, "conversations"))
    return conversation.repair(rows, gone_col="gone").withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_language_id, op3_token_counts, op4_quality, op5_mixing, op6_exact_top_k, op7_lm_scoring, op8_substring_dedup,
        op9_exact_dedup, op10_best_fit_packing, op11_conversation_repair, op12_quality_rules, op13_vector_codes,
    )
}

ORACLE = {
    "op6_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
             p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
    "op1_ngram_jaccard_join": """
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             v AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM v),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
             e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
             l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
             r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op7_lm_scoring": """
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             k AS (SELECT doc_id, least(i, 3) AS longest, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
             n AS (SELECT count(*) AS n FROM k),
             u AS (SELECT c, count(*) AS k FROM k GROUP BY c), ud AS (SELECT doc_id, c, count(*) AS k FROM k GROUP BY doc_id, c),
             g AS (SELECT b, c, count(*) AS k FROM k WHERE longest > 1 GROUP BY b, c), gd AS (SELECT doc_id, b, c, count(*) AS k FROM k WHERE longest > 1 GROUP BY doc_id, b, c),
             h AS (SELECT a, b, c, count(*) AS k FROM k WHERE longest > 2 GROUP BY a, b, c), hd AS (SELECT doc_id, a, b, c, count(*) AS k FROM k WHERE longest > 2 GROUP BY doc_id, a, b, c),
             s AS (SELECT k.doc_id, k.longest, h.k - hd.k AS c3, gx.k - gxd.k AS x3, g.k - gd.k AS c2, ux.k - uxd.k AS x2, u.k - ud.k AS c1, (SELECT n FROM n) - len(t.w) AS rest
                   FROM k JOIN t USING (doc_id) JOIN u ON u.c = k.c JOIN ud ON ud.doc_id = k.doc_id AND ud.c = k.c
                   LEFT JOIN g ON g.b = k.b AND g.c = k.c LEFT JOIN gd ON gd.doc_id = k.doc_id AND gd.b = k.b AND gd.c = k.c
                   LEFT JOIN h ON h.a = k.a AND h.b = k.b AND h.c = k.c LEFT JOIN hd ON hd.doc_id = k.doc_id AND hd.a = k.a AND hd.b = k.b AND hd.c = k.c
                   LEFT JOIN g gx ON gx.b = k.a AND gx.c = k.b LEFT JOIN gd gxd ON gxd.doc_id = k.doc_id AND gxd.b = k.a AND gxd.c = k.b
                   LEFT JOIN u ux ON ux.c = k.b LEFT JOIN ud uxd ON uxd.doc_id = k.doc_id AND uxd.c = k.b),
             v AS (SELECT *, CASE WHEN longest > 2 AND c3 > 0 THEN 3 WHEN longest > 1 AND c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used FROM s),
             x AS (SELECT doc_id, (longest - used) * ln(0.4) + CASE used WHEN 3 THEN ln(c3 / x3) WHEN 2 THEN ln(c2 / x2) WHEN 1 THEN ln(c1 / rest) ELSE -ln(rest + 1) END AS score, used < longest AS backed FROM v)
        SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(n_backed, 0)::BIGINT AS n_backed_off, round(m, 6) AS mean_log_score
        FROM t LEFT JOIN (SELECT doc_id, avg(score) AS m, sum(backed::INT)::BIGINT AS n_backed FROM x GROUP BY doc_id) USING (doc_id)""",
    "op8_substring_dedup": """
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             v AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t)),
             d AS (SELECT doc_id, i FROM v WHERE g IN (SELECT g FROM v GROUP BY g HAVING count(*) > 1)),
             c AS (SELECT DISTINCT doc_id, i + k AS i FROM d, range(35) r(k)),
             p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
             q AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, i) GROUP BY p.doc_id)
        SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM t LEFT JOIN q USING (doc_id)""",
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
    "op11_conversation_repair": oracle_sql.CONVERSATIONS,
    "op12_quality_rules": oracle_sql.QUALITY_RULES,
    "op13_vector_codes": oracle_sql.VECTOR_CODES,
}
