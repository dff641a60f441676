"""Queries on text functions, reply parsing, corpus lines and probes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.functions import stats
from emberlane.functions import text as tx
from emberlane.operators import corpus, noise
from emberlane.operators import label as lb
from emberlane.operators import ranking as rk
from emberlane.plans.registry import query

#: All pairs of a request and its reply; those of ASCII text alone, on which DuckDB's edit distance (in bytes) is one of characters.
P, DOC = "fx_reply_pairs", "documents"
_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g'))"
_TOK = "regexp_extract_all({}, '[A-Za-z0-9]+(?:''[A-Za-z]+)?')"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _cer(p):
    return p.select("conv_id", "turn", tx.cer(F.col("intended_text"), F.col("output_message")).alias("cer"), tx.normalised_edit_distance(F.col("intended_text"), F.col("output_message")).alias("ned"))


def _edits(a: str, b: str) -> str:
    """Edit distance in characters: the built-in one counts bytes, so texts beyond ASCII take rows of the table as lists."""
    row = f"list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j::INT]), lambda acc, j: list_append(acc, least(acc[-1] + 1, prev[j[1] + 1] + 1, prev[j[1]] + ({a}[i[1]] <> {b}[j[1]])::INT)), [i[1]])"
    return f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i::INT]), lambda prev, i: {row}, list_transform(range(0, len({b}) + 1), lambda k: k::INT))[-1]"


_UP = "upper(replace(trim({}), 'ß', 'SS'))"


@query("cer_text", P, doubles="cer ned", sql=f"""
    WITH t AS (SELECT conv_id, turn, intended_text AS a, output_message AS b, {_UP.format('intended_text')} AS c, {_UP.format('output_message')} AS d FROM {P}),
         s AS (SELECT *, string_split(a, '') AS la, string_split(b, '') AS lb, string_split(c, '') AS lc, string_split(d, '') AS ld FROM t),
         e AS (SELECT conv_id, turn, a, c, d, levenshtein(a, b) AS ab, levenshtein(c, d) AS cd FROM s WHERE strlen(a) = length(a) AND strlen(b) = length(b)
               UNION ALL SELECT conv_id, turn, a, c, d, {_edits('la', 'lb')}, {_edits('lc', 'ld')} FROM s WHERE NOT (strlen(a) = length(a) AND strlen(b) = length(b)))
    SELECT conv_id, turn, CASE WHEN length(a) = 0 THEN 0 ELSE ab::DOUBLE / length(a) END AS cer, cd::DOUBLE / greatest(length(c), length(d), 1) AS ned FROM e""")
def _(p): return _cer(p)  # noqa: E704


@query("normalise_text", P, sql=f"SELECT conv_id, turn, {_NORM.format('intended_text')} AS norm, length({_NORM.format('output_message')}) <= 3 AS near_empty FROM {P}")
def _(p): return p.select("conv_id", "turn", tx.normalise(F.col("intended_text")).alias("norm"), lb.near_empty(F.col("output_message")).alias("near_empty"))  # noqa: E704


@query("sentence_form", P, sql=f"""
    SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN '' WHEN right(trim(t), 1) IN ('.', '!', '?') THEN upper(left(trim(t), 1)) || substr(trim(t), 2) ELSE upper(left(trim(t), 1)) || substr(trim(t), 2) || '.' END AS form FROM (SELECT conv_id, turn, lower(intended_text) AS t FROM {P})""")
def _(p): return p.select("conv_id", "turn", tx.sentence_form(F.lower("intended_text")).alias("form"))  # noqa: E704


@query("perplexity_score", "fx_attempts", doubles="confidence score", sql="""
    SELECT DISTINCT confidence, CASE WHEN confidence IS NULL OR confidence <= 0 THEN 0 ELSE least(1, greatest(0, (ln(2500.0::DOUBLE) - ln(nullif(confidence * 40, 0))) / (ln(2500.0::DOUBLE) - ln(40.0::DOUBLE)))) END AS score FROM fx_attempts""")
def _(a): return a.select("confidence").distinct().withColumn("score", tx.perplexity_score(F.col("confidence") * 40))  # noqa: E704


@query("numerals_urgency_negation", DOC, sql=f"""
    SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE)), lambda x: floor(x)::BIGINT::VARCHAR), ',') AS numerals,
           regexp_matches(text, '(?i)\\b(?:now|immediately|right away|urgent(?:ly)?|asap|hurry|quickly)\\b') AS urgent,
           len(list_filter({_TOK.format('text')}, lambda t: lower(t) IN {_in(tx.NEGATIONS)} OR contains(lower(t), 'n''t'))) > 0 AS negation,
           len(list_filter({_TOK.format('text')}, lambda t: NOT (lower(t) IN {_in(tx.STOPWORDS)}) AND NOT regexp_full_match(t, '[0-9]+'))) AS n_content FROM {DOC}""")
def _(d):
    t = F.col("text")
    nums = F.array_join(F.transform(tx.numerals(t), lambda x: F.floor(x).cast("string")), ",")
    return d.select("doc_id", nums.alias("numerals"), tx.has_urgency(t).alias("urgent"), tx.has_negation(t).alias("negation"), F.size(tx.content_words(t)).cast("long").alias("n_content"))


@query("message_features", DOC, doubles="char_len word_count", sql=f"""
    SELECT doc_id, length(text)::DOUBLE AS char_len, len({_TOK.format('text')})::DOUBLE AS word_count, len(list_filter({_TOK.format('text')}, lambda t: regexp_matches(t, '[0-9]'))) > 0 AS has_numeral,
           len(list_filter({_TOK.format('text')}, lambda t: lower(t) IN {_in(tx.NEGATIONS)} OR contains(lower(t), 'n''t'))) > 0 AS has_negation FROM {DOC}""")
def _(d): return d.select("doc_id", *[c.alias(k) for k, c in tx.message_features(F.col("text")).items()])  # noqa: E704


@query("family_split_and_seed", "fx_attempts", sql="""
    SELECT DISTINCT model, split_part(model || ':7b', ':', 1) AS family, regexp_replace(model || ':7b', '[^A-Za-z0-9_]', '_', 'g') AS safe_key, cer_target::VARCHAR AS rate, ('0x' || substr(sha256(concat_ws('|', model, cer_target::VARCHAR, '0', '42')), 1, 8))::BIGINT AS seed FROM fx_attempts""")
def _(a):
    rate, tag = F.col("cer_target").cast("string"), F.concat("model", F.lit(":7b"))
    return a.select("model", tx.model_family(tag).alias("family"), tx.safe_key(tag).alias("safe_key"), rate.alias("rate"), tx.stable_seed(F.col("model"), rate, F.lit("0"), F.lit("42")).alias("seed")).distinct()


@query("grid_codes", "part", sql="SELECT p_partkey, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789 ', (p_partkey % 36 + 1)::INT, 1) AS letter FROM part")
def _(p): return p.select("p_partkey", tx.grid_character((F.col("p_partkey") % 36 + 1).cast("int")).alias("letter"))  # noqa: E704


@query("off_grid_fraction", DOC, doubles="mean median", sql=f"""
    SELECT avg(f) AS mean, quantile_cont(f, 0.5) AS median, count(*) AS n FROM (SELECT CASE WHEN length(text) = 0 THEN 0 ELSE length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789 ', ''))::DOUBLE / length(t) END AS f FROM (SELECT text, upper(replace(text, 'ß', 'SS')) AS t FROM {DOC}))""")
def _(d): return noise.off_grid_summary(d)  # noqa: E704


@query("clean_examples", P, sql=f"SELECT conv_id, turn, length(intended_text) BETWEEN 10 AND 80 AND NOT contains(intended_text, '```') AND NOT contains(intended_text, '...') AND NOT contains(intended_text, '…') AS clean FROM {P}")
def _(p): return p.select("conv_id", "turn", rk.clean_example("intended_text").alias("clean"))  # noqa: E704


_REPLY = """CASE event_id % 5 WHEN 0 THEN concat('{"message": "say ', event_type, '", "confidence": ', cast(user_id AS varchar), '}') WHEN 1 THEN concat('Sure: {"message": "', event_type, '", "confidence": "high"} ok')
    WHEN 2 THEN concat('  just ', event_type, '  ') WHEN 3 THEN '{"message": "ABSTAIN", "confidence": 3.5}' ELSE '{"other": 1}' END"""


def _replies(e):
    k, t = F.col("event_id") % 5, F.col("event_type")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"message": "say '), t, F.lit('", "confidence": '), F.col("user_id").cast("string"), F.lit("}"))).when(k == 1, F.concat(F.lit('Sure: {"message": "'), t, F.lit('", "confidence": "high"} ok')))
        .when(k == 2, F.concat(F.lit("  just "), t, F.lit("  "))).when(k == 3, F.lit('{"message": "ABSTAIN", "confidence": 3.5}')).otherwise(F.lit('{"other": 1}'))
    )
    return e.withColumn("raw", raw)


@query("json_reply_parse", "events", doubles="confidence", sql=f"""
    WITH r AS (SELECT event_id, {_REPLY} AS raw FROM events), b AS (SELECT *, nullif(regexp_extract(raw, '(?s)\\{{.*\\}}', 0), '') AS body FROM r)
    SELECT event_id, coalesce(body ->> '$.message', trim(raw)) AS output_message, try_cast(body ->> '$.confidence' AS DOUBLE) AS confidence, coalesce(trim(coalesce(body ->> '$.message', raw)) = 'ABSTAIN', false) AS abstained FROM b""")
def _(e): return _replies(e).select("event_id", tx.parse_reply(F.col("raw"), "ABSTAIN").alias("r")).select("event_id", "r.*")  # noqa: E704


@query("props_json", "events", sql="SELECT event_type, (props ->> '$.k')::BIGINT % 7 AS k, count(*) AS n FROM events GROUP BY ALL")
def _(e): return e.groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))  # noqa: E704


_SAID = "list_filter([intended_text, output_message], lambda t: trim(t) <> '')"


@query("candidate_parse", P, sql=f"""
    SELECT conv_id, turn, CASE WHEN conv_id % 5 < 2 THEN nullif(array_to_string({_SAID}, '|'), '')
           WHEN conv_id % 5 = 2 THEN nullif(regexp_extract(intended_text, '[A-Za-z]+', 0), '') END AS candidates FROM {P}""")
def _(p):
    """Replies that offer a conversation's texts as candidates: as JSON, as JSON within prose, broken off, without a list, as prose."""
    offer = F.to_json(F.struct(F.array("intended_text", "output_message").alias("candidates"), F.lit("x").alias("message")))
    word = F.regexp_extract("intended_text", "[A-Za-z]+", 0)
    kind = F.col("conv_id") % 5
    raw = (
        F.when(kind == 0, offer).when(kind == 1, F.concat(F.lit("Sure: "), offer, F.lit(" done")))
        .when(kind == 2, F.concat(F.lit('{"candidates": ["'), word, F.lit('", broken')))
        .when(kind == 3, F.lit('{"message": "none"}')).otherwise(F.regexp_replace("intended_text", "[{}]", ""))
    )
    closed = F.when(kind == 2, F.concat(raw, F.lit("]"))).otherwise(raw)
    return p.select("conv_id", "turn", F.array_join(tx.parse_candidates(closed), "|").alias("candidates"))


@query("mean_word_frequency", DOC, doubles="mean_word_freq", digits=6, sql=f"""
    WITH t AS (SELECT doc_id, unnest(list_transform({_TOK.format("coalesce(text, '')")}, lambda x: lower(x))) AS word FROM {DOC}), n AS (SELECT count(*) AS n FROM t),
    f AS (SELECT word, log10(count(*)::DOUBLE * 1e9 / any_value(n.n)) AS zipf FROM t, n GROUP BY word)
    SELECT d.doc_id, coalesce(m, 0.0) AS mean_word_freq FROM {DOC} d LEFT JOIN (SELECT doc_id, avg(zipf) AS m FROM t JOIN f USING (word) GROUP BY doc_id) USING (doc_id)""")
def _(d): return corpus.mean_word_frequency(d, "doc_id", "text")  # noqa: E704


@query("stated_confidence", "events", doubles="confidence", sql="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (user_id % 100)::DOUBLE END AS confidence, 'said ' || event_type AS said FROM events")
def _(e):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("said "), F.col("event_type"))).otherwise(F.concat(F.lit("said "), F.col("event_type"), F.lit(" ## Confidence: "), (F.col("user_id") % 100).cast("string")))
    return e.select("event_id", tx.stated_confidence(t).alias("confidence"), tx.before_marker(t, "##").alias("said"))


_SAY = "concat(CASE conv_id % 8 WHEN 0 THEN 'I do not want it' WHEN 1 THEN 'Don''t call my daughter' WHEN 2 THEN 'Please stop and tell the nurse' WHEN 3 THEN 'Not now' WHEN 4 THEN 'she cannot see her father' WHEN 5 THEN 'It is not not so' WHEN 6 THEN 'you will not do not go' ELSE 'All is well' END, ' ', cast(turn AS varchar))"


def _said(c):
    lines = ("I do not want it", "Don't call my daughter", "Please stop and tell the nurse", "Not now", "she cannot see her father", "It is not not so", "you will not do not go", "All is well")
    return c.withColumn("s", F.concat(F.element_at(F.array(*[F.lit(x) for x in lines]), (F.col("conv_id") % 8 + 1).cast("int")), F.lit(" "), F.col("turn").cast("string")))


def _flip_sql() -> str:
    out = "NULL"
    for pat, by in reversed([*((f"\\b{a}\\b", b) for a, b in tx.FLIPS), ("\\bnot\\b\\s*", "")]):
        pat = pat.replace("'", "''")
        made = f"trim(regexp_replace(regexp_replace(s, '(?i){pat}', '{by}'), '\\s{{2,}}', ' ', 'g'))"
        fixed = f"CASE WHEN left({made}, 1) <> upper(left({made}, 1)) AND left(s, 1) <> lower(left(s, 1)) THEN upper(left({made}, 1)) || substr({made}, 2) ELSE {made} END"
        out = f"CASE WHEN regexp_matches(s, '(?i){pat}') THEN {fixed} ELSE {out} END"
    return out


def _swap_sql() -> str:
    out = "NULL"
    for a, b in reversed(tx.RECIPIENTS):
        out = f"CASE WHEN regexp_matches(s, '\\b{a}\\b') THEN regexp_replace(s, '\\b{a}\\b', '{b}') ELSE {out} END"
    return out


@query("probe_transforms", "conversations", sql=f"""
    SELECT conv_id, turn, s, {_flip_sql()} AS flipped, {_swap_sql()} AS swapped, CASE WHEN contains(s, 'stop') THEN regexp_replace(s, 'stop', 'continue') WHEN contains(s, 'don''t') OR contains(s, 'do not') THEN {_flip_sql()} END AS consented
    FROM (SELECT conv_id, turn, {_SAY} AS s FROM conversations)""")
def _(c):
    s = F.col("s")
    return _said(c).select("conv_id", "turn", "s", tx.flip_negation(s).alias("flipped"), tx.swap_recipient(s).alias("swapped"), tx.refusal_to_consent(s).alias("consented"))


_CONSENT = f"CASE WHEN contains(s, 'stop') THEN regexp_replace(s, 'stop', 'continue') WHEN contains(s, 'don''t') OR contains(s, 'do not') THEN {_flip_sql()} END"


@query("probe_set", "conversations", sql=f"""
    WITH t AS (SELECT conv_id, turn, {_SAY} AS s FROM conversations),
         v AS (SELECT conv_id, turn, s, 0 AS k, NULL AS drift_type, NULL AS dangerous_variant FROM t UNION ALL SELECT conv_id, turn, s, 1, 'negation', {_flip_sql()} FROM t
               UNION ALL SELECT conv_id, turn, s, 2, 'recipient', {_swap_sql()} FROM t UNION ALL SELECT conv_id, turn, s, 3, 'refusal_consent', {_CONSENT} FROM t)
    SELECT printf('probe_%04d', row_number() OVER (ORDER BY conv_id, turn, k) - 1) AS message_id, 'message_critical' AS category, s AS intended_text, drift_type, dangerous_variant
    FROM v WHERE k = 0 OR (dangerous_variant IS NOT NULL AND dangerous_variant <> '' AND dangerous_variant <> s)""")
def _(c): return corpus.probe_set(_said(c).select(F.struct("conv_id", "turn").alias("seed_id"), F.col("s").alias("text")))  # noqa: E704


_A, _B = _TOK.format("intended_text"), _TOK.format("output_message")
_LOW = "list_transform({}, lambda t: lower(t))"
_ROLE = f"list_sort(list_distinct(list_filter({_LOW}, lambda t: t IN {_in(tx.ROLES)})))"
_NEG = f"len(list_filter({{}}, lambda t: lower(t) IN {_in(tx.NEGATIONS)} OR contains(lower(t), 'n''t'))) > 0"
_URG = "regexp_matches({}, '(?i)\\b(?:now|immediately|right away|urgent(?:ly)?|asap|hurry|quickly)\\b')"
_NUM = "list_sort(list_transform(regexp_extract_all({}, '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE))"


@query("critical_flags_lexical", P, sql=f"""
    WITH w AS (SELECT *, {_LOW.format(_A)} AS ours, {_LOW.format(_B)} AS theirs FROM {P}),
         c AS (SELECT *, list_filter(ours, lambda w: NOT (w IN {_in([*tx.STOPWORDS, *tx.ROLES, *tx.ACTIONS, 'me', 'us', 'please'])})) AS content, list_filter(ours, lambda w: w IN {_in(tx.ACTIONS)}) AS action FROM w)
    SELECT conv_id, turn, ({_NEG.format(_A)}) <> ({_NEG.format(_B)}) AS negation_flip, {_NUM.format('intended_text')} <> {_NUM.format('output_message')} AS numeral_change, {_ROLE.format(_A)} <> {_ROLE.format(_B)} AS recipient_change,
           {_URG.format('intended_text')} <> {_URG.format('output_message')} AS urgency_change,
           len(action) > 0 AND CASE WHEN len(content) > 0 THEN len(list_intersect(content, theirs)) = 0 ELSE len(list_filter(action, lambda x: NOT list_contains(theirs, x))) > 0 END AS actionable_omission FROM c""")
def _(p):
    return p.select("conv_id", "turn", *[c.alias(k) for k, c in lb.critical_flags(F.col("intended_text"), F.col("output_message")).items()])


#: Sentence pairs around two words of a reply, and which detectors see them: n(egation), d(igits), r(ecipient), u(rgency), o(mission).
_SENTENCES = (
    ("Bring me the {a} now", "Get me the {a}", "u"), ("Please bring my {a} and call the nurses", "Please get my {a}, call a nurse", ""),
    ("I need {a} and {b}", "I need {b}", "o"), ("I wanted the {a}. Stop", "I would like the {a}", "o"), ("Give {b} 5 mg", "Give {b} 15 mg", "d"),
    ("Do not give me {a}", "Give me {a}", "n"), ("Call my daughter, I need help", "Call my son, I need help", "r"), ("{a} and {b}", "{b}", ""),
)


def _filled(which: int) -> Column:
    """One side of the pair that a reply's conv_id names, with words made of its ids."""
    sentence = F.element_at(F.array(*[F.lit(s[which]) for s in _SENTENCES]), (F.col("conv_id") % 8 + 1).cast("int"))
    for hole, key in (("a", "conv_id"), ("b", "turn")):
        sentence = F.replace(sentence, F.lit(f"{{{hole}}}"), F.concat(F.lit("q"), F.translate(F.col(key).cast("string"), "0123456789", "bcdfghjkmn"), F.lit(hole)))
    return sentence


@query("critical_flags_clauses", P, sql=f"""
    WITH f AS (SELECT conv_id, turn, CASE conv_id % 8 {" ".join(f"WHEN {i} THEN '{s[2]}'" for i, s in enumerate(_SENTENCES))} END AS f FROM {P})
    SELECT conv_id, turn, contains(f, 'n') AS negation_flip, contains(f, 'd') AS numeral_change, contains(f, 'r') AS recipient_change, contains(f, 'u') AS urgency_change, contains(f, 'o') AS actionable_omission FROM f""")
def _(p):
    return p.select("conv_id", "turn", *[c.alias(k) for k, c in lb.clause_flags(_filled(0), _filled(1)).items()])


_LINES = f"""(SELECT doc_id, i - 1 AS line_no, trim(l[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {DOC}) WHERE trim(l[i]) <> '' AND NOT regexp_full_match(trim(l[i]), '[0-9]+') AND NOT contains(trim(l[i]), '©'))"""


@query("header_carry_forward", DOC, sql=f"""
    SELECT doc_id, line_no, category, line AS text FROM (SELECT *, coalesce(last_value(CASE WHEN length(line) < 20 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'Uncategorized') AS category FROM {_LINES}) WHERE length(line) >= 20""")
def _(d): return corpus.headed_lines(d, F.length("line") < 20, F.col("line").contains("©"))  # noqa: E704


@query("corpus_first_rows", DOC, sql=f"""
    SELECT 'Uncategorized' AS category, line AS text, min(doc_id) AS doc_id, arg_min(line_no, (doc_id, line_no)) AS line_no FROM {_LINES} GROUP BY line""")
def _(d): return corpus.first_rows(corpus.headed_lines(d, F.lit(False), F.col("line").contains("©")))  # noqa: E704


@query("interface_registry", "nation", sql="""
    SELECT n_nationkey, ['forced', 'minimal_edit', 'copy_when_uncertain', 'abstain_enabled', 'candidate_list', 'expansion'][n_nationkey % 6 + 1] AS condition, n_nationkey % 6 = 3 AS permits_abstention, n_nationkey % 6 = 4 AS permits_candidates FROM nation""")
def _(n):
    from emberlane.schema import CONDITIONS

    reg = n.sparkSession.createDataFrame(CONDITIONS, "condition string, prompt_id string, permits_abstention boolean, permits_candidates boolean")
    return n.select("n_nationkey", F.concat(F.lit("P"), (F.col("n_nationkey") % 6).cast("string")).alias("prompt_id")).join(F.broadcast(reg), "prompt_id").drop("prompt_id")


W = "fx_words"
_IN = "(SELECT * FROM fx_words WHERE contains('ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789 ', intended) AND contains('ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789 ', selected) AND length(intended) = 1 AND length(selected) = 1)"
_CM = f"(SELECT intended, selected, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY intended) AS p FROM {_IN} GROUP BY intended, selected)"


@query("confusion_matrix_long", W, doubles="p", sql=f"SELECT * FROM {_CM}")
def _(w): return noise.matrix_long(w)  # noqa: E704


@query("top_confusions", W, doubles="conditional_rate", sql=f"SELECT intended, selected, n, p AS conditional_rate FROM {_CM} WHERE intended <> selected ORDER BY n DESC, intended, selected LIMIT 10")
def _(w): return noise.top_confusions(noise.matrix_long(w))  # noqa: E704


@query("overall_error_rate", W, doubles="error_rate", sql=f"SELECT count(*) AS n, avg((intended <> selected)::INT::DOUBLE) AS error_rate FROM {_IN}")
def _(w): return noise.overall_error(w)  # noqa: E704


_G = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789 '"


@query("row_column_mass", W, doubles="row_mass column_mass neither_mass expected_row expected_column expected_neither", sql=f"""
    WITH t AS (SELECT n, instr({_G}, intended) - 1 AS i, instr({_G}, selected) - 1 AS j FROM {_CM} WHERE intended <> selected)
    SELECT coalesce(sum(n) FILTER (i // 6 = j // 6), 0) / sum(n)::DOUBLE AS row_mass, coalesce(sum(n) FILTER (i % 6 = j % 6), 0) / sum(n)::DOUBLE AS column_mass, coalesce(sum(n) FILTER (i // 6 <> j // 6 AND i % 6 <> j % 6), 0) / sum(n)::DOUBLE AS neither_mass,
           5.0::DOUBLE / 35 AS expected_row, 5.0::DOUBLE / 35 AS expected_column, 25.0::DOUBLE / 35 AS expected_neither FROM t""")
def _(w): return noise.row_column_mass(noise.matrix_long(w))  # noqa: E704


def _messages(w):
    return w.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("message_id"), F.lit("AUTH").alias("corpus"), F.col("p_name").alias("text"))


@query("noise_exposure", W)
def _(w): return noise.exposure(_messages(w), noise.matrix_array(noise.matrix_long(w)))  # noqa: E704


@query("noise_exposure_by_subject", W)
def _(w):
    mats = {s: noise.matrix_array(noise.matrix_long(w.where(F.col("p_partkey") % 2 == i))) for i, s in enumerate(("s0", "s1"))}
    return noise.exposure_by_subject(_messages(w), mats, (0.0, 0.2, 0.4))


@query("held_out_sensitivity", W)
def _(w):
    mats = {f"s{i}": noise.matrix_array(noise.matrix_long(w.where(F.col("p_partkey") % 3 == i))) for i in range(3)}
    return noise.held_out_sensitivity(_messages(w), mats, (0.1, 0.3))


@query("changed_words", P)
def _(p):
    """Pairs are dealt first: a join that broadcasts leaves them in as few tasks as the table has row groups."""
    p = p.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    n = lambda flags: F.size(F.filter(flags, lambda x: x))
    return p.select("conv_id", "turn", n(tx.changed_words("intended_text", "output_message")).alias("n_changed_words"), n(tx.changed_characters("intended_text", "output_message")).alias("n_changed_chars"))


@query("half_up_text", "fx_attempts", doubles="realized_cer", sql="SELECT DISTINCT realized_cer, printf('%.1f', round((realized_cer * 100)::DECIMAL(38,12), 1)::DOUBLE) AS shown FROM fx_attempts")
def _(a): return a.select("realized_cer").distinct().withColumn("shown", stats.half_up(F.col("realized_cer") * 100, 1))  # noqa: E704


@query("record_normalisation", "events", sql="""
    SELECT event_id, event_id % 3 = 0 AS abstained, CASE WHEN event_id % 6 = 4 THEN event_type || '|x' END AS candidates FROM events""")
def _(e):
    from emberlane.schema import CONDITIONS

    reg = e.sparkSession.createDataFrame(CONDITIONS, "condition string, prompt_id string, permits_abstention boolean, permits_candidates boolean")
    raw = F.concat(F.lit('{"candidates": ["'), F.col("event_type"), F.lit('", " ", "x"]}'))
    rows = e.select("event_id", F.concat(F.lit("P"), (F.col("event_id") % 6).cast("string")).alias("prompt_id"), raw.alias("raw_output"), F.when(F.col("event_id") % 3 == 0, True).alias("abstained"))
    return lb.normalised_record(rows, reg).select("event_id", "abstained", F.array_join("candidates", "|").alias("candidates"))
