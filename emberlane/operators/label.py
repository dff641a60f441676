"""Decision tables over text signals, ensemble votes, and label sources, as column expressions."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.functions import clauses
from emberlane.functions import text as tx
from emberlane.contracts import dedupe_apply
from emberlane.schema import BORDERLINE, COSINE_GATE, CRIT_COLUMNS, FLUENCY_GATE, NEAR_EMPTY, NLI_COLUMNS, OVERGENERATION_RATIO

EVALUATORS = (("deberta", "mpnet"), ("deberta", "minilm"), ("roberta", "mpnet"), ("roberta", "minilm"))
POLICIES = ("primary", "drift_averse", "severity")


def any_critical(columns: tuple[str, ...] = CRIT_COLUMNS) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c), F.lit(False))
    return out


def only_critical(column: str) -> Column:
    """One flag set and all others unset."""
    return F.col(column) & ~any_critical(tuple(c for c in CRIT_COLUMNS if c != column))


def ordinal_label(fwd: Column, bwd: Column, cosine: Column) -> Column:
    """First rule set: contradiction is drift; entailment both ways or a high cosine is faithful; else degraded."""
    return (
        F.when((fwd == "contradict") | (bwd == "contradict"), "drift").when((fwd == "entail") & (bwd == "entail"), "faithful")
        .when(cosine >= COSINE_GATE, "faithful").otherwise("degraded")
    )


def differs(fwd: Column, bwd: Column, cosine: Column, critical: Column) -> Column:
    """The meaning differs: contradiction, else a critical flag, else no entailment both ways and a low cosine."""
    return (
        F.when((fwd == "contradict") | (bwd == "contradict"), True).when(critical, True)
        .when((fwd == "entail") & (bwd == "entail"), False).otherwise(cosine < COSINE_GATE)
    )


def gated_label(fwd: Column, bwd: Column, cosine: Column, critical: Column, fluency: Column, tau: Column | float = FLUENCY_GATE) -> Column:
    """Second rule set: not fluent is degraded; fluent and different is drift; fluent and same is faithful."""
    gate = tau if isinstance(tau, Column) else F.lit(tau)
    return F.when(fluency < gate, "degraded").when(differs(fwd, bwd, cosine, critical), "drift").otherwise("faithful")


def label_reason(fwd: Column, bwd: Column, cosine: Column, flags: tuple[str, ...] = CRIT_COLUMNS) -> Column:
    """The first rule that decides whether the meaning differs; critical flags by their names, joined by +."""
    fired = F.concat_ws("+", *[F.when(F.col(c), c.removeprefix("crit_")) for c in flags])
    return (
        F.when((fwd == "contradict") | (bwd == "contradict"), "nli_contradiction").when(fired != "", F.concat(F.lit("critical_rule:"), fired))
        .when((fwd == "entail") & (bwd == "entail"), "nli_bidirectional_entailment").when(cosine < COSINE_GATE, "cosine_below_threshold").otherwise("cosine_at_or_above_threshold")
    )


def vote(nli: str, embedder: str, rule_free: bool = False, tau: Column | float = FLUENCY_GATE) -> Column:
    critical = F.lit(False) if rule_free else any_critical()
    return gated_label(F.col(f"nli_{nli}_fwd"), F.col(f"nli_{nli}_bwd"), F.col(f"cos_{embedder}"), critical, F.col("fluency_raw"), tau)


def ensemble(df: DataFrame, policy: str | Column = "primary", rule_free: bool = False, tau: Column | float = FLUENCY_GATE) -> DataFrame:
    """``df`` with four votes, label, agreement (most votes / 4), tie and tied_labels (sorted, joined by bars).

    Ties go to the first evaluator's tied vote (primary), the least severe (drift_averse) or the most severe (severity)
    label; the policy may be a column, so a sweep is one pass.
    """
    if isinstance(policy, str):
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}")
        policy = F.lit(policy)
    names = [f"vote__{a}_{b}" for a, b in EVALUATORS]
    out = df.withColumns({n: vote(a, b, rule_free, tau) for n, (a, b) in zip(names, EVALUATORS, strict=True)})
    count = lambda c: sum((F.when(F.col(n) == c, 1).otherwise(0) for n in names), F.lit(0))
    out = out.withColumns({"_f": count("faithful"), "_d": count("degraded"), "_x": count("drift")})
    most = F.greatest("_f", "_d", "_x")
    is_tied = {"degraded": F.col("_d") == most, "drift": F.col("_x") == most, "faithful": F.col("_f") == most}
    of = lambda n: F.when(F.col(n) == "faithful", F.col("_f")).when(F.col(n) == "degraded", F.col("_d")).otherwise(F.col("_x"))
    first = F.coalesce(*[F.when(of(n) == most, F.col(n)) for n in names])
    mild = F.when(is_tied["faithful"], "faithful").when(is_tied["degraded"], "degraded").otherwise("drift")
    severe = F.when(is_tied["drift"], "drift").when(is_tied["degraded"], "degraded").otherwise("faithful")
    chosen = F.when(policy == "primary", first).when(policy == "drift_averse", mild).otherwise(severe)
    tied = F.concat_ws("|", *[F.when(c, k) for k, c in is_tied.items()])
    return out.withColumns({"label": chosen, "agreement": (most / 4).cast("double"), "tie": sum((c.cast("int") for c in is_tied.values()), F.lit(0)) > 1, "tied_labels": tied}).drop("_f", "_d", "_x")


def sweep(df: DataFrame, taus: tuple[float, ...] = (0.3, 0.5, 0.7), rule_free: bool = False) -> DataFrame:
    """Label counts for each fluency gate and tie-break: signals are relabelled, nothing is inferred again."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(t, p) for t in taus for p in POLICIES], "tau double, policy string")
    rows = df.drop("label").crossJoin(F.broadcast(grid))
    return ensemble(rows, F.col("policy"), rule_free, F.col("tau")).groupBy("tau", "policy", "label").agg(F.count(F.lit(1)).alias("n"))


def human_label(rating: Column) -> tuple[Column, Column]:
    """(class, critical) of a rater's words; unknown words give null."""
    r = F.lower(F.trim(rating))
    known = {"faithful": "faithful", "degraded": "degraded", "drift": "drift", "message-critical drift": "drift", "message-critical": "drift"}
    label = F.lit(None).cast("string")
    for word, c in known.items():
        label = F.when(r == word, c).otherwise(label)
    return label, F.when(label.isNotNull(), r.startswith("message-critical"))


def with_source(df: DataFrame, human: str, judge: str, automatic: str) -> DataFrame:
    """final_label by precedence human, judge, automatic; its source; critical where a message-critical row drifted."""
    source = F.when(F.col(human).isNotNull(), "human").when(F.col(judge).isNotNull(), "judge").otherwise("nli")
    label = F.coalesce(human, judge, automatic)
    return df.withColumns({"final_label": label, "label_source": source}).withColumn("critical", (F.col("final_label") == "drift") & (F.col("category") == "message_critical"))


def outcome(label: Column, abstained: Column) -> Column:
    """Declined where abstained, whatever the label."""
    return F.when(F.coalesce(abstained, F.lit(False)), "declined").otherwise(label)


def bidirectional(nli: str) -> Column:
    return (F.col(f"nli_{nli}_fwd") == "entail") & (F.col(f"nli_{nli}_bwd") == "entail")


def low_cosine() -> Column:
    return (F.col("cos_mpnet") < COSINE_GATE) | (F.col("cos_minilm") < COSINE_GATE)


def zero_error_cause(intended: Column, output: Column) -> Column:
    """Why an uncorrupted message drifted: critical substitution, formatting, paraphrase, overgenerative, other, in this order."""
    paraphrase = ~low_cosine() & (bidirectional("deberta") | bidirectional("roberta"))
    a, b = F.length(intended), F.length(output)
    over = F.when(a == 0, b > 0).otherwise(b >= OVERGENERATION_RATIO * a)
    return (
        F.when(any_critical(), "critical_substitution").when(tx.normalise(intended) == tx.normalise(output), "formatting")
        .when(paraphrase, "paraphrase").when(over, "overgenerative").otherwise("other")
    )


def unresolved_reason() -> Column:
    contradiction = F.lit(False)
    for c in NLI_COLUMNS:
        contradiction = contradiction | (F.col(c) == "contradict")
    return F.when(contradiction, "nli_contradiction_driven").when(low_cosine(), "cosine_driven_low_similarity").otherwise("entailment_gate_failed_high_cosine")


def borderline() -> Column:
    near = lambda c: F.col(c).between(COSINE_GATE - BORDERLINE, COSINE_GATE + BORDERLINE)
    return near("cos_mpnet") | near("cos_minilm")


def near_empty(output: Column) -> Column:
    return F.length(tx.normalise(output)) <= NEAR_EMPTY


def critical_flags(intended: Column, output: Column) -> dict[str, Column]:
    """The five detectors without a parser: lexicons in place of lemmas and dependency arcs (an approximation).

    Where parsed flags exist they are columns of the input; these stand in for them. Omission: an action word of the
    intended text is gone and none of the content words after it is left in the output.
    """
    lower = lambda t: F.transform(tx.tokens(t), lambda x: F.lower(x))
    ours, theirs = lower(intended), lower(output)
    skip = [*tx.STOPWORDS, *tx.ROLES, *tx.ACTIONS, "me", "us", "please"]
    content = F.filter(ours, lambda w: ~w.isin(*skip))
    action = F.filter(ours, lambda w: w.isin(*tx.ACTIONS))
    lost = F.size(F.array_intersect(content, theirs)) == 0
    return {
        "negation_flip": tx.has_negation(intended) != tx.has_negation(output),
        "numeral_change": tx.numerals(intended) != tx.numerals(output),
        "recipient_change": tx.role_words(intended) != tx.role_words(output),
        "urgency_change": tx.has_urgency(intended) != tx.has_urgency(output),
        "actionable_omission": (F.size(action) > 0) & F.when(F.size(content) > 0, lost).otherwise(F.size(F.array_except(action, theirs)) > 0),
    }


def clause_flags(intended: Column, output: Column) -> dict[str, Column]:
    """The five detectors on lemmas and clauses: roles by lemma, omissions by what each request of the intended text is about."""
    return {
        "negation_flip": tx.has_negation(intended) != tx.has_negation(output),
        "numeral_change": tx.numerals(intended) != tx.numerals(output),
        "recipient_change": clauses.role_lemmas(intended) != clauses.role_lemmas(output),
        "urgency_change": tx.has_urgency(intended) != tx.has_urgency(output),
        "actionable_omission": clauses.omitted(intended, output),
    }


def any_candidate_faithful(attempts: DataFrame, labels: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows with candidates: the primary or any candidate is faithful. ``labels`` has (intended_text, output_message, label); null elsewhere."""
    each = attempts.where("candidates is not null").select(*key, "intended_text", F.explode("candidates").alias("output_message"))
    found = each.join(labels, ["intended_text", "output_message"], "left").groupBy(*key).agg(F.max(F.coalesce(F.col("label") == "faithful", F.lit(False))).alias("_any"))
    out = attempts.join(found, list(key), "left")
    return out.withColumn("any_candidate_faithful", F.when(F.col("candidates").isNotNull(), F.coalesce(F.col("_any"), F.lit(False)) | (F.col("label") == "faithful"))).drop("_any")


def normalised_record(df: DataFrame, conditions: DataFrame) -> DataFrame:
    """output_message, abstained and candidates of a runner's row; candidates only where its prompt permits them."""
    rows = df.join(F.broadcast(conditions.select("prompt_id", "permits_candidates")), "prompt_id", "left")
    found = F.when(F.coalesce("permits_candidates", F.lit(False)), tx.parse_candidates(F.col("raw_output")))
    return rows.withColumns({"abstained": F.coalesce("abstained", F.lit(False)), "candidates": found}).drop("permits_candidates")


def injected_signals(df: DataFrame, fns: dict[str, Callable[[Column, Column], Column]], intended: str = "intended_text", output: str = "output_message") -> DataFrame:
    """``df`` with one column per injected scoring function of (intended, output), each distinct pair scored once.

    A function takes two columns and gives one: an expression, or a pandas UDF where a model has to be called in batches.
    """
    return dedupe_apply(df, [intended, output], lambda t: t.withColumns({k: f(F.col(intended), F.col(output)) for k, f in fns.items()}))


def substudy_labels(rows: DataFrame, key: Sequence[str], label_fn: Callable[[Column, Column], Column]) -> DataFrame:
    """Labels of a substudy: replies that were not declined and their candidates are labelled apart, each distinct pair once, and put together.

    A declined row has no label; ``any_candidate_faithful`` is null where a row has no candidates.
    """
    open_rows = rows.where(~F.coalesce("abstained", F.lit(False)))
    said = open_rows.select("intended_text", "output_message")
    offered = open_rows.where("candidates is not null").select("intended_text", F.explode("candidates").alias("output_message"))
    labels = said.unionByName(offered).distinct().withColumn("label", label_fn(F.col("intended_text"), F.col("output_message")))
    done = open_rows.join(labels, ["intended_text", "output_message"], "left")
    found = any_candidate_faithful(done, labels, tuple(key)).select(*key, "label", "any_candidate_faithful")
    return rows.join(found, list(key), "left")
