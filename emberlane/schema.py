"""Schemas, class order and constants of labelled-attempt analytics."""
from __future__ import annotations

from pyspark.sql import types as T

CLASSES = ("faithful", "degraded", "drift")
RATES = (0.0, 0.1, 0.2, 0.3, 0.4)
ATTEMPT_KEY = ("message_id", "corpus", "cer_target", "replicate_idx")
NLI_COLUMNS = ("nli_deberta_fwd", "nli_deberta_bwd", "nli_roberta_fwd", "nli_roberta_bwd")
CRIT_COLUMNS = ("crit_negation_flip", "crit_numeral_change", "crit_recipient_change", "crit_urgency_change", "crit_actionable_omission")
#: Fixed values of the labelling rules.
COSINE_GATE, FLUENCY_GATE, OVERGENERATION_RATIO, BORDERLINE, NEAR_EMPTY = 0.75, 0.5, 1.5, 0.05, 3
CONFIDENCE_CUTOFF, SMALL_STRATUM, LOW_RATE_BAND = 0.9, 30, 0.2
Z_ROUNDED, Z_EXACT = 1.96, 1.959963984540054

_S, _D, _I, _B, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MESSAGES = _struct(message_id=_S, corpus=_S, category=_S, text=_S)
EXPOSURE = _struct(
    message_id=_S, corpus=_S, text=_S, cer_target=_D, replicate_idx=_I, seed=_L, noisy_text=_S, realized_cer=_D, n_errors=_I,
    error_positions=T.ArrayType(_I), sub_count=_I, ins_count=_I, del_count=_I, corrupted_content_words=_I, corrupted_negation=_B,
    corrupted_numeral=_B, n_passthrough_chars=_I,
)
ATTEMPTS = _struct(
    model=_S, prompt_id=_S, prompt_sha256=_S, condition=_S, temperature=_D, message_id=_S, corpus=_S, cer_target=_D, replicate_idx=_I, realized_cer=_D,
    intended_text=_S, noisy_text=_S, raw_output=_S, output_message=_S, confidence=_D, abstained=_B,
)
SIGNALS = T.StructType([*[T.StructField(c, _S) for c in NLI_COLUMNS], *[T.StructField(c, _D) for c in ("cos_mpnet", "cos_minilm", "fluency_raw")], *[T.StructField(c, _B) for c in CRIT_COLUMNS]])
RATINGS = _struct(item_id=_S, rating=_S, notes=_S)
#: Interface conditions in order: name, prompt, abstention permitted, candidates permitted (fixed values).
CONDITIONS = (
    ("forced", "P0", False, False), ("minimal_edit", "P1", False, False), ("copy_when_uncertain", "P2", False, False),
    ("abstain_enabled", "P3", True, False), ("candidate_list", "P4", False, True), ("expansion", "P5", False, False),
)
