"""Lemmas, requests and the five detectors on sentences whose flags are known."""
import pytest
from pyspark.sql import functions as F

from emberlane.functions import clauses
from emberlane.operators import label as lb

#: Intended, output, and the detectors that must fire: all others must not.
KNOWN = (
    ("do not move", "move", "negation_flip"), ("move", "do not move", "negation_flip"), ("5 mg", "15 mg", "numeral_change"), ("5 mg", "5.0 mg", ""),
    ("call the nurse", "call my daughter", "recipient_change"), ("call the nurse now", "call the nurse", "urgency_change"),
    ("I am thirsty and need help", "I am thirsty", "actionable_omission"), ("call my doctor", "Please call my doctor.", ""),
    ("I am in pain", "I am not in pain", "negation_flip"), ("I am in pain and need help now", "I am in pain", "actionable_omission urgency_change"),
    ("please call the nurse", "call the nurse please", ""), ("bring me water", "get me water", ""), ("please bring my water", "please get my water", ""),
    ("I want to move", "I would like to move", ""), ("call the nurse", "I am fine", "actionable_omission recipient_change"), ("bring my glasses", "get my glasses", ""),
    ("The nurses helped", "The nurse helped", ""), ("I needed blankets", "I need a blanket", ""), ("Stop the pump. Bring water", "Bring water", "actionable_omission"),
    ("I know the answer", "I know the answer now", "urgency_change"), ("", "", ""), ("help", "assist", "actionable_omission"), ("I can't breathe", "I can breathe", "negation_flip"),
)


def test_known_sentences(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in KNOWN], "a string, b string")
    got = df.select("a", "b", *[c.alias(k) for k, c in lb.clause_flags(F.col("a"), F.col("b")).items()]).collect()
    for r, (a, b, want) in zip(got, KNOWN, strict=True):
        assert {k for k, v in r.asDict().items() if v is True} == set(want.split()), (a, b)


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("nurses", "nurse"), ("Wives", "wife"), ("calling", "call"), ("needed", "need"), ("stopping", "stop"), ("bodies", "body"), ("boxes", "box"), ("glass", "glass"), ("is", "be"),
        ("gave", "give"), ("carried", "carry"), ("thing", "thing"), ("need", "need"), ("bus", "bus"), ("analysis", "analysis"), ("5", "5"), ("kisses", "kiss"), ("helped", "help"),
    ],
)
def test_lemmas(spark, word, want):
    assert spark.range(1).select(clauses.lemma(F.lit(word)).alias("x")).first()["x"] == want


def test_requests_and_what_they_are_about(spark):
    text = "I need help and water, bring my blue blankets quickly; call the nurse. The call ended"
    got = spark.range(1).select(clauses.requests(F.lit(text)).alias("r")).first()["r"]
    assert [(x["verb"], list(x["about"])) for x in got] == [("need", ["help"]), ("bring", ["blue", "blanket"]), ("call", [])]
