"""Text functions as column expressions; pandas functions only where spans are needed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.functions import blocks

# The word lists and patterns that decide results.
NEGATIONS = (
    "not", "no", "never", "cannot", "can't", "don't", "didn't", "doesn't", "won't", "wouldn't", "couldn't", "shouldn't", "isn't", "wasn't", "aren't", "weren't",
    "haven't", "hasn't", "hadn't",
)
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "is", "are", "was", "were", "am", "be", "been", "being", "to", "of", "in", "on", "at", "for", "with", "as", "by", "that", "this",
    "these", "those", "it", "i", "you", "he", "she", "we", "they", "my", "your", "his", "her", "its", "our", "their", "do", "does", "did", "have", "has", "had", "will",
    "would", "can", "could", "should", "not", "no",
)
URGENCY = ("now", "immediately", "right away", "urgent(?:ly)?", "asap", "hurry", "quickly")
ROLES = (
    "nurse", "doctor", "physician", "daughter", "son", "wife", "husband", "mother", "mom", "father", "dad", "sister", "brother", "spouse", "aide", "caregiver", "therapist",
    "attendant", "family", "friend",
)
ACTIONS = ("need", "want", "help", "call", "bring", "get", "give", "stop", "wait", "check")
TOKEN = "[A-Za-z0-9]+(?:'[A-Za-z]+)?"
NUMERAL = r"\d+(?:\.\d+)?"
FLIPS = (
    ("do not", "do"), ("don't", "do"), ("does not", "does"), ("doesn't", "does"), ("did not", "did"), ("didn't", "did"), ("cannot", "can"), ("can't", "can"), ("will not", "will"), ("won't", "will"),
)
RECIPIENTS = (
    ("daughter", "son"), ("son", "daughter"), ("nurse", "doctor"), ("doctor", "nurse"), ("wife", "husband"), ("husband", "wife"), ("mother", "father"), ("father", "mother"),
    ("sister", "brother"), ("brother", "sister"),
)
GRID = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789 "


def cer(reference: Column, other: Column) -> Column:
    """Edit distance over the reference's length; 0 for an empty reference."""
    return F.when(F.length(reference) == 0, 0.0).otherwise(F.levenshtein(other, reference) / F.greatest(F.length(reference), F.lit(1)))


def normalised_edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of upper-cased, trimmed texts over the longer length; 0 if both are empty."""
    a, b = F.upper(F.trim(a)), F.upper(F.trim(b))
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def normalise(text: Column) -> Column:
    """Lower case, ASCII punctuation out, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Punct}", ""), r"\s+", " "))


def sentence_form(text: Column) -> Column:
    """Trimmed, first letter upper case, with a final stop."""
    t = F.trim(text)
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))
    return F.when(F.length(F.trim(text)) == 0, F.lit("")).when(F.substring(t, -1, 1).isin(".", "!", "?"), t).otherwise(F.concat(t, F.lit(".")))


def perplexity_score(ppl: Column) -> Column:
    """1 at 40 and below, 0 at 2500 and above, linear in the logarithm; 0 where not finite or not positive."""
    line = (F.ln(F.lit(2500.0)) - F.ln(ppl)) / (F.ln(F.lit(2500.0)) - F.ln(F.lit(40.0)))
    bad = ppl.isNull() | F.isnan(ppl) | (ppl == float("inf")) | (ppl <= 0)
    return F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), line)))


def numerals(text: Column) -> Column:
    """Sorted array of the numbers in a text."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(NUMERAL), F.lit(0)), lambda x: x.cast("double")))


def has_urgency(text: Column) -> Column:
    return text.rlike(r"(?i)\b(?:" + "|".join(URGENCY) + r")\b")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def has_negation(text: Column) -> Column:
    return F.exists(tokens(text), lambda t: F.lower(t).isin(*NEGATIONS) | F.lower(t).contains("n't"))


def has_numeral(text: Column) -> Column:
    return F.exists(tokens(text), lambda t: t.rlike("[0-9]"))


def content_words(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~F.lower(t).isin(*STOPWORDS) & ~t.rlike("^[0-9]+$"))


def role_words(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens(text), lambda t: F.lower(t)), lambda t: t.isin(*ROLES))))


def message_features(text: Column) -> dict[str, Column]:
    """Matching features that need no frequency list."""
    return {"char_len": F.length(text).cast("double"), "word_count": F.size(tokens(text)).cast("double"), "has_numeral": has_numeral(text), "has_negation": has_negation(text)}


def _first_replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, r"(?is)^(.*?)" + pattern, "$1" + by)


def flip_negation(text: Column) -> Column:
    """The text with its first negation (in the order of the list) made affirmative; null if it has none."""
    out = F.lit(None).cast("string")
    for pattern, by in reversed([*((rf"\b{a}\b", b) for a, b in FLIPS), (r"\bnot\b\s*", "")]):
        made = F.trim(F.regexp_replace(_first_replaced(text, pattern, by), r"\s{2,}", " "))
        first = F.substring(made, 1, 1)
        fixed = F.when((first != F.upper(first)) & (F.substring(text, 1, 1) != F.lower(F.substring(text, 1, 1))), F.concat(F.upper(first), F.substr(made, F.lit(2)))).otherwise(made)
        out = F.when(text.rlike("(?i)" + pattern), fixed).otherwise(out)
    return out


def swap_recipient(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in reversed(RECIPIENTS):
        out = F.when(text.rlike(rf"\b{a}\b"), F.regexp_replace(text, rf"(?s)^(.*?)\b{a}\b", "$1" + b)).otherwise(out)
    return out


def refusal_to_consent(text: Column) -> Column:
    stop = F.regexp_replace(text, r"(?s)^(.*?)stop", "$1continue")
    return F.when(text.contains("stop"), stop).when(text.contains("don't") | text.contains("do not"), flip_negation(text))


def parse_reply(raw: Column, sentinel: str) -> Column:
    """Struct (output_message, confidence, abstained) of a reply: the object in it first, else the whole reply as message."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    said = F.when(body != "", F.get_json_object(body, "$.message"))
    conf = F.when(body != "", F.get_json_object(body, "$.confidence"))
    message = F.coalesce(said, F.trim(F.coalesce(raw, F.lit(""))))
    return F.struct(message.alias("output_message"), conf.try_cast("double").alias("confidence"), (F.trim(message) == sentinel).alias("abstained"))


def parse_candidates(raw: Column) -> Column:
    """Array of non-blank candidates, else null: parsed from the whole reply or the object in it; only where neither parses, by pattern."""
    shape = "candidates array<string>"
    keep = lambda a: F.filter(a, lambda c: F.trim(c) != "")
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    ok = lambda c: F.get_json_object(c, "$").isNotNull() & F.get_json_object(c, "$").startswith("{")
    whole = F.when(ok(raw), raw).when(ok(body), body)
    parsed = keep(F.from_json(whole, shape)["candidates"])
    listed = F.regexp_extract(raw, r'(?s)"candidates"\s*:\s*\[(.*?)\]', 1)
    quoted = keep(F.regexp_extract_all(listed, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)))
    none = F.lit(None).cast("array<string>")
    some = lambda a: F.when(F.size(a) > 0, a)
    absent = whole.isNotNull() & F.get_json_object(whole, "$.candidates").isNull()
    return F.when(raw.isNull() | (raw == ""), none).when(F.size(parsed) > 0, parsed).when(absent, none).otherwise(some(quoted))


def stated_confidence(text: Column) -> Column:
    """N of "Confidence: N" (one to three digits)."""
    return F.regexp_extract(text, r"(?i)confidence:\s*(\d{1,3})", 1).try_cast("double")


def before_marker(text: Column, marker: str) -> Column:
    return F.trim(F.substring_index(text, marker, 1))


def stable_seed(*parts: Column) -> Column:
    """First eight hex digits of the SHA-256 of the parts joined by bars, as a number; doubles must be written as 0.1, 0.0."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def model_family(model: Column) -> Column:
    return F.substring_index(model, ":", 1)


def grid_character(code: Column) -> Column:
    """Character of a grid code 1 to 36; other codes raise."""
    bad = F.raise_error(F.concat(F.lit("grid code out of range: "), code.cast("string")))
    return F.when(code.between(1, 36), F.substr(F.lit(GRID), code, F.lit(1))).otherwise(bad)


def off_grid_fraction(text: Column) -> Column:
    """Share of characters of the upper-cased text outside the grid; 0 if empty."""
    t = F.upper(text)
    kept = F.length(F.translate(t, GRID, ""))
    return F.when(F.length(t) == 0, 0.0).otherwise(kept / F.greatest(F.length(t), F.lit(1)))


def safe_key(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


@F.pandas_udf(T.StructType([T.StructField("corrupted_content_words", T.IntegerType()), T.StructField("corrupted_negation", T.BooleanType()), T.StructField("corrupted_numeral", T.BooleanType())]))
def corruption_flags(text, positions):  # noqa: ANN001, ANN201
    """Content words, negation and numeral touched by the given original positions."""
    import re

    import pandas as pd

    token, stop, neg = re.compile(TOKEN), set(STOPWORDS), set(NEGATIONS)
    rows = []
    for t, p in zip(text, positions, strict=True):
        hit, n, negation, numeral = set(() if p is None else p), 0, False, False
        for m in token.finditer(t or "") if hit else ():
            if hit.isdisjoint(range(m.start(), m.end())):
                continue
            word = m.group().lower()
            negation |= word in neg or "n't" in word
            numeral |= any(c.isdigit() for c in word)
            n += word not in stop and not word.isdigit()
        rows.append((n, negation, numeral))
    return pd.DataFrame(rows, columns=["corrupted_content_words", "corrupted_negation", "corrupted_numeral"])


def _changed(split):  # noqa: ANN001, ANN202
    def flags(before, after):  # noqa: ANN001, ANN202
        import pandas as pd

        pairs = (blocks.coded(split(a or ""), split(b or "")) for a, b in zip(before, after, strict=True))
        return pd.Series([blocks.changed(*p) for p in pairs], dtype=object)

    return F.pandas_udf(flags, T.ArrayType(T.BooleanType()))


def changed_words(before: Column, after: Column) -> Column:
    """For each word of ``after``: not part of a run of words that it shares with ``before`` (longest runs first)."""
    return _changed(str.split)(before, after)


def changed_characters(before: Column, after: Column) -> Column:
    """For each character of ``after``: not part of a run that it shares with ``before`` (longest runs first)."""
    return _changed(list)(before, after)


def prompts(rows: DataFrame, bank: DataFrame, name: str, text: Column, suffix: str) -> DataFrame:
    """``rows`` with the system text of their prompt and the user's turn; the bank (name, system) is data, an unknown name raises."""
    known = bank.select(F.col("name").alias(name), "system")
    out = rows.join(known, name, "left")
    lost = out.where("system is null").select(name).limit(1).collect()
    if lost:
        raise ValueError(f"no prompt is called {lost[0][0]!r}")
    return out.withColumn("user", F.concat(F.lit("Input: "), text, F.lit("\nOutput:"), F.lit(suffix)))


def html_escape(text: Column) -> Column:
    """Text safe within an element or a quoted attribute; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
