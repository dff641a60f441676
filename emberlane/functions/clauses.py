"""Lemmas and clauses as column expressions: suffix rules with exceptions, and what each request of a text asks for."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.functions import text as tx

# Irregular forms of common words, by their lemma.
IRREGULAR = {
    "be": ("am", "is", "are", "was", "were", "been", "being"), "have": ("has", "had", "having"), "do": ("does", "did", "done", "doing"), "go": ("goes", "went", "gone"),
    "get": ("got", "gotten", "getting"), "give": ("gave", "given", "giving"), "bring": ("brought",), "take": ("took", "taken", "taking"), "make": ("made", "making"),
    "come": ("came", "coming"), "feel": ("felt",), "see": ("saw", "seen"), "say": ("said",), "tell": ("told",), "eat": ("ate", "eaten"), "drink": ("drank", "drunk"),
    "sleep": ("slept",), "leave": ("left", "leaving"), "keep": ("kept",), "hurt": ("hurting",), "sit": ("sat", "sitting"), "stand": ("stood",), "lie": ("lying", "lay", "lain"),
    "move": ("moving", "moved"), "breathe": ("breathing", "breathed"), "change": ("changing", "changed"), "use": ("using", "used"), "close": ("closing", "closed"),
    "child": ("children",), "man": ("men",), "woman": ("women",), "wife": ("wives",), "foot": ("feet",), "tooth": ("teeth",), "person": ("people",), "glasses": ("glasses",), "dose": ("doses",),
    "stop": ("stopped", "stopping"), "mom": ("mum", "mommy"),
}
#: Words that begin a clause, that make the next word a noun, and that no request is about.
CONNECTORS = ("and", "but", "or", "then", "so", "because", "if", "when", "while")
DETERMINERS = ("a", "an", "the", "my", "your", "his", "her", "our", "their", "some", "any", "no", "this", "that", "more")
EMPTY_WORDS = (
    "me", "us", "you", "him", "them", "it", "i", "we", "please", "to", "now", "immediately", "right", "away", "urgent", "urgently", "asap", "hurry", "quickly", "soon", "today", "again", "here", "there", "very", "too",
)
_CLAUSE_END = r"[.,;:!?\n]+|\b(?:" + "|".join(CONNECTORS) + r")\b"
_OTHER_FORMS = {form: lemma for lemma, forms in IRREGULAR.items() for form in forms}


def lemma(word: Column) -> Column:
    """A word's lemma: an irregular form's from the table, else by its suffix; lower-case."""
    w = F.lower(word)
    known = F.create_map(*[F.lit(x) for pair in _OTHER_FORMS.items() for x in pair])[w]
    undoubled = lambda stem: F.regexp_replace(stem, r"([bdgkmnprt])\1$", "$1")
    by_suffix = (
        F.when(w.rlike("^[a-z]{2,}[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("^[a-z]+(?:ss|x|zz|ch|sh)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("^[a-z]{2,}[^siu]s$"), F.regexp_replace(w, "s$", ""))
        .when(w.rlike("^[a-z]*[aeiouy][a-z]*[^aeiou]ied$"), F.regexp_replace(w, "ied$", "y"))
        .when(w.rlike("^[a-z]*[aeiouy][a-z]*[^e]ing$") & (F.length(w) > 5), undoubled(F.regexp_replace(w, "ing$", "")))
        .when(w.rlike("^[a-z]*[aeiouy][a-z]*[^e]ed$") & (F.length(w) > 4), undoubled(F.regexp_replace(w, "ed$", "")))
        .otherwise(w)
    )
    return F.coalesce(known, by_suffix)


def lemmas(text: Column) -> Column:
    return F.transform(tx.tokens(text), lemma)


def requests(text: Column) -> Column:
    """Each request of a text as (verb, about): an action word used as a verb, and the content lemmas after it in its clause.

    A clause ends at punctuation or a connector. An action word behind a determiner or another request's verb is a noun
    (need help), and so is content. Roles, pronouns, stop words and words of urgency are no content.
    """
    is_action = lambda w: w.isin(*tx.ACTIONS)
    skipped = [*tx.STOPWORDS, *tx.ROLES, *EMPTY_WORDS, *DETERMINERS]

    def of_clause(clause: Column) -> Column:
        words = F.transform(tx.tokens(clause), lemma)
        before = lambda i: F.get(words, i - 1)
        noun = lambda i: (i > 0) & (before(i).isin(*DETERMINERS) | is_action(before(i)))
        one = F.transform(words, lambda w, i: F.when(is_action(w) & ~noun(i), F.struct(
            w.alias("verb"), F.filter(F.slice(words, i + 2, F.greatest(F.size(words), F.lit(1))), lambda x: ~x.isin(*skipped)).alias("about"),
        )))
        return F.filter(one, lambda r: r.isNotNull())

    return F.flatten(F.transform(F.split(F.lower(text), _CLAUSE_END), of_clause))


def omitted(intended: Column, output: Column) -> Column:
    """Whether a request of ``intended`` is lost: nothing that it is about is left in ``output``, or, if it is about nothing, its verb."""
    left = lemmas(output)
    return F.exists(requests(intended), lambda r: F.when(F.size(r["about"]) > 0, ~F.arrays_overlap(r["about"], left)).otherwise(~F.array_contains(left, r["verb"])))


def role_lemmas(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(lemmas(text), lambda w: w.isin(*tx.ROLES))))
