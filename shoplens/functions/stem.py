"""Suffix-stripping stems as column expressions (after Porter, "An algorithm
for suffix stripping", 1980, without its test for a final consonant-vowel-
consonant). Patterns use no look-around or back-reference, so that any SQL
engine reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoplens.functions.columns import col_

#: What the part before a suffix has to hold: anything, a vowel, a vowel and a
#: consonant behind it, or this twice; before a suffix that leaves a consonant,
#: the second one may be that.
ANY, VOWEL, ONE = ".+", ".*[aeiouy].*", ".*[aeiouy][^aeiouy].*"
TWO, TWO_WITH = ".*[aeiouy][^aeiouy].*[aeiouy][^aeiouy].*", ".*[aeiouy][^aeiouy].*[aeiouy].*"

# Suffixes of the published algorithm and their replacements, step by step.
_DOUBLED = [(2 * c + end, c, VOWEL) for c in "bdfgmnprt" for end in ("ed", "ing")]
_RESTORED = [(s + end, s + "e", ANY) for s in ("at", "bl", "iz") for end in ("ed", "ing")]
STEPS: list[list[tuple[str, str, str]]] = [
    [("sses", "ss", ANY), ("ies", "i", ANY), ("ss", "ss", ANY), ("us", "us", ANY), ("s", "", VOWEL)],
    [("eed", "ee", ONE), ("eed", "eed", ANY), *_RESTORED, *_DOUBLED, ("ed", "", VOWEL), ("ing", "", VOWEL)],
    [("y", "i", VOWEL)],
    [(a, b, ONE) for a, b in (
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
        ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
        ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
        ("iviti", "ive"), ("biliti", "ble"))],
    [(a, b, ONE) for a, b in (
        ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))],
    [("sion", "s", TWO_WITH), ("tion", "t", TWO_WITH)] + [(a, "", TWO) for a in (
        "ance", "ence", "able", "ible", "ement", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al",
        "er", "ic", "ou")],
    [("e", "", TWO), ("ll", "l", TWO_WITH)],
]


def patterns(step: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(pattern, replacement) of a step; the first that matches is applied."""
    return [(f"^({before}){suffix}$", new) for suffix, new, before in step]


def stem(word) -> Column:
    """The stem of a word of three or more of the letters a-z; any other word is its own stem."""
    def apply(step):
        def run(w):
            out = None
            for pattern, new in patterns(step):
                hit, value = F.rlike(w, F.lit(pattern)), F.regexp_replace(w, pattern, f"$1{new}")
                out = F.when(hit, value) if out is None else out.when(hit, value)
            return out.otherwise(w)
        return run

    word = col_(word)
    held = F.array(word)  # each step's result has a name, so that no step is evaluated twice
    for step in STEPS:
        held = F.transform(held, apply(step))
    return F.when(F.rlike(word, F.lit("^[a-z]{3,}$")), held[0]).otherwise(word)
