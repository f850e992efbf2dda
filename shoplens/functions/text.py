"""Text expressions for search: cleaning and tokenising whole texts with
built-in regex functions (no per-row Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.columns import col_

__all__ = ["CONTRACTION_RULES", "expand_contractions", "text_clean", "tokens",
           "query_words", "word_rows"]

# Contraction rules applied after lower-casing, in this order
# (Java replacement syntax; the DuckDB twin uses \1). Specific words first,
# then the general suffix rules.
CONTRACTION_RULES = [
    (r"\bwon't\b", "will not"),
    (r"\bcan't\b", "cannot"),
    (r"\bain't\b", "are not"),
    (r"\blet's\b", "let us"),
    (r"\bi'm\b", "i am"),
    (r"\b([a-z]+)n't\b", "$1 not"),
    (r"\b([a-z]+)'ll\b", "$1 will"),
    (r"\b([a-z]+)'re\b", "$1 are"),
    (r"\b([a-z]+)'ve\b", "$1 have"),
    (r"\b([a-z]+)'d\b", "$1 would"),
    (r"\b(he|she|it|that|there|what|where|who|here|how)'s\b", "$1 is"),
]

# A word is a maximal run of letters, digits or '_' (any script); the
# cleaner keeps only the runs made of ASCII letters.
_NON_WORD = r"[^\p{L}\p{N}_]++"

# Between single spaces, a word with another character than a to z.
_OTHER_WORD = r"(?<![^ ])[a-z]*+[^a-z ][^ ]*+ ?"


def expand_contractions(c) -> Column:
    x = col_(c)
    for pattern, repl in CONTRACTION_RULES:
        x = F.regexp_replace(x, pattern, repl)
    return x


def text_clean(c) -> Column:
    """lower -> expand contractions -> drop digits -> drop ASCII punctuation
    -> keep the all-ASCII-letter words -> single spaces. Whole text, one pass
    of built-in regex functions per step, whose matches cannot be given back
    (no backtracking); texts without an apostrophe hold no contraction."""
    low = F.lower(col_(c))
    x = F.when(F.contains(low, F.lit("'")), expand_contractions(low)).otherwise(low)
    x = F.regexp_replace(x, r"[\p{Nd}\p{Punct}]++", "")
    x = F.regexp_replace(x, _NON_WORD, " ")
    return F.trim(F.regexp_replace(x, _OTHER_WORD, ""))


def tokens(clean_text) -> Column:
    """All words of a cleaned text (the word bank tokenizer)."""
    return F.filter(F.split(col_(clean_text), " "), lambda w: F.length(w) > 0)


def word_rows(docs: DataFrame, *keep: str, text: str = "description") -> DataFrame:
    """(``keep``..., word): a row per word of a cleaned text, in generated code
    (``tokens`` filters an array)."""
    return docs.select(*keep, F.explode(F.split(col_(text), " ")).alias("word")).where("word <> ''")


def query_words(q) -> Column:
    """Whitespace words of a lower-cased query (spell-check units)."""
    return F.filter(F.split(F.trim(F.lower(col_(q))), r"\s+"), lambda w: F.length(w) > 0)
