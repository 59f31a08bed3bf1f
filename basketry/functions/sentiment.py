"""Lexicon sentiment as column expressions.

Tokens: whitespace split, surrounding punctuation stripped, lower case;
score = (positive hits - negative hits) / max(sqrt(tokens), 1), clamped to
[-1, 1] and rounded to 3; label at +-.12.  The lexicon is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: punctuation stripped from token edges, label threshold
STRIP_CHARS = ".,!?;:()[]{}\"'"
LABEL_THRESHOLD = 0.12


def tokens(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(STRIP_CHARS))))


def hits(words: Column, lexicon) -> Column:
    lex = F.array(*[F.lit(w) for w in lexicon])
    return F.filter(words, lambda w: F.array_contains(lex, w))


def score(n_words: Column, n_pos: Column, n_neg: Column) -> Column:
    raw = (n_pos - n_neg).cast("double")
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw / F.greatest(F.sqrt(n_words), F.lit(1.0)))), 3)


def label(s: Column) -> Column:
    return (F.when(s > LABEL_THRESHOLD, F.lit("positive"))
            .when(s < -LABEL_THRESHOLD, F.lit("negative"))
            .otherwise(F.lit("neutral")))
