"""Token predicates and tokenisation, all as built-in column expressions.

Everything here stays JVM-side (no Python UDF): the predicates are plain
``isin`` / ``startswith`` / ``rlike`` expressions that Catalyst keeps inside
whole-stage codegen and can evaluate below a join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These must equal the service being replaced for equal results.
#
# Default stop words: the English stop-word corpus of NLTK (179 words), matched
# case-sensitively.
STOP_WORDS_EN = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom "
    "this that that'll these those am is are was were be been being have has "
    "had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will "
    "just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan "
    "shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't"
).split()
# Punctuation: a token equal to one of these 33 single characters is dropped.
PUNCTUATION = (" ", "\n", "\t", "`", "~", "!", "@", "#", "$", "%", "^", "&", "*",
               "(", ")", "-", "_", "=", "+", "[", "]", ";", ":", "'", '"', "\\",
               "|", "<", ">", ",", ".", "/", "?")
# A token whose lower-cased form starts with one of these is a URL.
URL_PREFIXES = ("http:", "https:", "www.")
# ---------------------------------------------------------------------------

# exactly one '@'; after it a '.' whose following piece is non-empty
EMAIL_PATTERN = r"^[^@]*@[^@.]*\.[^@.][^@]*\z"
# tokeniser used for documents: runs of spaces and newlines
TOKEN_SPLIT = "[ \\n]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_stop_word(word, stop_words=None) -> Column:
    return _col(word).isin(list(STOP_WORDS_EN if stop_words is None else stop_words))


def is_punctuation(word) -> Column:
    return _col(word).isin(list(PUNCTUATION))


def is_url(word) -> Column:
    # lower-cased prefix test as one ASCII case-insensitive anchored pattern:
    # only ASCII letters lower-case to the letters of the prefixes, so this
    # equals lower(word).startswith(prefix) and avoids building lower(word)
    alts = "|".join(re.escape(p) for p in URL_PREFIXES)
    return _col(word).rlike(f"^(?i)(?:{alts})")


def is_email(word) -> Column:
    w = _col(word)
    return w.contains("@") & w.rlike(EMAIL_PATTERN)


def keep_token(word, stop_words=None) -> Column:
    """The combined token filter: not a stop word, punctuation, URL or e-mail."""
    w = _col(word)
    return ~(is_stop_word(w, stop_words) | is_punctuation(w) | is_url(w) | is_email(w))


def filter_words(words, stop_words=None) -> Column:
    """Array form of :func:`keep_token`; order and duplicates are kept."""
    return F.filter(_col(words), lambda w: keep_token(w, stop_words))


def split_tokens(text) -> Column:
    """Split a text column into its non-empty tokens (array, order kept).

    Separators are trimmed from both ends first, so the split yields no empty
    pieces and needs no per-element filter (stays in codegen).
    """
    t = F.btrim(_col(text), F.lit(" \n"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, TOKEN_SPLIT))
