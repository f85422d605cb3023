"""The string sanitiser, as a Column expression.

Semantics: an empty or null input becomes ''; each token of
``SANITIZE_TOKENS`` is removed in turn (so removing one token can create
another that was already handled: ``-\\-`` becomes ``--``); then white space
is stripped from both ends with Python's notion of white space; then the
first ``max_length`` characters (code points) are kept.

It uses ``replace`` and ``trim(BOTH chars FROM ...)`` only, so it
stays inside whole-stage codegen and is linear in the text length (no regex
backtracking on long runs of white space).
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SANITIZE_MAX_LENGTH, SANITIZE_TOKENS

# Every code point Python's str.strip() removes (derived by rule, not listed).
STRIP_CHARS = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())


def sanitize_column(col: Column | str, max_length: int = SANITIZE_MAX_LENGTH) -> Column:
    """``col`` sanitised (Q2). Of a literal it folds to a literal, so a filter on it still reaches the scan."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    for token in SANITIZE_TOKENS:
        c = F.replace(c, F.lit(token), F.lit(""))
    c = F.trim(c, F.lit(STRIP_CHARS))
    return F.substring(c, 1, max_length)
