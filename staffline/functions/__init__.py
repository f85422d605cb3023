"""Column-level building blocks shared by the reports (all JVM-side)."""

from .json import json_lines
from .predicates import all_of, as_ids, non_blank, restrict_ids
from .text import STRIP_CHARS, sanitize_column
from .time import parse_as_of, since_now, since_today

__all__ = [
    "json_lines",
    "all_of", "as_ids", "non_blank", "restrict_ids",
    "STRIP_CHARS", "sanitize_column",
    "parse_as_of", "since_now", "since_today",
]
