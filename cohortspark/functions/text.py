"""Text patterns shared by matching, tokenising and feature operators.

Word characters follow Unicode (letters, numbers, underscore), matching the
behaviour of Python's ``\\w``; Java needs ``(?iu)`` for Unicode case folding.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
# Tokens of >= 2 word characters (maximal runs), the bag-of-words token rule.
TOKEN_2PLUS = r"[\p{L}\p{N}_]{2,}"
# Every word run, the phrase-matching token rule.
TOKEN_ANY = r"[\p{L}\p{N}_]+"


def whole_word(alternatives: list[str]) -> str:
    """Case-insensitive regex matching any alternative as a whole word.

    Boundaries are explicit character classes instead of ``\\b`` so that the
    same pattern means the same in Java regex and RE2.
    """
    body = "|".join(f"(?:{a})" for a in alternatives)
    return f"(?iu)(^|[^{WORD}])(?:{body})([^{WORD}]|$)"


def any_of(alternatives: list[str]) -> str:
    """Case-insensitive regex matching any alternative anywhere (search semantics)."""
    body = "|".join(f"(?:{a})" for a in alternatives)
    return f"(?iu)(?:{body})"


#: More literals than this are not looked for one by one.
MAX_LITERALS = 32


def one_by_one(literals: list[str]) -> bool:
    """Few enough, and none with other characters than ASCII letters, digits and ``_ '-``."""
    return 0 < len(literals) <= MAX_LITERALS and all(re.fullmatch(r"[A-Za-z0-9_ '-]+", w) for w in literals)


def holds(col: Column, alternatives: list[str], whole: bool) -> Column:
    """Whether ``whole_word`` or ``any_of`` finds one of the alternatives.

    A pattern that begins with a literal is found fast, alternatives behind a boundary are not: plain
    literals are looked for one by one, and what is around them only where they are found.  A letter
    beyond 16 bits before a literal escapes the look behind, so the whole pattern confirms a hit.
    """
    found = col.rlike(whole_word(alternatives) if whole else any_of(alternatives))
    if not one_by_one(alternatives):
        return found
    found = found if whole else F.lit(True)
    around = (lambda w: f"(?iu){w}(?![{WORD}])(?<![{WORD}]{w})") if whole else (lambda w: f"(?iu){w}")
    words = sorted(set(alternatives))
    out = F.when(col.rlike(around(words[0])), found)
    for w in words[1:]:
        out = out.when(col.rlike(around(w)), found)
    return out.otherwise(F.lit(False))


def literal(term: str) -> str:
    """Regex for a literal term (user phrases are data, not patterns)."""
    return re.escape(term)


def tokens(col: Column | str, pattern: str = TOKEN_2PLUS) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), 0)


def with_concept_suffix(pattern: str) -> str:
    """Allow an optional concept id in brackets after a keyword, e.g. ``colitis (C0009319)``."""
    return rf"{pattern}(?:\s*\(C\d{{4,}}\))?"
