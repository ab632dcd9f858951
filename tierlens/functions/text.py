"""Text column expressions: whitespace, tokens, keyword tests, regex counts, hashing.

All regexes are written so Java (Spark) and RE2 (DuckDB oracle) read them the same
way: explicit character classes, ``\\x{...}`` escapes, ``\\p{Nd}`` for digits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/str.strip() white space: Unicode White_Space plus the
# information separators U+001C..U+001F.  Java's (?U)\s is Unicode White_Space,
# and its negated class is ~8x faster than the spelled-out list; RE2 (the DuckDB
# oracle) has no Unicode \s, so the oracle uses the spelled-out list.
WS_CLASS = r"(?U)[\s\x{1C}-\x{1F}]"
NON_WS_RUN = r"(?U)[^\s\x{1C}-\x{1F}]+"
STRIP_RE = r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$"
PORTABLE_WS_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                     r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
PORTABLE_NON_WS_RUN = PORTABLE_WS_CLASS.replace("[", "[^", 1) + "+"
PORTABLE_STRIP_RE = r"^" + PORTABLE_WS_CLASS + r"+|" + PORTABLE_WS_CLASS + r"+$"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()`` with Python's white-space set."""
    return F.regexp_replace(col_of(c), STRIP_RE, "")


def word_count(c: Column | str) -> Column:
    """``len(s.split())``: number of maximal non-white-space runs."""
    return F.regexp_count(col_of(c), F.lit(NON_WS_RUN)).cast("int")


def token_count(c: Column | str) -> Column:
    """``int(len(s.lower().split()) * 1.3)``; lower-casing never changes white space."""
    return F.floor(word_count(c).cast("double") * F.lit(1.3)).cast("int")


def contains_any(lower_text: Column, keywords: Iterable[str]) -> Column:
    """True when any keyword is a substring (not a word match)."""
    cond = None
    for kw in keywords:
        t = lower_text.contains(kw)
        cond = t if cond is None else (cond | t)
    return cond if cond is not None else F.lit(False)


def count_present(lower_text: Column, keywords: Iterable[str]) -> Column:
    """Number of distinct keywords present as substrings."""
    total = F.lit(0)
    for kw in keywords:
        total = total + lower_text.contains(kw).cast("int")
    return total.cast("int")


def regex_count(c: Column, pattern: str) -> Column:
    """Non-overlapping matches, like ``len(re.findall(pattern, s))``."""
    return F.regexp_count(c, F.lit(pattern)).cast("int")


def prompt_hash(c: Column | str) -> Column:
    """SHA-256 hex of the stripped UTF-8 prompt."""
    return F.sha2(py_strip(c), 256)
