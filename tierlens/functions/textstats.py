"""Mergeable text summaries.

A summary of a text holds its word count, whether it starts / ends with a
non-white-space character, keyword presence flags (on the lower-cased text),
case-sensitive marker flags and non-overlapping regex match counts.  Summaries of
adjacent parts merge exactly (words joined across the junction are counted once)
as long as no keyword, marker or regex match can contain the junction characters;
callers check that condition (see ``operators.corpus``).  This lets a long shared
part (a document) be summarised once and reused by every prompt built around it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NON_WS_RUN

_NON_WS = r"(?U)^[^\s\x{1C}-\x{1F}]"              # for the first and the last character, each by itself


@dataclass(frozen=True)
class Spec:
    keywords: tuple[str, ...] = ()      # substring presence on the lower-cased text
    markers: tuple[str, ...] = ()       # substring presence on the original text
    regexes: tuple[str, ...] = ()       # match counts on the lower-cased text
    words: bool = True                  # word count and edge flags

    def union(self, other: "Spec") -> "Spec":
        def u(a, b):
            return tuple(dict.fromkeys(a + b))
        return Spec(u(self.keywords, other.keywords), u(self.markers, other.markers), u(self.regexes, other.regexes),
                    self.words or other.words)

    def chars(self) -> set[str]:
        return set("".join(self.keywords + self.markers))


def _raw(text: str) -> str:
    """A raw SQL string literal (kept verbatim, whatever the parser's escape setting)."""
    return "r'" + text + "'"


def _summary_sql(text: str, spec: Spec) -> Column:
    T = f"({text})"
    lower = f"lower({T})"
    if spec.words:
        fields = [("ne", f"length({T}) > 0"), ("w", f"CAST(regexp_count({T}, {_raw(NON_WS_RUN)}) AS BIGINT)"),
                  ("fs", f"regexp_like(substring({T}, 1, 1), {_raw(_NON_WS)})"), ("ls", f"regexp_like(substring({T}, -1, 1), {_raw(_NON_WS)})")]
    else:
        fields = [("ne", f"length({T}) > 0"), ("w", "CAST(0 AS BIGINT)"), ("fs", "false"), ("ls", "false")]
    fields += [(f"k{i}", f"contains({lower}, {_raw(k)})") for i, k in enumerate(spec.keywords)]
    fields += [(f"m{i}", f"contains({T}, {_raw(m)})") for i, m in enumerate(spec.markers)]
    fields += [(f"r{i}", f"CAST(regexp_count({lower}, {_raw(r)}) AS BIGINT)") for i, r in enumerate(spec.regexes)]
    return F.expr("named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields) + ")")


def summary(text: Column | str, spec: Spec) -> Column:
    """Summary struct of a text.  ``text`` is a Column, or a column name / SQL
    expression: then the summary is one SQL expression, built with a single call
    into the JVM however many keywords the spec has."""
    literals = (NON_WS_RUN, _NON_WS) + spec.keywords + spec.markers + spec.regexes
    if isinstance(text, str) and not any("'" in x for x in literals):
        return _summary_sql(text, spec)
    text = F.col(text) if isinstance(text, str) else text
    lower = F.lower(text)
    if spec.words:
        fields = [(F.length(text) > 0).alias("ne"), F.regexp_count(text, F.lit(NON_WS_RUN)).cast("long").alias("w"),
                  F.regexp_like(F.substring(text, 1, 1), F.lit(_NON_WS)).alias("fs"),
                  F.regexp_like(F.substring(text, -1, 1), F.lit(_NON_WS)).alias("ls")]
    else:
        fields = [(F.length(text) > 0).alias("ne"), F.lit(0).cast("long").alias("w"), F.lit(False).alias("fs"),
                  F.lit(False).alias("ls")]
    fields += [lower.contains(k).alias(f"k{i}") for i, k in enumerate(spec.keywords)]
    fields += [text.contains(m).alias(f"m{i}") for i, m in enumerate(spec.markers)]
    fields += [F.regexp_count(lower, F.lit(r)).cast("long").alias(f"r{i}") for i, r in enumerate(spec.regexes)]
    return F.struct(*fields)


def merge(a: str, b: str, spec: Spec) -> Column:
    """Summary of the concatenation a + b (junction-safe parts only).

    ``a`` and ``b`` are SQL expressions of two summaries (e.g. column names).  The
    merge is written as one SQL expression, so building it costs one call into
    the JVM however many fields the summary has.
    """
    A, B = f"({a})", f"({b})"
    fields = [("ne", f"{A}.ne OR {B}.ne"),
              ("w", f"{A}.w + {B}.w - CAST({A}.ne AND {B}.ne AND {A}.ls AND {B}.fs AS BIGINT)"),
              ("fs", f"CASE WHEN {A}.ne THEN {A}.fs ELSE {B}.fs END"),
              ("ls", f"CASE WHEN {B}.ne THEN {B}.ls ELSE {A}.ls END")]
    fields += [(f"k{i}", f"{A}.k{i} OR {B}.k{i}") for i in range(len(spec.keywords))]
    fields += [(f"m{i}", f"{A}.m{i} OR {B}.m{i}") for i in range(len(spec.markers))]
    fields += [(f"r{i}", f"{A}.r{i} + {B}.r{i}") for i in range(len(spec.regexes))]
    return F.expr("named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields) + ")")


def grouped(s: str, spec: Spec, groups: tuple[tuple[str, ...], ...]) -> Column:
    """A summary with one flag for each group of keywords (any of them) in place of one for each
    keyword.  It merges like a summary of :func:`group_spec`: any of a group is in the whole
    where any of it is in a part.  Fewer fields keep the code that Spark generates for merges
    of expanded rows within what the JVM compiles."""
    flags = [" OR ".join(f"({s}).k{spec.keywords.index(k)}" for k in g) for g in groups]
    fields = [(n, f"({s}).{n}") for n in ("ne", "w", "fs", "ls")] + [(f"k{i}", f) for i, f in enumerate(flags)]
    fields += [(f"m{i}", f"({s}).m{i}") for i in range(len(spec.markers))] + [(f"r{i}", f"({s}).r{i}") for i in range(len(spec.regexes))]
    return F.expr("named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields) + ")")


def group_spec(spec: Spec, groups: tuple[tuple[str, ...], ...]) -> Spec:
    """The shape of summaries that :func:`grouped` makes (its keywords only name the groups)."""
    return Spec(tuple(" | ".join(g) for g in groups), spec.markers, spec.regexes, spec.words)


class View:
    """Read features out of a summary by keyword / marker / regex text."""

    def __init__(self, s: Column, spec: Spec):
        self.s, self.spec = s, spec

    def words(self) -> Column:
        return self.s["w"]

    def has(self, kw: str) -> Column:
        return self.s[f"k{self.spec.keywords.index(kw)}"]

    def has_marker(self, m: str) -> Column:
        return self.s[f"m{self.spec.markers.index(m)}"]

    def count(self, regex: str) -> Column:
        return self.s[f"r{self.spec.regexes.index(regex)}"]

    def any_of(self, kws) -> Column:
        group = " | ".join(kws)
        if len(kws) > 1 and group in self.spec.keywords:            # of a grouped summary
            return F.lit(False) | self.has(group)
        out = F.lit(False)
        for k in kws:
            out = out | self.has(k)
        return out

    def n_present(self, kws) -> Column:
        out = F.lit(0)
        for k in kws:
            out = out + self.has(k).cast("int")
        return out.cast("int")

    def any_marker(self, ms) -> Column:
        out = F.lit(False)
        for m in ms:
            out = out | self.has_marker(m)
        return out
