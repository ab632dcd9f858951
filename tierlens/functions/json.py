"""Strict JSON checks that agree with Python's ``json.loads``.

Spark's JSON reader is lenient about trailing text when reading a single value,
so validity is decided by parsing the text inside two different wrappers: as the
only element of an array and as the value of an object field.  Each wrapper alone
can be fooled by crafted text; text that parses cleanly inside both is one JSON
value.  ``NaN``, ``Infinity`` and ``-Infinity`` are accepted and duplicate keys are allowed, as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false"}


def is_json(s: Column) -> Column:
    """True when ``s`` is exactly one valid JSON value (NULL input -> False)."""
    arr = F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>", _STRICT)
    obj = F.from_json(F.concat(F.lit('{"w":'), s, F.lit("}")), "w string, _corrupt_record string",
                      {**_STRICT, "columnNameOfCorruptRecord": "_corrupt_record"})
    # the reader also takes +Infinity and INF, which Python does not, outside strings
    suspect = s.contains("+I") | s.contains("INF")
    bare = F.regexp_replace(s, r'"(?:[^"\\]|\\.)*"', '""')
    number_ok = ~suspect | ~bare.rlike("[+]I|INF")
    return F.coalesce((F.size(arr) == 1) & obj["_corrupt_record"].isNull() & number_ok, F.lit(False))


def top_level_keys(obj_text: Column) -> Column:
    """Distinct top-level keys of a JSON object text, in first-occurrence order."""
    return F.array_distinct(F.map_keys(F.from_json(obj_text, "map<string,string>", _STRICT)))


def py_list_repr(keys: Column | str) -> Column:
    """Python ``repr`` of a list of plain strings, e.g. ``['a', 'b']``.

    Quotes follow Python: single quotes, or double quotes when the text holds a
    single quote and no double quote.  Backslashes are doubled.  ``keys`` may be a
    Column or a SQL expression (e.g. a column name): then the result is one SQL
    expression, with the quote and backslash characters written as ``chr`` codes.
    """
    if isinstance(keys, str):
        q, dq, bs = "chr(39)", "chr(34)", "chr(92)"
        k2 = f"replace(k, {bs}, concat({bs}, {bs}))"
        one = (f"CASE WHEN contains(k, {q}) AND NOT contains(k, {dq}) THEN concat({dq}, {k2}, {dq}) "
               f"ELSE concat({q}, replace({k2}, {q}, concat({bs}, {q})), {q}) END")
        return F.expr(f"concat('[', array_join(transform(({keys}), k -> {one}), ', '), ']')")

    def one(k):
        k2 = F.replace(k, F.lit("\\"), F.lit("\\\\"))
        dq = k.contains("'") & ~k.contains('"')
        return F.when(dq, F.concat(F.lit('"'), k2, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(k2, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(keys, one), ", "), F.lit("]"))
