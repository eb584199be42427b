"""Tolerant JSON handling on VARIANT values.

``get_json_object`` cannot tell ``5`` from ``"5"``, so the type is asked of the variant.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _without_constants(c: Column) -> Column:
    """The text with the bare numbers ``NaN`` and ``Infinity``, which Python's parser takes, as JSON null.

    Strings are matched first and kept, with a mark behind their end that is taken off again. The mark is no
    legal character of JSON text.
    """
    marked = F.regexp_replace(c, r'("(?:[^"\\]|\\.)*+")|-?\b(?:NaN|Infinity)\b', "$1\u0001")
    return F.replace(F.replace(marked, F.lit('"\u0001'), F.lit('"')), F.lit("\u0001"), F.lit("null"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def json_object(c: Column) -> Column:
    """Parsed object, or null for anything malformed or not an object.

    ``NaN`` and ``Infinity`` count as values that are no string, so the other fields stay readable.
    """
    v = F.coalesce(
        F.try_parse_json(c), F.when(c.rlike("NaN|Infinity"), F.try_parse_json(_without_constants(c)))
    )
    return once(v, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT<"), v))


def json_type(v: Column, key: str) -> Column:
    """Type name of one field; null when the field is missing, ``VOID`` for JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, _path(key), "variant"))


def json_string(v: Column, key: str) -> Column:
    """The field's text; any other type counts as absent."""
    return F.when(json_type(v, key) == "STRING", F.try_variant_get(v, _path(key), "string"))


@F.pandas_udf(StringType())
def _put(text: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
    out = []
    for t, k, v in zip(text, key, value):
        if v is None:
            out.append(t)
            continue
        try:
            whole = json.loads(t) if t is not None else {}
        except (ValueError, RecursionError):
            whole = {}
        whole = whole if isinstance(whole, dict) else {}
        whole[k] = v
        done = json.dumps(whole, ensure_ascii=False)
        # Half a surrogate pair has no UTF-8 form; escaped it stays what it was.
        out.append(done if _encodes(done) else json.dumps(whole))
    return pd.Series(out, dtype=object)


def _encodes(text: str) -> bool:
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


# Blanks that JSON allows around a value.
_BLANKS = " \t\n\r"


def _open_object(c: Column, key: str) -> Column:
    """True where the text is one JSON object of distinct keys that lacks ``key`` and writes nothing as ``\\u``.

    Spark's readers of keys and lengths stop at the end of a value and do not ask what follows. As the only element of
    an array and as the only field of an object the text must be read whole: what ends one of them early breaks the other.
    They also take single quotes and control characters in strings, which the variant's parser refuses.
    """
    keys = F.json_object_keys(c)
    whole = (F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1) & (
        F.json_object_keys(F.concat(F.lit('{"x":'), c, F.lit("}"))) == F.array(F.lit("x"))
    )
    distinct = (F.size(F.array_distinct(keys)) == F.size(keys)) & ~F.array_contains(keys, key)
    return F.coalesce(~c.contains("\\u") & ~c.startswith("\ufeff") & distinct & whole & F.try_parse_json(c).isNotNull(), F.lit(False))


def _appended(c: Column, key: str, value: Column) -> Column:
    """The object's own text with one more key before its end."""
    inner = F.rtrim(c, F.lit(_BLANKS))
    inner = F.rtrim(F.left(inner, F.length(inner) - 1), F.lit(_BLANKS))
    comma = F.when(F.size(F.json_object_keys(c)) > 0, ", ").otherwise("")
    text = F.to_json(F.array(value))
    text = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.concat(inner, comma, F.lit(json.dumps(key, ensure_ascii=False) + ": "), text, F.lit("}"))


def set_json_string(c: Column, key: str, value: Column) -> Column:
    """JSON text with ``key`` set to ``value`` and every other key kept.

    A null ``value`` leaves the text untouched. Absent or malformed JSON turns into an
    object that holds this key alone. Numbers of any length, ``NaN`` and the order of the keys stay, which a
    variant cannot hold. An object that lacks the key keeps its own text, and the key is written before its end without
    leaving the JVM. Only the rest is parsed and written anew in Arrow batches: texts that have the key already or any
    key twice, ``\\u`` escapes, ``NaN``, malformed texts.
    """
    short = _open_object(c, key)
    rest = value.isNotNull() & ~short
    anew = _put(F.when(rest, c), F.lit(key), F.when(rest, value))
    # What was written anew is never null, so the text need not be judged a second time.
    return F.when(value.isNull(), c).otherwise(F.coalesce(anew, _appended(c, key, value)))
