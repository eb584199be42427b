"""Caption text functions, JVM-side column expressions, and how tasks cut batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip removes, as a list and as a Java character class.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

# Han, kana and Hangul ranges that mark a caption as CJK.
CJK_CLASS = "[一-鿿぀-ヿ가-힯]"

# Fixed value: fewest letters a non-CJK caption needs.
MIN_LETTERS = 3


def py_strip(c: Column) -> Column:
    """Unicode strip. Only the ends of the text are looked at."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def nonblank(c: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(py_strip(c), F.lit(""))


def utf8_ignore(c: Column) -> Column:
    """Bytes to text, undecodable bytes dropped. A genuine U+FFFD is dropped as well."""
    return F.regexp_replace(F.make_valid_utf8(c.cast("string")), "�", "")


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def has_cjk(c: Column) -> Column:
    return F.coalesce(c.rlike(CJK_CLASS), F.lit(False))


def cleaned_for_validity(c: Column) -> Column:
    """Validity and its language check look at the text without ``#``."""
    return py_strip(F.replace(py_strip(c), F.lit("#"), F.lit("")))


def enough_text(c: Column) -> Column:
    """The part of caption validity that needs no language detection."""
    clean = cleaned_for_validity(c)
    return F.coalesce(
        nonblank(c).isNotNull() & (has_cjk(clean) | (letter_count(clean) >= MIN_LETTERS)),
        F.lit(False),
    )


def safe_caption(c: Column, data_type: str) -> Column:
    """Coerce any caption to text: strings as they are, bytes decoded, the rest cast."""
    if data_type == "binary":
        return utf8_ignore(c)
    return c.cast("string")


def join_path(directory: str, c: Column) -> Column:
    """Directory plus file name; an absolute name stands by itself."""
    base = directory if directory.endswith("/") else directory + "/"
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(base), c))


def slices(texts: pa.Array, most_bytes: int, most_rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of at most that many bytes and rows, or of one text that is longer."""
    n = len(texts)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most_bytes, "right")))
        hi = min(hi, lo + most_rows) if most_rows else hi
        yield lo, hi
        lo = hi
