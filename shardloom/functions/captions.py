"""Caption and image choice on samples ``(json, txt, jpg, png)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardloom.functions.json import json_object, json_string, json_type, once
from shardloom.functions.text import nonblank, py_strip


def caption_en_first(json: Column, txt: Column) -> Column:
    """English caption, else original caption, else the text file, stripped."""
    return once(
        json_object(json),
        lambda v: F.coalesce(
            nonblank(json_string(v, "caption_en")),
            nonblank(json_string(v, "caption")),
            py_strip(txt),
            F.lit(""),
        ),
    )


def caption_raw(json: Column, txt: Column) -> Column:
    """Original caption, else the text file, stripped."""
    caption = once(json_object(json), lambda v: nonblank(json_string(v, "caption")))
    return F.coalesce(caption, py_strip(txt), F.lit(""))


def caption_for_translation(json: Column, txt: Column) -> Column:
    """Caption handed to the translator, or null when there is none.

    The text file is the fallback only for a missing or null caption. A blank caption
    yields nothing, and so does one that is not a string.
    """
    def chosen(v: Column) -> Column:
        kind = json_type(v, "caption")
        return F.when(kind.isNull() | (kind == "VOID"), txt).otherwise(json_string(v, "caption"))

    return once(once(json_object(json), chosen), lambda text: F.when(nonblank(text).isNotNull(), text))


def english_caption(json: Column) -> Column:
    """Non-blank ``caption_en`` as stored, else null."""
    text = json_string(json_object(json), "caption_en")
    return F.when(nonblank(text).isNotNull(), text)


def pick_image(jpg: Column, png: Column) -> Column:
    """``jpg`` when present and not empty, else ``png``."""
    return F.coalesce(F.when(F.octet_length(jpg) > 0, jpg), png)


def has_image(image: Column) -> Column:
    return image.isNotNull() & (F.octet_length(image) > 0)
