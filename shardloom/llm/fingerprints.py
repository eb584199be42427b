"""Document fingerprints by winnowing, in column expressions only.

A text is taken as words: runs of letters, marks and digits, lower-cased; a run of more than 24 code points, such as text
without blanks, is taken code point by code point. Every five words in a row are a gram. Its hash is a cyclic polynomial
of the word hashes: the next gram's hash is this one turned by a bit, less the word that leaves, plus the word that
enters. Of each eight grams in a row the one with the smallest hash is kept, the rightmost among equals, with
its place. So two texts that share twelve words in a row share a fingerprint, and nothing shorter than a gram matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.session import broadcast_if_small, materialize

GRAM, WINDOW = 5, 8
_CHAR = r"[\p{L}\p{M}\p{N}]"
WORD = rf"(?<!{_CHAR}){_CHAR}{{1,24}}+(?!{_CHAR})|{_CHAR}"
# Marks are a gram's hash and the place of its first word.
MARKS = "array<struct<hash:bigint,word:bigint>>"
# The order of grams in a window: 31 bits of the hash, then 32 bits that fall with the place.
_PLACES = (1 << 32) - 1
# Rows that one slot of ids is meant to hold, and quantiles of ids that slots are worked out between.
SLOT_ROWS, QUANTILES = 1000, 32
_SLOTS = 1 << 40
# Slot heads that one broadcast may hold; more are joined by an exchange.
BROADCAST_HEADS = 1_000_000


def _turned(x: Column, bits: int) -> Column:
    bits %= 64
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _after(column: str, n: int) -> Column:
    """The array without its first ``n`` values."""
    return F.slice(column, n + 1, F.greatest(F.size(column) - n, F.lit(0)))


def _joined(first: str, second: Column, words: int) -> Column:
    """Hashes of runs from those of their beginnings and those of their last ``words`` words."""
    return F.zip_with(F.col(first), second, lambda a, b: _turned(a, words).bitwiseXOR(b))


def _with_grams(df: DataFrame, words: str, out: str, gram: int) -> DataFrame:
    """Replace the array of word hashes by the hashes of all grams; fewer words, but not none, are one gram.

    Hashes of ``a`` words and of the ``b`` words behind them make those of ``a + b`` words, so the length is doubled in each
    pass. Arrays stay as long as the words; values at the end that lack words are null and cut off in the end.
    """
    kept = [c for c in df.columns if c != words]
    # Hashes of runs of 1, 2, 4, ... words, and of as many words as are put together so far.
    runs, total, have = words, None, 0
    step, length = df, 1
    while length <= gram:
        if gram & length:
            if total is None:
                step, total = step.withColumn("__total", F.col(runs)), "__total"
            else:
                step = step.withColumn("__total", _joined(runs, _after("__total", length), have))
            have += length
        length *= 2
        if length <= gram:
            step, runs = step.withColumn("__runs", _joined(runs, _after(runs, length // 2), length // 2)), "__runs"
    grams = (
        F.when(F.size(words) >= gram, F.slice("__total", 1, F.size(words) - (gram - 1)))
        .when(F.size(words) > 0, F.array(F.xxhash64(words)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    return step.select(*kept, grams.alias(out))


def _with_least(df: DataFrame, values: str, window: int) -> DataFrame:
    """Replace the array by the least value of each window, each once, in order; fewer values are one window."""
    kept = [c for c in df.columns if c != values]
    step, width = df.withColumn("__n", F.size(values)), 1
    while width < window:
        more = min(width, window - width)
        step = step.withColumn(values, F.zip_with(F.col(values), _after(values, more), lambda a, b: F.least(a, b)))
        width += more
    inside = F.slice(values, 1, F.greatest(F.col("__n") - (window - 1), F.lit(1)))
    return step.select(*kept, F.array_distinct(inside).alias(values))


def winnow(df: DataFrame, text: str = "text", name: str = "marks", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """All columns of ``df`` and ``name``: the marks of each row's text, in the order of their places.

    A null, empty or wordless text has no marks. A text of fewer words than a gram is one gram, and fewer grams than a
    window are one window. Equal texts have equal marks. A column called ``name`` is replaced. A text is one row's
    work: its word and gram hashes, 8 bytes each, are held at once. Each step is a projection of its own, so no array is
    worked out twice.
    """
    kept = [c for c in df.columns if c != name]
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    step = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("__words"))
    step = _with_grams(step, "__words", "__grams", gram)
    order = F.transform("__grams", lambda x, i: (
        F.shiftleft(F.shiftrightunsigned(x, 33), 32).bitwiseOR(F.lit(_PLACES) - i.cast("bigint"))
    ))
    step = _with_least(step.select(*kept, "__grams", order.alias("__order")), "__order", window)
    place = F.transform("__order", lambda x: F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES)))
    step = step.select(*kept, "__grams", place.alias("__places"))
    marks = F.transform("__places", lambda p: F.struct(F.get("__grams", p.cast("int")).alias("hash"), p.alias("word")))
    return step.select(*kept, marks.cast(MARKS).alias(name))


def written(marks: str) -> Column:
    """Marks as text: hash in hexadecimal and place, comma-joined."""
    return F.array_join(F.transform(marks, lambda m: F.concat(F.hex(m["hash"]), F.lit(":"), m["word"].cast("string"))), ",")


def hashes(marks: str) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: m["hash"]))


def likeness(left: Column, right: Column) -> Column:
    """Shared part of two sets of hashes, 0 to 1. Two empty sets are alike."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def _slot(bounds: list[int], spans: dict[int, tuple[int, float]] | None = None) -> Column:
    """The part of ids between two quantiles, or, with each part's least id and width, the slot in it.

    Neither ever falls as the id grows. A null id is in the part and slot before all others.
    """
    doc_id = F.col("doc_id")
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= doc_id)) + 1
    part = F.when(doc_id.isNull(), 0).otherwise(part)
    if spans is None:
        return part
    # An id that was not there when the spans were taken goes to a neighbouring slot.
    low, wide = ([spans.get(p, (0, 1.0))[i] for p in range(len(bounds) + 2)] for i in (0, 1))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), part + 1)
    inside = F.floor((doc_id.cast("double") - pick(low)) / pick(wide))
    return part.cast("bigint") * _SLOTS + F.coalesce(F.greatest(inside, F.lit(0)), F.lit(0)).cast("bigint")


def with_next(docs: DataFrame, columns: dict[str, str], prepare=lambda df: df) -> DataFrame:
    """``doc_id, text``, what ``prepare`` adds, and of the row after each the columns that ``columns`` names anew.

    Rows stand in ascending order of id (null first), equal ids by text (null first); after the last comes the first. Ids are cut
    into slots of about a thousand rows, so rows meet their successor by one exchange, and the first row of each slot is
    sent to the slot before as well. ``prepare`` is applied behind that exchange. Slots lie between quantiles of the
    ids, so any spread of ids is cut evenly but for ids crowded within a thirtieth of them; rows of one id share a slot.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = docs.select("doc_id")
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 10_000).alias("q")).first()["q"]
    bounds = sorted(set(found or []))
    spans = {
        r["part"]: (r["low"] or 0, max(1.0, ((r["high"] or 0) - (r["low"] or 0) + 1) / -(-r["n"] // SLOT_ROWS)))
        for r in ids.groupBy(_slot(bounds).alias("part"))
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    }
    slot = _slot(bounds, spans)
    heads = materialize(ids.groupBy(slot.alias("slot")).agg(F.min("doc_id").alias("head")), "heads")
    part = F.shiftrightunsigned("slot", 40).alias("part")
    last = {r["part"]: r["slot"] for r in heads.groupBy(part).agg(F.max("slot").alias("slot")).collect()}
    parts = sorted(last)
    before = F.create_map(*[F.lit(x) for i, p in enumerate(parts) for x in (p, last[parts[i - 1]])]) if parts else F.lit(None)
    in_part = Window.partitionBy("part").orderBy("slot")
    heads = heads.select("slot", "head", part).select(
        "head", F.coalesce(F.lag("slot").over(in_part), F.element_at(before, F.col("part")) if parts else before).alias("slot")
    )
    guests = docs.join(broadcast_if_small(heads, BROADCAST_HEADS), F.col("doc_id").eqNullSafe(F.col("head")))
    rows = docs.withColumn("slot", slot).withColumn("guest", F.lit(False)).unionByName(
        guests.select("doc_id", "text", "slot", F.lit(True).alias("guest"))
    )
    after = Window.partitionBy("slot").orderBy("guest", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    rows = prepare(rows.repartition("slot"))
    follow = [F.lead(c).over(after).alias(new) for c, new in columns.items()]
    return rows.select(*rows.columns, *follow).filter("NOT guest").drop("slot", "guest")


def edited_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of the text whose last half is replaced by the beginning of the next document's.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A null text is empty.
    Rows that repeat an id stand each for itself (see ``with_next`` for their order); a single row is its own next.
    An empty table gives no rows.
    """
    marked = with_next(
        docs, {"text": "next_text", "hashes": "next_hashes"},
        lambda df: winnow(df, "text", "marks", gram, window).withColumn("hashes", hashes("marks")),
    )
    own, after = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("next_text"), F.lit(""))
    half = F.floor(F.length(own) / 2).cast("int")
    edited = F.concat(F.substring(own, F.lit(1), F.length(own) - half), F.substring(after, F.lit(1), half))
    kept = ["doc_id", "n_chars", "edited_sha256", "marks", "hashes", "next_hashes"]
    rows = marked.select(
        "doc_id", F.length(own).cast("bigint").alias("n_chars"), edited.alias("edited"), "marks", "hashes", "next_hashes"
    ).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = winnow(rows, "edited", "edited_marks", gram, window).withColumn("edited_hashes", hashes("edited_marks"))
    return rows.select(
        *kept[:3], written("marks").alias("fingerprint"), written("edited_marks").alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
