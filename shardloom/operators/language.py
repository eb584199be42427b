"""Language detection by a character-trigram model: trained by Spark, applied to texts where they lie.

Log-probabilities are whole micro-nats, so a text's score is an exact integer sum and does
not depend on partitioning or on the order of rows. A gram is a number of three times 21 bits; the profile is a
sorted table of such numbers with a score for each language, looked up for a whole batch of texts at a time. No
row stands for a gram, and neither grams nor texts are exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.text import MIN_LETTERS, cleaned_for_validity, has_cjk, letter_count, nonblank, py_strip, slices
from shardloom.session import materialize

# Least probability of a valid caption, and of English that stays as it is.
MIN_LANG_PROB = 0.75
MIN_EN_PROB = 0.90

# The answer when a text has no usable character.
FALLBACK_LANG, FALLBACK_PROB = "en", 0.0

TEMPERATURE = 3.0
MICRO = 1_000_000
# Bytes of one broadcast part of a profile; a larger profile is looked up part by part.
PROFILE_BYTES = 64 << 20
# Code points that are looked up at once.
SLICE = 1 << 20
# Cells of a cube of code points in which grams are counted without sorting them.
CELLS = 1 << 21

# Every overlapping trigram: an empty match with a captured look-ahead, never inside a surrogate pair.
TRIGRAM = r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{3}))"


def letters_only(text: Column) -> Column:
    """Runs of anything but letters and marks become one blank; blanks pad both ends."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"[^\p{L}\p{M}]+", " ")


def trigrams(text: Column) -> Column:
    return F.regexp_extract_all(letters_only(text), F.lit(TRIGRAM), F.lit(1))


def trigram_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, gram, n`` over whole texts, counted batch by batch before the exchange."""
    texts = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters_only(F.col(text)).alias("text"))
    kind = texts.schema["lang"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for at, name in enumerate(langs.dictionary):
                mine = batch.column("text").filter(pc.equal(langs.indices, at))
                for lo, hi in slices(mine, SLICE):
                    keys, n = _counted(*_code_points(mine.slice(lo, hi - lo)))
                    # No row of another language comes between, so the name is one value repeated.
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(keys)), _gram_texts(keys), pa.array(n)], names=["lang", "gram", "n"])

    return texts.mapInArrow(count, f"lang {kind}, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageProfile:
    """Add-one smoothed model: a row per gram with one score column per language.

    ``unseen`` holds the score of a gram no language has seen.
    """

    langs: tuple[str, ...]
    grams: DataFrame
    unseen: tuple[int, ...]
    _scorers: list[Callable[[Column], Column]] = field(default_factory=list, init=False, repr=False, compare=False)

    def scorers(self) -> list[Callable[[Column], Column]]:
        """A function of texts for each part of the profile, made once; all parts together give a text's score."""
        if not self._scorers:
            n = self.grams.count()
            parts = max(1, -(-n * (8 + 4 * len(self.langs)) // PROFILE_BYTES))
            for part in range(parts):
                mine = self.grams if parts == 1 else self.grams.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part)
                self._scorers.append(_scorer(mine, self.unseen))
        return self._scorers


def micro_log(count: Column, total: Column) -> Column:
    return F.round(F.ln(count / total) * F.lit(float(MICRO))).cast("bigint")


def train_language_profile(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageProfile:
    """Train on labelled texts. The counts are written once and feed every later step.

    Only one total per language reaches the driver.
    """
    counts = materialize(trigram_counts(df, text, lang), "trigrams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = tuple(sorted(totals))
    wide = counts.groupBy("gram").agg(
        F.sum("n").alias("n"),
        *[F.coalesce(F.sum(F.when(F.col("lang") == g, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, g in enumerate(langs)]
    )
    vocabulary = wide.count()
    sizes = [float(totals[g] + vocabulary) for g in langs]
    scored = wide.select(
        "gram", *[micro_log(F.col(f"n{i}") + F.lit(1.0), F.lit(size)).alias(f"s{i}") for i, size in enumerate(sizes)]
    )
    unseen = tuple(round(math.log(1.0 / size) * MICRO) for size in sizes)
    return LanguageProfile(langs, materialize(scored, "profile"), unseen)


def _gram_ids(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A small number for each overlapping gram of at least three code points, and which numbers occur with their ascending keys.

    Where the code points are of few kinds, a gram's number is a cell of a cube of them, and nothing is sorted.
    """
    kinds = np.flatnonzero(np.bincount(points))
    n = len(kinds)
    if n**3 > CELLS:
        p = points.astype(np.int64)
        keys, ids = np.unique(p[:-2] << 42 | p[1:-1] << 21 | p[2:], return_inverse=True)
        return ids, np.arange(len(keys)), keys
    rank = np.zeros(kinds[-1] + 1, np.int32)
    rank[kinds] = np.arange(n, dtype=np.int32)
    codes = rank[points]
    ids = (codes[:-2] * np.int32(n) + codes[1:-1]) * np.int32(n) + codes[2:]
    found = np.flatnonzero(np.bincount(ids))
    return ids, found, kinds[found // (n * n)] << 42 | kinds[found // n % n] << 21 | kinds[found % n]


def _counted(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the grams inside the texts, and how often each occurs."""
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, found, keys = _gram_ids(points)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    n = np.bincount(ids[row[:-2] == row[2:]], minlength=found[-1] + 1)[found]
    return keys[n > 0], n[n > 0]


def _gram_texts(keys: np.ndarray) -> pa.Array:
    points = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype("<u4")
    joined = points.tobytes().decode("utf-32-le")
    return pa.array([joined[i : i + 3] for i in range(0, len(joined), 3)], pa.string())


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of an Arrow array of texts, and how many each text has; a null is empty."""
    texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(texts.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), lengths


def _scorer(grams: DataFrame, unseen: tuple[int, ...]) -> Callable[[Column], Column]:
    """``seen`` and, for each language, the sum of what a gram of this part scores above an unseen one."""
    table = grams.toArrow()
    points, _ = _code_points(table.column("gram").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    points = points.astype(np.int64)
    keys = points[0::3] << 42 | points[1::3] << 21 | points[2::3]
    order = np.argsort(keys)
    above = np.zeros((len(keys) + 1, len(unseen)), np.int32)
    for i, base in enumerate(unseen):
        above[:-1, i] = table.column(f"s{i}").to_numpy()[order] - base
    shared = grams.sparkSession.sparkContext.broadcast((keys[order], above))

    @F.arrow_udf("struct<grams:bigint,above:array<bigint>>")
    def score(texts: pa.Array) -> pa.Array:
        known, gains = shared.value
        n, width = len(texts), gains.shape[1]
        count, sums = np.zeros(n, np.int64), np.zeros((n, width), np.int64)
        for lo, hi in slices(texts, SLICE):
            points, lengths = _code_points(texts.slice(lo, hi - lo))
            if len(points) < 3:
                continue
            ids, present, keys = _gram_ids(points)
            at = np.full(len(keys), len(known))
            if len(known):
                near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                at = np.where(known[near] == keys, near, len(known))
            # A text's grams are neighbours, the last two of them reach into the next text.
            start = np.cumsum(lengths) - lengths
            end = np.minimum(np.maximum(start, start + lengths - 2), len(ids))
            start = np.minimum(start, len(ids))
            count[lo:hi] = end - start
            gain, total = np.zeros(present[-1] + 1, np.int32), np.zeros(len(ids) + 1, np.int64)
            for i in range(width):
                gain[present] = gains[at, i]
                np.cumsum(gain[ids], dtype=np.int64, out=total[1:])
                sums[lo:hi, i] = total[end] - total[start]
        above = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(sums.ravel()))
        return pa.StructArray.from_arrays([pa.array(count), above], names=["grams", "above"])

    # A filter on the answer must not make it work twice.
    score = score.asNondeterministic()
    return lambda text: score(letters_only(text))


def with_language(
    df: DataFrame, profile: LanguageProfile, texts: dict[str, Column], temperature: float = TEMPERATURE
) -> DataFrame:
    """``df`` and, for each name and text, a struct ``lang, prob``. A null text reads as one without letters."""
    scorers = profile.scorers()
    scored = df.select("*", *[
        score(text).alias(f"__{name}_{i}") for name, text in texts.items() for i, score in enumerate(scorers)
    ])
    answers = []
    for name in texts:
        parts = [F.col(f"__{name}_{i}") for i in range(len(scorers))]
        grams = parts[0]["grams"]
        totals = [
            reduce(lambda a, b: a + b, [p["above"][i] for p in parts]) + grams * F.lit(u) for i, u in enumerate(profile.unseen)
        ]
        answers.append(F.struct(*decide(profile.langs, temperature, grams, totals)).alias(name))
    return scored.select(*df.columns, *answers)


def detect_language(
    df: DataFrame, profile: LanguageProfile, keys: list[str], text: str = "text",
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """``keys, lang, prob`` for every row. Each text is scored where it lies."""
    base = df.select(*keys, F.col(text).alias("__text"))
    found = with_language(base, profile, {"__found": F.col("__text")}, temperature)
    return found.select(*keys, "__found.lang", "__found.prob")


def decide(langs: tuple[str, ...], temperature: float, grams: Column, scores: list[Column]) -> list[Column]:
    """Best language and its softmax share; a tie goes to the first code."""
    if not langs:
        return [F.lit(FALLBACK_LANG).alias("lang"), F.lit(FALLBACK_PROB).alias("prob")]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    weights = [F.exp((s - best) / F.lit(temperature * MICRO)) for s in scores]
    share = F.lit(1.0) / reduce(lambda a, b: a + b, weights)
    name = F.coalesce(*[F.when(s == best, F.lit(g.lower())) for s, g in zip(scores, langs)])
    some = grams > 0
    return [
        F.when(some, name).otherwise(F.lit(FALLBACK_LANG)).alias("lang"),
        F.when(some, share).otherwise(F.lit(FALLBACK_PROB)).alias("prob"),
    ]


def assess_captions(
    df: DataFrame, profile: LanguageProfile, keys: list[str], text: str = "text",
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """``df`` plus ``letters, has_cjk, valid, lang, prob``.

    Validity is judged without ``#``, routing sees the stripped text with it. A text that
    holds no ``#`` is detected once for both. A null text is invalid.
    """
    stripped = py_strip(F.col(text))
    clean = cleaned_for_validity(F.col(text))
    # Only a text that reads otherwise without its marks is looked at again.
    other = F.when(stripped != clean, clean)
    judged = with_language(df, profile, {"__whole": stripped, "__clean": other}, temperature)
    prob = F.when(stripped == clean, F.col("__whole.prob")).otherwise(F.col("__clean.prob"))
    # Letters are counted once, for themselves and for validity.
    counted = judged.withColumns({"letters": F.coalesce(letter_count(clean), F.lit(0)).cast("bigint"), "has_cjk": has_cjk(clean)})
    enough = nonblank(F.col(text)).isNotNull() & (F.col("has_cjk") | (F.col("letters") >= MIN_LETTERS))
    return counted.withColumns(
        {"lang": F.col("__whole.lang"), "prob": F.col("__whole.prob"), "valid": enough & (prob >= MIN_LANG_PROB)}
    ).drop("__whole", "__clean")
