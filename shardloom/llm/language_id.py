"""Language of a text by rank-order profiles.

A language's profile is the ranked list of its most frequent character n-grams over all learning texts. A text's own
n-grams are ranked the same way, and each profile is at the distance by which ranks are out of place; an
n-gram that the profile lacks is as far out as can be. The nearest profile names the language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import held_out, utf8
from shardloom.session import materialize

LONGEST, PROFILE = 3, 300
# Profiles that one broadcast holds; more languages are compared block by block.
BLOCK = 2_000
UNDETERMINED = "und"
_MERGE_AT = 1 << 22


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its place among letters (marks count with their letters), else 32, the blank."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = c
    return table


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngrams(text: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to ``longest`` (at most 3) characters as 21-bit characters in one number, and counts.

    Lower-cased; anything but letters is a blank, blanks in a row are one, and words have one on both sides.
    A blank alone is no n-gram.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    chars = np.r_[np.uint32(32), _letters()[points], np.uint32(32)].astype(np.uint64)
    blank = chars == 32
    chars = chars[~(blank & np.r_[False, blank[:-1]])]
    grams = [chars[chars != 32]]
    wide = chars
    for n in range(2, longest + 1):
        wide = (wide[:-1] << np.uint64(21)) | chars[n - 1 :]
        grams.append(wide)
    joined = np.sort(np.concatenate(grams))
    if not len(joined):
        return joined, np.empty(0, np.int64)
    edges = np.flatnonzero(np.r_[True, joined[1:] != joined[:-1]])
    return joined[edges], np.diff(np.r_[edges, len(joined)])


def ranked(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The ``most`` most frequent n-grams by falling count, ties by the smaller n-gram."""
    if len(grams) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= floor
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:most]


def learn_profiles(docs: DataFrame, most: int = PROFILE, longest: int = LONGEST) -> DataFrame:
    """``lang, gram, rank``: the profile of every language over all given texts.

    Rows with a null language or text, or without letters, teach nothing. Each task adds up its own counts first. The
    top of a language is found in pieces by hash of the n-gram, then among the tops of the pieces.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("bytes").to_pylist()):
                grams, counts = ngrams(text.decode("utf-8", "replace"), longest)
                held.setdefault(lang, []).append((grams, counts))
                size += len(grams)
            if size > _MERGE_AT:
                held, size = {k: [_merged(v)] for k, v in held.items()}, 0
        for lang, parts in held.items():
            grams, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts),
            ], names=["lang", "gram", "n"])

    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", utf8().alias("bytes"))
    counted = (
        usable.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("piece", F.pmod(F.xxhash64("gram"), F.lit(64)))
    )
    falling = [F.desc("n"), "gram"]
    pieces = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*falling)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*falling))
    top = pieces.filter(F.col("r") <= most).withColumn("rank", rank - 1)
    return top.filter(F.col("rank") < most).select("lang", "gram", "rank")


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    if not len(grams):
        return grams, counts
    edges = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[edges], np.add.reduceat(counts, edges)


class _Profiles:
    """Ranks of all profiles of a block by n-gram: one row of ranks for each known n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int) -> None:
        self.langs = sorted({lang for lang, _, _ in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64).view(np.uint64))
        # The last row is for n-grams that no profile has.
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            row = int(np.searchsorted(self.grams, np.array([gram], np.int64).view(np.uint64))[0])
            self.ranks[row, at[lang]] = rank
        self.most = most

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """The nearest language, ties to the first by name, and 1 less the distance over the largest possible one."""
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = np.where(self.grams[at] == grams, at, len(self.grams))
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(grams), dtype=np.int32)[:, None])).sum(0)
        best = int(np.argmin(out))
        return self.langs[best], 1.0 - float(out[best]) / (self.most * len(grams))


def predict_language(
    docs: DataFrame, profiles: DataFrame, most: int = PROFILE, longest: int = LONGEST, block: int = BLOCK
) -> DataFrame:
    """``doc_id, lang_pred, score`` and ``held_out`` of every row, from its whole text only.

    ``score`` is 1 less the out-of-place distance over the largest possible one. A null text, one without
    letters, or any text where no profile was learnt is ``und`` with score 0. Ties go to the first language
    by name. Repeated rows are judged each by itself.
    """
    profiles = materialize(profiles, "profiles")
    langs = [r[0] for r in profiles.select("lang").distinct().orderBy("lang").collect()]
    rows = docs.select(
        "doc_id", held_out().alias("held_out"), utf8().alias("__bytes"), F.lit(UNDETERMINED).alias("lang_pred"),
        F.lit(-1.0).alias("score"),
    )
    for start in range(0, max(len(langs), 1), block):
        part = langs[start : start + block]
        held = profiles.filter(F.col("lang").isin(part)).collect() if part else []
        model = _Profiles([tuple(r) for r in held], most) if held else None
        last = start + block >= len(langs)
        rows = _compare(rows, model, most, longest, last)
        rows = rows if last else materialize(rows, "compared")
    return rows


def _compare(rows: DataFrame, model: _Profiles | None, most: int, longest: int, last: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", "held_out"] + ([] if last else ["__bytes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in batches:
            langs, scores = batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist()
            for i, raw in enumerate(batch.column("__bytes").to_pylist()):
                text = raw.decode("utf-8", "replace")
                if profiles is not None and has_letter(text):
                    lang, score = profiles.nearest(ranked(*ngrams(text, longest), most))
                    if score > scores[i]:
                        langs[i], scores[i] = lang, score
            if last:
                scores = [max(s, 0.0) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", lang_pred string, score double"
    return rows.mapInArrow(scan, schema)
