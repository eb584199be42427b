"""Toxic passages as maximal-scoring segments of token log-odds.

Learning counts the toxic and the clean labelled documents that hold each word; documents of one text
count once, so copies do not lend their words weight. A word scores the lower confidence bound of
its log-odds under an informative Dirichlet prior, less a constant that makes ordinary text drift
down. All maximal-scoring segments of a text are found in one linear scan. Karlin-Altschul
statistics turn a segment's score into an expected number of such segments by chance; the evidence of all
significant segments is summed and calibrated to a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import PLAIN_WORDS, gives_back, held_out, labelled, utf8
from shardloom.session import materialize

# Labelled documents that the model is fitted on, at most about.
LABELLED = 20_000
# The prior's documents for each word, the confidence bound in standard deviations, the drift per word.
PRIOR, DEVIATIONS, DRIFT = 1.0, 2.0, 0.2
# A passage counts from this expected number of equal ones by chance in its text.
E_VALUE = 0.05
THRESHOLD = 0.3
EVIDENCE_STEP = 0.25


@dataclass(frozen=True)
class ToxicityModel:
    """Word scores, the extreme-value constants of clean text, and the calibration line.

    ``rate`` is the share of toxic labels: every score when ``words`` is empty, as with no labels
    of one of the two kinds.
    """

    words: dict[bytes, float]
    decay: float
    size: float
    slope: float
    offset: float
    rate: float

    def probability(self, evidence: float) -> float:
        if not self.words:
            return self.rate
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(start, end, score)`` of a score sequence, in order, in linear time.

    Runs of positive and of other scores are summed first. Each new positive run joins back to the
    nearest earlier segment that starts lower, as long as the joined one ends higher than that segment did.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
    sums = np.add.reduceat(scores, edges)
    ends = np.r_[edges[1:], len(scores)]
    left = np.r_[0.0, np.cumsum(sums)[:-1]]
    found: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, nearest lower
    for k in np.flatnonzero(up[edges]).tolist():
        low, high, start, end = float(left[k]), float(left[k] + sums[k]), int(edges[k]), int(ends[k])
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][0] >= low:
                at = found[at][4]
            if at < 0 or found[at][1] >= high:
                break
            low, start = found[at][0], found[at][2]
            del found[at:]
            at = len(found) - 1
        found.append((low, high, start, end, at))
    return [(start, end, high - low) for low, high, start, end, _ in found]


def _words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN_WORDS).split()


def _scores(model: dict[bytes, float], words: list[bytes]) -> np.ndarray:
    get = model.get
    return np.fromiter((get(w, 0.0) for w in words), np.float64, len(words)) - DRIFT


def _labelled_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct texts of the bounded sample, which is the broadcast side of the scan."""
    texts = docs.select("doc_id", utf8().alias("bytes")).join(F.broadcast(marks), "doc_id")
    return texts.groupBy(F.xxhash64("bytes").alias("text")).agg(
        F.min(F.struct("doc_id", "bytes", "label")).alias("one")
    ).select("one.bytes", "one.label")


def _counts(texts: DataFrame) -> tuple[list, int, int]:
    """All words with a score and their counts in clean documents, and both totals. The labelled texts bound their number."""

    @gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("bytes").to_pylist(), batch.column("label").to_pylist()):
                seen[label].update(set(_words(text)))
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(words, pa.binary()),
            pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64()),
        ], names=["word", "clean", "toxic"])

    counted = materialize(
        texts.mapInArrow(count, "word binary, clean long, toxic long")
        .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words"
    )
    clean, toxic = counted.agg(F.sum("clean"), F.sum("toxic")).first()
    # Log-odds under a Dirichlet prior that gives each word the same odds in both classes.
    n_clean, n_toxic = float(clean or 1), float(toxic or 1)
    to_toxic = PRIOR * n_toxic / (n_clean + n_toxic)
    c, t = F.col("clean") + (PRIOR - to_toxic), F.col("toxic") + to_toxic
    odds = F.log(t / (n_toxic + to_toxic)) - F.log(c / (n_clean + PRIOR - to_toxic))
    spread = DEVIATIONS * F.sqrt(1 / t + 1 / c)
    sure = F.signum("odds") * F.greatest(F.abs(F.col("odds")) - F.col("spread"), F.lit(0.0))
    rows = (
        counted.withColumns({"odds": odds, "spread": spread}).withColumn("score", sure)
        .filter("score <> 0 AND NOT isnan(score)")
        .orderBy(F.desc(F.abs("score") / F.col("spread")), "word")
        .select("word", "score", "clean").toArrow().to_pylist()
    )
    return rows, int(clean or 0), int(toxic or 0)


def _decay(rows: list, clean: int) -> float:
    """The positive root of ``sum p exp(x s) = 1`` over clean words, the rate at which chance scores thin out."""
    p = np.array([r["clean"] for r in rows], float) / max(clean, 1)
    s = np.array([r["score"] for r in rows], float) - DRIFT
    p, s = np.r_[p, max(0.0, 1 - p.sum())], np.r_[s, -DRIFT]

    def excess(x: float) -> float:
        return float(np.sum(p * np.exp(np.minimum(x * s, 700)))) - 1

    if not (s[p > 0] > 0).any():
        p[int(np.argmax(s))] = 0.5 / max(clean, 1)  # clean text has none of them: as if half a word were there
    if float(p @ s) >= 0 or s.max() <= 0:
        return 1.0  # nothing positive, or no downward drift: the scores' own scale
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _evidence(segments: list[tuple[int, int, float]], n: int, decay: float, size: float) -> tuple[float, list]:
    """Summed evidence in nats, and the significant passages with their expected counts."""
    base = math.log(max(size * n, 1e-12))
    passages, total = [], 0.0
    for start, end, score in segments:
        surprise = decay * score - base
        if surprise > -math.log(E_VALUE):
            passages.append((start, end, score, math.exp(-min(surprise, 700.0))))
            total += surprise
    return total, passages


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = LABELLED) -> ToxicityModel:
    """Learn from the texts of at most about ``most`` labelled documents outside the held-out part."""
    marks = materialize(labelled(labels, label, most), "marks")
    texts = materialize(_labelled_texts(docs, marks), "texts")
    by_label = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(by_label.values())
    rate = by_label.get(1, 0) / n if n else 0.0
    if len(by_label) < 2:
        return ToxicityModel({}, 1.0, 1.0, 1.0, 0.0, rate)
    rows, clean, _ = _counts(texts)
    model, decay = {bytes(r["word"]): r["score"] for r in rows}, _decay(rows, clean)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @gives_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("bytes").to_pylist():
                words = _words(text)
                out.append((len(words), [s for _, _, s in maximal_segments(_scores(shared.value, words))]))
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), pa.array([k for k, _ in out], pa.int64()),
                pa.array([s for _, s in out], pa.list_(pa.float64())),
            ], names=["label", "n", "scores"])

    scanned = materialize(texts.select("bytes", "label").mapInArrow(scan, "label int, n long, scores array<double>"), "segments")
    # Maximum likelihood of the extreme-value constant over the clean documents.
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    docs_n, weight = scanned.filter("label = 0 AND n > 0").agg(
        F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-decay * top))
    ).first()
    size = docs_n / weight if weight else 1.0
    base = F.log(F.greatest(size * F.col("n"), F.lit(1e-12)))
    each = F.transform("scores", lambda s: decay * s - base)
    evidence = F.aggregate(F.filter(each, lambda x: x > -math.log(E_VALUE)), F.lit(0.0), lambda a, x: a + x)
    points = (
        scanned.groupBy(F.round(evidence / EVIDENCE_STEP).alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))
        .toPandas()
    )
    slope, offset = _logistic(
        points["bin"].to_numpy(float) * EVIDENCE_STEP, points["label"].to_numpy(float), points["n"].to_numpy(float)
    )
    return ToxicityModel(model, decay, size, slope, offset, rate)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly damped logistic fit by Newton steps."""
    x = np.minimum(x, 40.0)
    theta, features = np.zeros(2), np.stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ features, -30, 30)))
        gradient = features @ (w * (y - p)) - 1e-2 * theta
        hessian = (features * (w * p * (1 - p))) @ features.T + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` of every row, besides the columns ``keep``.

    ``passages`` lists significant segments as byte offsets into the UTF-8 text, with score and expected number
    by chance. A null or empty text has no words and no evidence; it gets the calibrated score of that.
    Rows that repeat an id are scored each by its own text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = "score double, predicted int, passages array<struct<start:int,end:int,score:double,e_value:double>>"
    of = pa.list_(pa.struct([
        ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())
    ]))

    @gives_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, passages = [], []
            for text in batch.column("__bytes").to_pylist():
                words = _words(text)
                evidence, found = 0.0, []
                if m.words and words:
                    segments = maximal_segments(_scores(m.words, words))
                    if segments:
                        evidence, found = _evidence(segments, len(words), m.decay, m.size)
                scores.append(m.probability(min(evidence, 40.0)))
                passages.append(_offsets(text, found))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([
                *kept, pa.array(scores, pa.float64()),
                pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(passages, of),
            ], names=[*batch.schema.names[:-1], "score", "predicted", "passages"])

    columns = docs.select("doc_id", held_out().alias("held_out"), *keep, utf8().alias("__bytes"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1])
    return columns.mapInArrow(scan, f"{kept}, {result}")


def _offsets(text: bytes, found: list) -> list[dict]:
    """Word positions as byte offsets; only texts with passages come here with work to do."""
    if not found:
        return []
    inside = np.frombuffer(text.translate(PLAIN_WORDS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return [
        {"start": int(starts[a]), "end": int(ends[b - 1]), "score": s, "e_value": e} for a, b, s, e in found
    ]
