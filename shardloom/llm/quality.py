"""Document quality by co-training two views.

One classifier sees the words and word shapes of a text, the other its metadata: source, language, length and page
layout. Both are logistic regressions on hashed features, first fitted on labelled documents. Over some rounds each view scores
all unlabelled documents outside the held-out part, and labels a share of them, those it is surest of, for the other,
which is then refitted on all it was given. Each view is then calibrated on labelled documents kept out of training,
and a logistic combination of both calibrated views scores every document.

Scores, choices and gradients of unlabelled documents are computed in the tasks. Counts and fixed-point sums over them
reach the driver, so the fit does not depend on the partitioning.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import held_out, labelled, utf8
from shardloom.session import materialize

# Labelled documents that the fit takes at most about.
LABELLED = 6_000
# Hashed features of a view; a feature is stored in two bytes.
TEXT_BITS, META_BITS = 15, 10
# Share of all unlabelled documents that a view labels for the other in a round.
ROUNDS, EXCHANGED, SURE = 4, 0.05, 0.9
# Gradient steps of the first fit, and of a refit, which goes on from the weights before.
STEPS, REFIT_STEPS = 60, 12
STEP, DAMP = 4.0, 1e-3
# Steps of a logit that are told apart, and of a gradient that are summed.
GRAIN, FIXED = 1 << 10, 1 << 24
# Share of the labelled documents that calibrates.
CALIBRATE = 0.25
THRESHOLD = 0.5

_LETTER_RUN = re.compile(rb"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")


def _shape(word: bytes) -> bytes:
    """Kinds of characters of a word in order, runs as one; other characters stand for themselves."""
    out = []
    for run in _LETTER_RUN.findall(word):
        c = run[:1]
        out.append(b"A" if c.isupper() else b"a" if c.islower() else b"0" if c.isdigit() else run[:4])
    return b"".join(out)


def text_features(text: bytes) -> np.ndarray:
    """Distinct hashed features of the text's lower-cased words and of word shapes with their frequency."""
    words = text.split()
    seen = {b"w" + w for w in {w.lower() for w in words}}
    shapes: dict[bytes, int] = {}
    for word, n in _counted(words).items():
        s = _shape(word)
        shapes[s] = shapes.get(s, 0) + n
    for s, n in shapes.items():
        # The frequency of a shape in steps of two.
        level = int(np.log2(max(n * 256 // len(words), 1)))
        seen.add(b"s%d " % level + s)
    # How much the words repeat.
    if words:
        seen.add(b"r%d" % int(10 * len({*words}) / len(words)))
    return _hashed(seen, TEXT_BITS)


def _counted(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for w in words:
        out[w] = out.get(w, 0) + 1
    return out


def meta_features(text: bytes, source: str | None, lang: str | None) -> np.ndarray:
    """Distinct hashed features of source, language, length and layout, and pairs of layout features."""
    lines = text.split(b"\n")
    n = max(len(text), 1)
    upper = sum(map(text.count, (b"A", b"E", b"I", b"N", b"O", b"R", b"S", b"T")))
    layout = [
        b"n%d" % int(2 * np.log2(n)), b"l%d" % int(2 * np.log2(len(lines))), b"m%d" % int(2 * np.log2(n / len(lines) + 1)),
        b"d%d" % int(10 * len(set(lines)) / len(lines)), b"u%d" % int(50 * upper / n),
        b"p%d" % int(100 * sum(map(text.count, (b"!", b"?", b"*", b"#", b"$", b"|", b"{", b"}", b"<", b">"))) / n),
        b"q%d" % int(100 * sum(map(text.count, (b".", b","))) / n),
        b"0%d" % int(50 * sum(map(text.count, (b"0", b"1", b"2", b"5"))) / n), b"b%d" % int(20 * text.count(b" ") / n),
    ]
    seen = {*layout, b"source " + (source or "").encode(), b"lang " + (lang or "").encode()}
    seen |= {x + b" " + y for i, x in enumerate(layout) for y in layout[:i]}
    return _hashed(seen, META_BITS)


def _hashed(seen: set[bytes], bits: int) -> np.ndarray:
    return np.unique(np.array([zlib.crc32(s) & ((1 << bits) - 1) for s in seen] or [0], np.int32))


@dataclass(frozen=True)
class QualityModel:
    """Weights of the views (the last is the constant), calibration lines, the combination, and the share of good."""

    text: np.ndarray | None
    meta: np.ndarray | None
    lines: tuple[tuple[float, float], tuple[float, float]] | None
    joint: tuple[float, float, float] | None
    rate: float

    def scores(self, text: "_View", meta: "_View") -> np.ndarray:
        if self.joint is None:
            return np.full(len(text.size), self.rate)
        a, b = (
            slope * v.logits(w) + offset for w, v, (slope, offset) in zip((self.text, self.meta), (text, meta), self.lines)
        )
        return _sigmoid(self.joint[0] * a + self.joint[1] * b + self.joint[2])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _View:
    """A view's rows as one flat list of features, from a column of two bytes a feature; no row is without one."""

    def __init__(self, rows: pa.Array, bits: int) -> None:
        ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1] // 2
        self.flat = np.frombuffer(rows.buffers()[2], np.uint16)[ends[0] : ends[-1]]
        self.start, self.size = (ends[:-1] - ends[0]).astype(np.int64), np.diff(ends)
        self.scale, self.width = 1 / np.sqrt(self.size), 1 << bits

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.flat], self.start) * self.scale + w[-1]

    def summed(self, pull: np.ndarray, unit: float = 0) -> np.ndarray:
        """Sum of the rows' features and the constant, each row times its pull; in whole numbers of ``1 / unit`` if given."""
        each = pull * self.scale
        if unit:
            each, pull = np.rint(each * unit), np.rint(pull * unit)
        return np.r_[np.bincount(self.flat, np.repeat(each, self.size), self.width), pull.sum()]


def _views(batch: pa.RecordBatch | pa.Table) -> list[_View]:
    return [_View(batch.column(c), bits) for c, bits in (("t", TEXT_BITS), ("m", META_BITS))]


def _descend(w: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """Accelerated gradient steps of a damped fit: gives where the gradient is wanted, takes it, and gives the weights last."""
    momentum = w
    for step in range(steps):
        ahead = w + (step / (step + 3)) * (w - momentum)
        slope = yield ahead
        momentum, w = w, ahead - STEP * (slope + DAMP * np.r_[ahead[:-1], 0])
    yield w


def _class_weights(y: np.ndarray, more: tuple[int, int] = (0, 0)) -> np.ndarray:
    """What a row of class 0 and 1 weighs, so that both classes weigh the same; ``more`` rows are elsewhere."""
    return 0.5 / np.maximum(np.bincount(y, minlength=2) + more, 1)


def _fit(view: _View, y: np.ndarray) -> np.ndarray:
    """Damped logistic regression on rows at hand."""
    steps, weight = _descend(np.zeros(view.width + 1), STEPS), _class_weights(y)[y]
    w = next(steps)
    for _ in range(STEPS):
        w = steps.send(view.summed(weight * (_sigmoid(view.logits(w)) - y)))
    return w


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression on one or more columns by damped Newton steps; the constant comes last."""
    features = np.vstack([np.atleast_2d(x), np.ones(len(y))])
    theta = np.zeros(len(features))
    for _ in range(40):
        p = _sigmoid(theta @ features)
        hessian = (features * (p * (1 - p))) @ features.T + 1e-2 * np.eye(len(features))
        step = np.linalg.solve(hessian, features @ (y - p) - 1e-2 * theta)
        theta = theta + np.clip(step, -3, 3)
    return tuple(theta.tolist())


def quality_features(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, t, m``: features of both views, of every row.

    A null text counts as an empty one, as do null source and language.
    """

    def packed(found: Iterator[np.ndarray]) -> pa.Array:
        return pa.array([f.astype(np.uint16).tobytes() for f in found], pa.binary())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, source, lang = (batch.column(c).to_pylist() for c in ("bytes", "source", "lang"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"),
                packed(map(text_features, text)), packed(map(meta_features, text, source, lang)),
            ], names=["doc_id", "held_out", "t", "m"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "source", "lang", utf8().alias("bytes"))
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, t binary, m binary")


@dataclass(frozen=True)
class _Round:
    """The weights of both views, and how sure each must be, in steps, to give class 0 and 1 to the other."""

    weights: list[np.ndarray]
    cuts: list[tuple[int, int]]


def _sure(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class a view is sure of, -1 for none, and how sure it is of it, in steps."""
    size = np.abs(logits)
    kind = np.where(size >= np.log(SURE / (1 - SURE)), logits > 0, -1).astype(np.int8)
    return kind, np.minimum(size * GRAIN, 32 * GRAIN).astype(np.int32)


def _given(views: list[_View], rounds: list[_Round]) -> list[np.ndarray]:
    """For each view the classes that the other has given to the rows, -1 for none. The first given stays."""
    out = [np.full(len(v.size), -1, np.int8) for v in views]
    for turn in rounds:
        for mine, other in ((0, 1), (1, 0)):
            kind, sure = _sure(views[mine].logits(turn.weights[mine]))
            new = (out[other] < 0) & (kind >= 0) & (sure >= np.array(turn.cuts[mine])[kind])
            out[other][new] = kind[new]
    return out


def _cuts(pool: DataFrame, rounds: list[_Round], weights: list[np.ndarray], most: tuple[int, int]) -> list[tuple[int, int]]:
    """How sure each view must be so that it gives ``most`` rows of each class; rows as sure as the last go along."""
    shared = pool.sparkSession.sparkContext.broadcast((rounds, weights))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, weights = shared.value
        width = 32 * GRAIN + 1
        seen = np.zeros(4 * width, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            views = _views(batch)
            given = _given(views, rounds)
            for mine, other in ((0, 1), (1, 0)):
                kind, sure = _sure(views[mine].logits(weights[mine]))
                free = (given[other] < 0) & (kind >= 0)
                seen += np.bincount((2 * mine + kind[free].astype(np.int64)) * width + sure[free], minlength=4 * width)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([
            pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), pa.array(seen[at]),
        ], names=["which", "sure", "n"])

    counts = pool.select("t", "m").mapInArrow(scan, "which int, sure int, n long").groupBy("which", "sure").agg(F.sum("n").alias("n"))
    which, sure, n = (c.to_numpy() for c in counts.toArrow().select(["which", "sure", "n"]).columns)
    shared.destroy()
    out = []
    for k in range(4):
        order = np.argsort(-sure[which == k])
        steps, total = sure[which == k][order], np.cumsum(n[which == k][order])
        last = np.searchsorted(total, most[k % 2])
        out.append(int(steps[last]) if last < len(steps) else 0)
    return [(out[0], out[1]), (out[2], out[3])]


def _exchanged(pool: DataFrame, rounds: list[_Round]) -> DataFrame:
    """``view, y, f``: what the last round gives, a row for each view and document."""
    shared = pool.sparkSession.sparkContext.broadcast(rounds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            views = _views(batch)
            before, after = _given(views, shared.value[:-1]), _given(views, shared.value)
            for k, column in enumerate(("t", "m")):
                at = np.flatnonzero(before[k] != after[k])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), k, np.int32)), pa.array(after[k][at].astype(np.int32)), batch.column(column).take(pa.array(at)),
                ], names=["view", "y", "f"])

    return pool.select("t", "m").mapInArrow(scan, "view int, y int, f binary")


def _pulls(moved: DataFrame, weights: list[np.ndarray], rows: list[np.ndarray]) -> list[np.ndarray]:
    """For each view the sum of the gradients of the exchanged documents, summed by Spark as whole numbers."""
    # A row of the larger class weighs 1 in the sums, so that steps of 1 / FIXED are fine enough.
    total = [1 / r.min() for r in rows]
    shared = moved.sparkSession.sparkContext.broadcast((weights, [r * t for r, t in zip(rows, total)]))
    bits = (TEXT_BITS, META_BITS)
    first = (0, (1 << TEXT_BITS) + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rows = shared.value
        sums = [np.zeros(len(w)) for w in weights]
        for batch in batches:
            which, kinds = batch.column("view").to_numpy(), batch.column("y").to_numpy()
            for k in (0, 1):
                at = np.flatnonzero(which == k)
                if len(at):
                    view, y = _View(batch.column("f").take(pa.array(at)), bits[k]), kinds[at]
                    sums[k] += view.summed(rows[k][y] * (_sigmoid(view.logits(weights[k])) - y), FIXED)
        flat = np.concatenate(sums).astype(np.int64)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["k", "g"])

    got = moved.mapInArrow(scan, "k int, g long").groupBy("k").agg(F.sum("g").alias("g")).toArrow()
    shared.destroy()
    flat = np.zeros(sum(map(len, weights)))
    flat[got.column("k").to_numpy()] = got.column("g").to_numpy() / FIXED
    return [flat[f : f + len(w)] / t for f, w, t in zip(first, weights, total)]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> QualityModel:
    """``fit_features`` on the features of ``docs``."""
    return fit_features(materialize(quality_features(docs), "features"), labels, label, most)


def fit_features(features: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> QualityModel:
    """Co-train on at most about ``most`` labelled documents outside the held-out part, and on all others there.

    The others are the unlabelled documents and the labelled ones beyond the bound, whose labels are not looked at.
    Rows without id are in neither part.

    Without labels of both kinds the model gives every document the share of good labels. Of a labelled
    document's repeated rows one teaches; unlabelled rows that repeat teach each by itself. ``features`` are scanned
    several times, so they should be stored.
    """
    marks = materialize(labelled(labels, label, most), "marks")
    # Bounded by the number above; in order of the hashed ids, so the fit is the same in every run.
    rows = (
        features.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("t", "m")).alias("f"))
        .select("doc_id", "label", "f.t", "f.m").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().combine_chunks()
    )
    y = rows.column("label").to_numpy().astype(np.int64)
    rate = float(y.mean()) if len(y) else 0.0
    if len(y) < 20 or rate in (0.0, 1.0):
        return QualityModel(None, None, None, None, rate)
    split = int(len(y) * CALIBRATE)
    (held, truth), (own, y) = ((_views(r.combine_chunks().to_batches()[0]), part) for r, part in (
        (rows.slice(0, split), y[:split]), (rows.slice(split), y[split:])
    ))
    weights = [_fit(v, y) for v in own]
    # Labelled documents beyond the bound are in the pool, without their labels.
    free = features.filter(F.col("doc_id").isNotNull() & ~F.col("held_out"))
    pool = materialize(free.join(F.broadcast(marks.select("doc_id")), "doc_id", "left_anti").select("t", "m"), "pool")
    n = pool.count()
    # In proportion, so that a round leaves the classes as the labels have them.
    share = tuple(max(1, int(EXCHANGED * n * s)) for s in (1 - rate, rate))
    rounds: list[_Round] = []
    moved: DataFrame | None = None
    for _ in range(ROUNDS if n else 0):
        rounds.append(_Round(weights, _cuts(pool, rounds, weights, share)))
        new = materialize(_exchanged(pool, rounds), "exchanged")
        moved = new if moved is None else moved.unionByName(new)
        found = np.zeros((2, 2), np.int64)
        for r in moved.groupBy("view", "y").count().collect():
            found[r.view, r.y] = r["count"]
        rows_weigh = [_class_weights(y, tuple(found[k])) for k in (0, 1)]
        steps = [_descend(w, REFIT_STEPS) for w in weights]
        weights = [next(s) for s in steps]
        for _ in range(REFIT_STEPS):
            pulls = _pulls(moved, weights, rows_weigh)
            weights = [
                s.send(v.summed(r[y] * (_sigmoid(v.logits(w)) - y)) + p)
                for s, v, w, r, p in zip(steps, own, weights, rows_weigh, pulls)
            ]
    raw = [v.logits(w) for v, w in zip(held, weights)]
    truth = truth.astype(float)
    lines = tuple(_line(r, truth) for r in raw)
    joint = _line(np.stack([s * r + o for r, (s, o) in zip(raw, lines)]), truth)
    return QualityModel(weights[0], weights[1], lines, joint, rate)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``score_features`` of the features of ``docs``."""
    return score_features(quality_features(docs), model)


def score_features(features: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; 1 is good.

    A null or empty text is scored by its metadata and the features of an empty text. Null source and language
    count as empty ones. Repeated rows are scored each by itself.
    """
    shared = features.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = shared.value.scores(*_views(batch))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                pa.array((scores >= THRESHOLD).astype(np.int32)),
            ], names=["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")
