"""Winnowing against a plain version, row by row."""

import hashlib
import struct

import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm import fingerprints
from tests.llm.test_text_operators import ODD, frame, text

WORD = regex.compile(r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}\p{N}]{1,24}+(?![\p{L}\p{M}\p{N}])|[\p{L}\p{M}\p{N}]")
ALL = (1 << 64) - 1


def xx(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def turned(x, n):
    n %= 64
    return (x << n | x >> 64 - n) & ALL if n else x


def brute_marks(t, gram=5, window=8):
    words = [xx(w.encode()) for w in WORD.findall((t or "").lower())]
    if not words:
        return []
    if len(words) < gram:
        whole = 42
        for w in words:
            whole = xx(struct.pack("<Q", w), whole)
        grams = [whole]
    else:
        grams = []
        for i in range(len(words) - gram + 1):
            g = 0
            for j in range(gram):
                g ^= turned(words[i + j], gram - 1 - j)
            grams.append(g)
    found = []
    for i in range(max(len(grams) - window, 0) + 1):
        held = range(i, min(i + window, len(grams)))
        best = min(held, key=lambda k: (grams[k] >> 33, -k))
        if best not in found[-1:]:
            found.append(best)
    return [(grams[k] - (1 << 64) if grams[k] >> 63 else grams[k], k) for k in found]


def brute_edited(data, gram=5, window=8):
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        marks, changed, following = (brute_marks(x, gram, window) for x in (t, edited, after))

        def like(a, b):
            a, b = {h for h, _ in a}, {h for h, _ in b}
            return len(a & b) / len(a | b) if a | b else 1.0

        def line(m):
            return ",".join(f"{h & ALL:X}:{p}" for h, p in m)

        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), line(marks), line(changed), like(marks, changed), like(marks, following)))
    return sorted(out, key=repr)


def got(df):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("gram, window", [(5, 8), (1, 1), (3, 4), (4, 5)])
def test_winnow(spark, gram, window):
    found = fingerprints.winnow(frame(spark), "text", "marks", gram, window)
    assert set(found.columns) == {*frame(spark).columns, "marks"}
    for row in found.collect():
        assert [tuple(m) for m in row["marks"]] == brute_marks(row["text"], gram, window)


def test_edited_fingerprints(spark):
    assert got(fingerprints.edited_fingerprints(frame(spark))) == brute_edited(ODD)


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: i * i * 1_000_003, lambda i: i // 7, lambda i: None if i % 3 else 10 - i])
def test_edited_over_many_slots(spark, monkeypatch, ids):
    """Successors over slot borders, with wide gaps, repeated and null ids."""
    monkeypatch.setattr(fingerprints, "SLOT_ROWS", 3)
    monkeypatch.setattr(fingerprints, "QUANTILES", 4)
    data = [(ids(i), text(i * 3 % 50, 5 + i % 9) + f" own{i % 20}") for i in range(60)]
    assert got(fingerprints.edited_fingerprints(frame(spark, data).repartition(5))) == brute_edited(data)


@pytest.mark.parametrize("data", [[(3, "one lone document")], [(None, None)], [(1, "a b c"), (1, "a b c"), (2, None)]])
def test_edited_of_few_rows(spark, data):
    assert got(fingerprints.edited_fingerprints(frame(spark, data))) == brute_edited(data)


def test_edited_of_no_rows(spark):
    assert got(fingerprints.edited_fingerprints(frame(spark).filter("false"))) == []


def test_long_and_unbroken_texts(spark):
    data = [(1, "x" * 50_000), (2, "漢字かな" * 40), (3, "áb c-d_e " * 8_000), (4, text(0, 400) * 20)]
    found = {r["doc_id"]: [tuple(m) for m in r["marks"]] for r in fingerprints.winnow(frame(spark, data)).collect()}
    assert found == {i: brute_marks(t) for i, t in data}


def test_shared_run_is_found(spark):
    """Two texts with twelve words in a row in common share a mark, wherever the words stand."""
    shared = text(300, 12)
    data = [(i, text(i * 20, i) + " " + shared + " " + text(i * 11, 30)) for i in range(6)]
    found = [{m["hash"] for m in r["marks"]} for r in fingerprints.winnow(frame(spark, data)).collect()]
    assert all(a & b for a in found for b in found)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢İß-\n" + "x" * 3, max_size=60), min_size=1, max_size=8))
def test_marks_of_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in fingerprints.winnow(df, gram=2, window=3).collect():
        assert [tuple(m) for m in row["marks"]] == brute_marks(row["text"], 2, 3)


def test_no_python_on_the_path(spark):
    plan = fingerprints.edited_fingerprints(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
