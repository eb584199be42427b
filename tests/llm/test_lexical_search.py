"""Ranked search against brute force."""

import math
import re
from collections import Counter

import pytest

from shardloom.llm import lexical_search
from tests.llm.test_text_operators import ODD, frame, lower, rows, text


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))


def brute_search(data, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in data]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, b in bags:
            m = 100 - 90 + 90 * sum(b.values()) * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
                for t in wanted if t in b
            )
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, score string")


ITEMS = [(1, text(0, 8)), (2, "ONE one, zzz"), (3, None), (4, " .. "), (5, text(100, 30)), (2, "ümläut"), (None, "a w7"), (7, "nowhere to befound")]


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
@pytest.mark.parametrize("piece", [1 << 21, 5])
def test_ranked_search(spark, monkeypatch, block_bytes, piece):
    monkeypatch.setattr(lexical_search, "_SLICE", piece)
    data = ODD + [(None, text(0, 8)), (6, text(0, 60)), (-5, text(3, 9))]
    got = lexical_search.ranked_search(frame(spark, data), asked(spark, ITEMS), block_bytes=block_bytes)
    assert rows(got, "item_id", "rank", "doc_id", "score") == brute_search(data, ITEMS)


def test_ties_and_large_classes(spark):
    """Hundreds of copies, permuted texts of one class, and ids that are repeated: all by ascending id."""
    data = [(1000 - i, "alpha beta beta gamma") for i in range(300)]
    data += [(2000 + i, "beta alpha gamma beta") for i in range(50)] + [(750, "alpha"), (750, "alpha"), (3, "delta alpha")]
    data += [(5000 + i, f"beta word{i} other{i}") for i in range(40)]
    items = [(1, "alpha"), (2, "beta gamma"), (3, "delta"), (4, "word7 beta")]
    got = lexical_search.ranked_search(frame(spark, data).repartition(6), asked(spark, items))
    assert rows(got, "item_id", "rank", "doc_id", "score") == brute_search(data, items)


def test_no_documents_no_items(spark):
    for docs, items in ((frame(spark).filter("false"), asked(spark, ITEMS)), (frame(spark), asked(spark, ITEMS).filter("false")),
                        (frame(spark, [(1, None), (2, "..")]), asked(spark, ITEMS)), (frame(spark), asked(spark, [(1, None)]))):
        got = lexical_search.ranked_search(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and rows(got) == []


def test_classes_hold_few_members(spark):
    bags = spark.createDataFrame([(i, 10, [1, 2], [1, 1]) for i in range(90)] + [(7, 11, [1, 2], [1, 1])], "doc_id long, m long, ids array<int>, tfs array<long>")
    assert rows(lexical_search.bag_classes(bags, 3), "m", "doc_ids") == [(10, [0, 1, 2]), (11, [7])]
