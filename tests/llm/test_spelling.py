"""Spelling groups against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from shardloom.llm import spelling
from tests.llm.test_text_operators import ODD, frame, lower, rows

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def brute_words(data, one_in=None, length=7, least=2):
    n = Counter()
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= least}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_groups(words, factor=10):
    form, near = {}, {}
    for w in words:
        found = sorted((-words[o], o) for o in words if one_edit(w, o))
        near[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= factor * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], near[w], words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def made(seed, n, alphabet="abÀé", length=(5, 9)):
    r = random.Random(seed)
    return sorted({"".join(r.choice(alphabet) for _ in range(r.randint(*length))) for _ in range(n)})


@pytest.mark.parametrize("longest", [48, 7, 5])
@pytest.mark.parametrize("seed", [1])
def test_groups_of_crowded_words(spark, seed, longest):
    """Few letters, so runs of equal ones and many neighbours; short trees send the rest the other way."""
    r = random.Random(seed)
    words = {w: 10 ** r.randint(0, 4) * r.randint(1, 3) for w in made(seed, 250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.group_variants(df, longest=longest), *COLUMNS) == brute_groups(words)


def test_pairs_come_once(spark):
    words = made(7, 200)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for longest in (6,):
        found = [frozenset((r["word"], r["near"])) for r in spelling.near_words(df, longest).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_long_words(spark):
    """Words far above the trie's depth, with a shared beginning, a shared end and long runs of one letter."""
    words = {"x" * 3000: 40, "x" * 2999: 3, "x" * 2998 + "y": 2, "a" + "x" * 2999: 2}
    words |= {"q" * 60 + c + "r" * 60: 100 if c == "a" else 4 for c in "abcdé"}
    words |= {"z" * 48: 50, "z" * 49: 5, "z" * 47: 2, "z" * 47 + "w" + "z": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.group_variants(df), *COLUMNS) == brute_groups(words)


def test_count_words(spark):
    data = ODD + [(20 + i, "Wörterbuch wörterbuch WÖRTERBUCH ×÷×÷×÷×÷ straßenbahn's écriture") for i in range(70)] + [(None, "wörterbuch " * 9)]
    for one_in in (None, 31, 2):
        got = rows(spelling.count_words(frame(spark, data), one_in), "word", "n")
        assert got == sorted(brute_words(data, one_in).items(), key=repr)


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 3)
    data = [(i, " ".join(f"{'abcdefgh'[i % 8]}orterbuch{c}" for c in "abcdefg")) for i in range(40)]
    assert rows(spelling.count_words(frame(spark, data), 31), "word", "n") == sorted(brute_words(data, 31).items(), key=repr)


def test_no_words(spark):
    words = spelling.count_words(frame(spark).filter("false"))
    assert rows(spelling.group_variants(words)) == []
    assert rows(spelling.group_variants(spark.createDataFrame([("alone", 2)], "word string, n long"))) == [("alone", None, "alone", 2, 0, None)]
