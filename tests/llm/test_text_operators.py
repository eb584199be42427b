"""Operators on texts against brute force, with the odd rows that tables hold."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shardloom.llm import (
    decontamination, jaccard_join, language_id, packing, pii, quality, suffix_dedup, token_output, topk, toxicity,
)
from shardloom.llm.suffix_array import equal_prefixes, suffix_array

PROSE = [f"w{i * 7 % 101} and v{i % 13}" for i in range(400)]


def text(start, n):
    return " ".join(PROSE[start : start + n])


# Null, empty, blank, one word, repeated rows, ties, near copies, a very long text without blanks.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, text(0, 60)), (7, text(0, 60)),
    (8, text(0, 60) + " tail"), (9, "x" * 30_000), (10, text(100, 80).upper()), (11, text(100, 80)), (12, "ab " * 5_000),
    (13, "ümläut " + text(200, 40)), (14, "a b c d"), (15, "A B C D"),
]


def frame(spark, rows=ODD):
    """Documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
        F.lit(1).alias("score"), F.lit("x").alias("component_id"), F.lit("y").alias("bytes"), F.lit(0).alias("id"),
        F.lit(2).alias("spans"), F.lit(3).alias("batch"),
    )


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# Jaccard join


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(data):
    sets = [(i, shingles(t)) for i, t in data]
    at = {i: i for i, _ in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            k = len(x & y)
            if (i == j or k and 100 * k >= 80 * (len(x) + len(y) - k)) and root(i) != root(j):
                at[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(((i, len(s), root(i)) for i, s in sets), key=repr)


def test_jaccard_components(spark):
    got = jaccard_join.jaccard_components(frame(spark))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(ODD)


def test_jaccard_long_columns_and_hot_groups(spark):
    """Many near copies and a passage that short documents share, with columns set aside from five rows on."""
    data = [(i, text(0, 40) + f" end{i}") for i in range(60)]
    data += [(100 + i, "the same line that all these short ones have " + f"q{i} r{i} s{i}") for i in range(40)]
    got = jaccard_join.jaccard_components(frame(spark, data), long_rows=5)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(data)


def test_jaccard_repeated_and_null_ids(spark):
    data = [(1, text(0, 30)), (1, text(50, 30)), (2, text(50, 30)), (3, text(0, 30)), (3, text(0, 30))]
    got = rows(jaccard_join.jaccard_components(frame(spark, data + [(None, text(0, 30))])), "doc_id", "component_id")
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (None, None)], key=repr)


# Decontamination


@pytest.mark.parametrize("pattern_bytes", [1 << 24, 2000])
def test_contamination(spark, pattern_bytes):
    items = [(1, text(0, 8)), (2, "one"), (3, None), (4, "..."), (5, text(105, 30)), (10, text(0, 8)), (None, "one"), (None, text(105, 18))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(len(w) - 13, 0) + 1) if w else ():
            # An item without id hits words, but names no item.
            patterns[tuple(w[k : k + 13])].update([str(i)] if i else [])
    want = []
    for d, t in ODD:
        w, hit, found = word.findall(lower(t)), set(), set()
        for p, ids in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((d, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = decontamination.contamination(frame(spark), bench, pattern_bytes=pattern_bytes)
    assert rows(got.drop("spans")) == sorted(want, key=repr)
    spans = {r.doc_id: r.spans for r in got.collect()}
    assert [ODD[3][1][s.start : s.end] for s in spans[4]] == ["one"]
    assert rows(decontamination.contamination(frame(spark), bench.limit(0)).select("n_hit").distinct()) == [(0,)]


# Suffix arrays


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_suffix_array(part, times):
    s = part * times
    assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_equal_prefixes():
    t = np.frombuffer(b"0123456789abc0123456789abd", np.uint8)
    order = suffix_array(t.astype(np.int64))
    pairs = {(int(order[k - 1]), int(order[k])) for k in np.flatnonzero(equal_prefixes(t, order, 10))}
    assert pairs == {(0, 13), (1, 14), (2, 15)}


def brute_repeats(data, length):
    seen, out = set(), []
    for d, t in data:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((d, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS4 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_remove_repeats(spark):
    assert rows(suffix_dedup.remove_repeats(frame(spark)), *COLUMNS4) == brute_repeats(ODD, 100)


def test_remove_repeats_short_strings_and_crowded_places(spark, monkeypatch):
    data = [(i, text(i % 7, 30) + f" {i} " + text(i % 5 + 40, 20)) for i in range(40)]
    got = suffix_dedup.remove_repeats(frame(spark, data), 40, 16)
    assert rows(got, *COLUMNS4) == brute_repeats(data, 40)
    monkeypatch.setattr(suffix_dedup, "CUT_BYTES", 300)
    got = suffix_dedup.remove_repeats(frame(spark, data), 40, 16)
    assert rows(got, *COLUMNS4) == brute_repeats(data, 40)


def test_remove_repeats_of_a_common_line_makes_no_row_for_each_string(spark, monkeypatch):
    line = text(200, 12)
    data = [(i, text(i + 100, 8) + line + text(i + 300, 8)) for i in range(60)] + [(i, text(7, 8) + line) for i in range(60, 64)]
    made, materialize = collections.Counter(), suffix_dedup.materialize

    def counted(df, label="stage"):
        found = materialize(df, label)
        made[label] = max(made[label], found.count())
        return found

    monkeypatch.setattr(suffix_dedup, "materialize", counted)
    monkeypatch.setattr(suffix_dedup, "CUT_BYTES", 500)
    got = suffix_dedup.remove_repeats(frame(spark, data), 40, 16)
    assert rows(got, *COLUMNS4) == brute_repeats(data, 40)
    assert max(made.values()) <= 4 * made["anchors"], made


def test_stretches_without_repeats_and_equal_ones_do_not_reach_the_suffix_array(monkeypatch):
    rng = random.Random(5)
    common = bytes(rng.randrange(97, 123) for _ in range(150))
    found = [(d, 5, bytes(rng.randrange(97, 123) for _ in range(199)) + bytes([d]) + common[: 150 - d % 3]) for d in range(30)]
    found.append((3, 205, common))  # once more, by another place
    sizes, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda symbols: sizes.append(len(symbols)) or sort(symbols))
    got = suffix_dedup._repeats(found, 100).to_pydict()
    # Document 0 has all of it first.
    assert dict(zip(got["doc"], got["spans"])) == {d: [205, 355 - d % 3] for d in range(1, 30)}
    assert sum(sizes) < 1000, sizes


def test_remove_repeats_with_repeated_ids(spark):
    data = [(None, text(0, 40)), (1, text(0, 40)), (1, text(60, 40)), (2, text(60, 40)), (2, text(60, 40))]
    got = {(r.doc_id, r.n_bytes, r.n_removed > 0) for r in suffix_dedup.remove_repeats(frame(spark, data)).collect()}
    a, b = len(text(0, 40)), len(text(60, 40))
    assert got == {(None, a, False), (1, a, True), (1, b, False), (2, b, True)}


# PII

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {
        "email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else False,
        "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
    }[kind]


def base_spans(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])]


TRICKY = [
    "a@b.c_d@e.f x@y..z @q.r a.b@c", "1.2.3.400.5.6.7 1.2.3.4.5.6.7.8 001.2.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "41111111111111110000000000000000000", "call +49 (30) 123-4567. +1-2 +12345678901234567", "é 4111111111111111\U0001F600 a@b.co", "\x01a@b.co\x01",
    "7" * 20_000, "a" * 20_000 + "@b.c", "1 1 1 1 1 1 1 1 1 1 1 1 1 7", "0000000000000", "+1 2 3 4 5 6 7 8 9 a+123456789",
]


@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "-", " ", "+", "12", "4111111111111111", "1.2.3.4", "(", "é", "x_", "7"]), max_size=14))
@settings(max_examples=5, deadline=None)
def test_pii_random(spark, parts):
    check_pii(spark, [(i, "".join(parts[i:])) for i in range(len(parts) + 1)])


def test_pii(spark):
    check_pii(spark, [(i, t) for i, t in enumerate(TRICKY)] + [(90, None), (91, ""), (90, None)])


def check_pii(spark, data):
    want = []
    for d, t in data:
        s = base_spans(t or "")
        n = collections.Counter(k for k, *_ in s)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
        want.append((d, n["email"], n["ip"], n["card"], n["phone"], digest))
    got = pii.pii_digest(frame(spark, data))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


def test_pii_added_spans_context_and_redaction(spark):
    data = [(1, "account DE89 3704 0044 0532 0130 00 ok"), (2, "account DE88 3704 0044 0532 0130 00"), (3, "ssn 123-45-6789"),
            (4, "123-45-6789"), (5, "mail a@b.co and +49 30 1234567 end"), (6, None), (7, "none")]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, data)).collect()}
    assert [s.kind for s in got[1].added_spans] == ["iban"] and not got[2].added_spans
    assert [s.kind for s in got[3].added_spans] == ["ssn"] and not got[4].added_spans
    clean = dict(rows(pii.redact_pii(frame(spark, data)), "doc_id", "text"))
    assert clean[1] == "account [IBAN] ok" and clean[5] == "mail [EMAIL] and [PHONE] end"
    assert clean[6] is None and clean[7] == "none" and clean[3] == "ssn [SSN]"
    assert pii.redact_pii(frame(spark, data)).columns == frame(spark).columns


def test_pii_runs_no_python(spark):
    plan = pii.pii_digest(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Packing


def brute_padding(counts, k):
    lengths = sorted(counts)
    best = {(0, 0): 0}
    for end in range(1, len(lengths) + 1):
        for used in range(1, k + 1):
            options = [
                best[s, used - 1] + sum(counts[x] * (lengths[end - 1] - x) for x in lengths[s:end])
                for s in range(end) if (s, used - 1) in best
            ]
            if options:
                best[end, used] = min(options)
    return min(v for (end, _), v in best.items() if end == len(lengths))


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=14), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_boundaries_are_optimal(counts, k):
    lengths = np.array(sorted(counts))
    ends = packing.best_boundaries(lengths, np.array([counts[x] for x in lengths.tolist()]), k)
    assert len(ends) <= k and ends == sorted(set(ends)) and ends[-1] == lengths[-1]
    assert sum(n * (min(e for e in ends if e >= x) - x) for x, n in counts.items()) == brute_padding(counts, k)


def test_pack(spark):
    got = packing.pack(frame(spark), context=50, buckets=3, budget=200).collect()
    total, batches = collections.Counter(), collections.defaultdict(list)
    for r in got:
        total[r.doc_id] += r.n_tokens
        batches[r.bucket, r.batch].append(r.slot)
        assert r.n_tokens <= r.bucket and r.padding == r.bucket - r.n_tokens and r.start == 50 * r.piece
    assert total == {d: len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) + 1 for d, t in ODD}
    for (bucket, batch), slots in batches.items():
        size = max(1, 200 // bucket)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= size
        assert len(slots) == size or batch == max(b for k, b in batches if k == bucket)
    assert packing.pack(frame(spark, []), context=50).count() == 0


# Token output


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 49_407), st.integers(0, (1 << 64) - 1)), max_size=300), st.integers(0, 260))
@settings(max_examples=80, deadline=None)
def test_words_round_trip(ids, zeros):
    a = np.array(ids + [0] * zeros, np.uint64)
    assert np.array_equal(token_output.decode_words(token_output.encode_words(a)), a)


def test_tokens(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    data = ODD + [(20, "It's a test of é ́x <|endoftext|> don't\x1cstop 12ab"), (21, "ΑΣ ΑΣ.")]
    tokenizer, at, want, ids_of = Tokenizer.from_file(path), 0, [], {}
    for d, t in sorted(data, key=lambda x: x[0]):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        ids_of[d] = ids.tobytes()
        at += len(ids)
    token_output.write_tokens(frame(spark, data), folder, path, partitions=3)
    assert rows(token_output.token_index(spark, folder)) == sorted(want, key=repr)
    assert {r.doc_id: bytes(r.ids) for r in token_output.read_tokens(spark, folder).collect()} == ids_of


# Exact top-k


def test_topk(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 6)).round(2))]
    data += [(600 + i, data[i][1]) for i in range(50)]  # ties
    data += [(700, None), (701, [float("nan")] * 6), (702, [None] * 6), (703, [1.0, 2.0]), (704, [3.0, 4.0]), (705, []), (None, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("rank", F.lit(9))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 50 == 0 or i == 703):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])]
    asked = df.filter("vec_id % 50 = 0 OR vec_id = 703")
    assert rows(topk.exact_topk(df.repartition(3), asked)) == sorted(want, key=repr)
    assert rows(topk.exact_topk(df, asked, block_bytes=500)) == sorted(want, key=repr)
    assert topk.exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_beyond_doubles(spark):
    big = 3.0e12
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0]), (3, [big, big])], "vec_id long, embedding array<double>")
    top = (1 << 63) - 1
    got = rows(topk.exact_topk(df, df.filter("vec_id = 0")), "vec_id", "score")
    b = 1024 * int(big)
    assert got == sorted([(3, min(top, b * b + 1024 * b)), (1, b * 1024 + 1024 * 1024), (2, b * 1024 + 1024 * 2048)], key=repr)


# Classifiers

LANGS = {"xx": "baka lomi sute nera", "yy": "grunz frack schlump wichtig", "zz": "οδος καλη μερα νερο"}


def test_language(spark):
    data = [(i, f"{LANGS[k]} " * (3 + i % 4), k) for i, k in enumerate(list(LANGS) * 20)]
    data += [(100, None, "xx"), (101, "123 ...", "xx"), (102, LANGS["yy"], None), (103, "", "zz")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("?"))
    profiles = language_id.learn_profiles(df)
    assert profiles.select("lang").distinct().count() == 3
    for block in (1, 2_000):
        got = {r.doc_id: r for r in language_id.predict_language(df, profiles, block=block).collect()}
        assert all(got[i].lang_pred == k for i, _, k in data[:60]) and got[102].lang_pred == "yy"
        assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 103))
        assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.predict_language(df, language_id.learn_profiles(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_out_of_place_distance():
    grams, counts = language_id.ngrams("Ab, ab!", 2)
    decode = lambda g: "".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(g) >> s & 0x1FFFFF)
    assert {decode(g): int(n) for g, n in zip(grams, counts)} == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2}
    assert language_id.ranked(grams, counts, 3).tolist() == grams[:3].tolist()


def brute_segments(s):
    """Maximal segments by their definition, recursively around the best one."""
    if not len(s) or max(s) <= 0:
        return []
    sums = np.r_[0, np.cumsum(s)]
    best = max((sums[j] - sums[i], -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    i, j = best[3], best[4]
    return brute_segments(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(s[j:])]


@given(st.lists(st.sampled_from([-3.0, -1.5, -1.0, 1.0, 2.25, 4.0]), max_size=25))
@settings(max_examples=150, deadline=None)
def test_maximal_segments(s):
    got = toxicity.maximal_segments(np.array(s, float))
    assert sum(x for *_, x in got) == pytest.approx(sum(sum(s[a:b]) for a, b in brute_segments(s)))
    assert all(x == pytest.approx(sum(s[a:b])) for a, b, x in got)


def labelled_frame(spark, word, column):
    data = [(i, text(i % 300, 50) + (f" {word} " + text(i % 100, 5) + f" {word}!" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(3, None), (None, 1)], f"doc_id long, {column} int")
    return frame(spark, data + [(900, None), (901, ""), (901, ""), (902, "y" * 50_000)]), labels


def test_toxicity(spark):
    docs, labels = labelled_frame(spark, "vile", "toxic")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model, keep=("text",)).collect()}
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(400)]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].predicted == 0 and not got[900].passages
    span = got[0].passages[0]
    assert "vile" in got[0].text.encode()[span.start : span.end].decode()
    none = toxicity.fit_toxicity(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


def test_quality(spark):
    docs, labels = labelled_frame(spark, "SPAM!!", "quality")
    labels = labels.withColumn("quality", 1 - F.col("quality"))
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in range(400)]) > 0.95
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0))).collect()} == {0.0}


def test_quality_learns_from_all_unlabelled(spark, monkeypatch):
    def made(ids):
        bad = lambda i: " ".join(f"BUY{(i + j) % 50}!!" for j in range(20 + i % 20))
        return frame(spark, [(i, text(i % 300, 20 + i % 20) if i % 4 else bad(i)) for i in ids])

    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    more = made(range(10_000, 19_000))
    docs = made(range(400)).unionByName(more)
    counts, store = {}, quality.materialize

    def counted(df, label):
        out = store(df, label)
        counts.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(quality, "materialize", counted)
    model = quality.fit_quality(docs, labels)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    n = sum(not held(i) for i in range(10_000, 19_000))
    assert counts["pool"] == [n]
    # More than a fixed number a round: a share of all, for each view.
    assert sum(counts["exchanged"]) > 2_400 and len(counts["exchanged"]) == quality.ROUNDS
    again = quality.fit_quality(docs.repartition(7), labels)
    assert (again.text == model.text).all() and (again.meta == model.meta).all() and again.joint == model.joint
    got = quality.score_quality(more, model).filter("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in got]) > 0.95


def test_contamination_by_an_item_without_id(spark):
    bench = spark.createDataFrame([(None, text(200, 14))], "item_id long, text string")
    got = decontamination.contamination(frame(spark, [(1, f"before {text(200, 14)} after"), (2, text(300, 14))]), bench)
    found = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()}
    assert found == {1: (42, 0, hashlib.sha256(b"").hexdigest(), True), 2: (0, 0, hashlib.sha256(b"").hexdigest(), False)}


def test_quality_pool_holds_labelled_rows_beyond_the_bound(spark, monkeypatch):
    """Every document outside the held-out part either teaches by its label or is in the pool."""
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    docs = frame(spark, [(i, text(i % 300, 20 + i % 20)) for i in range(500)])
    counts, store = {}, quality.materialize

    def counted(df, label):
        out = store(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(quality, "materialize", counted)
    quality.fit_quality(docs, labels, most=100)
    assert 20 <= counts["marks"] < 200
    assert counts["marks"] + counts["pool"] == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(500))


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for df in (
        jaccard_join.jaccard_components(none), decontamination.contamination(none, bench), pii.pii_digest(none),
        suffix_dedup.remove_repeats(none), toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)),
        quality.score_quality(none, quality.fit_quality(none, labels)), packing.pack(none),
    ):
        assert df.count() == 0


def test_bitmaps_rule_out_no_pair_that_links():
    rng = np.random.default_rng(5)
    for n in (1, 2, 15, 16, 17, 200, 3_000):
        for share in (0.0, 0.5, 0.8, 0.9, 1.0):
            base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            both = int(n * share)
            one, two = base[:n], base[n - both : 2 * n - both + n % 3 - 1]
            most = jaccard_join._most_shared(jaccard_join._bitmap(one), len(one), jaccard_join._bitmap(two), len(two))
            assert min(len(one), len(two)) >= most >= len(np.intersect1d(one, two))
            if n > 100 and share <= 0.5:
                assert most < 0.75 * n


def test_product_in_parts_gives_the_same_links(spark, monkeypatch):
    docs = frame(spark, [(i, text(i % 40, 20) + f" {i}") for i in range(300)])
    want = rows(jaccard_join.jaccard_components(docs))
    monkeypatch.setattr(jaccard_join, "HELD_PAIRS", 10)
    assert rows(jaccard_join.jaccard_components(docs)) == want
