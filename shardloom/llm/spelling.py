"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under the commonest.

Neighbours are found by walking a trie against itself, level by level. A state is a word's beginning (all words that
begin so share it), a node of the trie, and the number of edits: no edit while both are the same node, one edit
from there on, after which both must go on alike. States meet the trie's edges, a distributed table, by equi-joins
on the node. Where only one word is left below a node, its ending is known and is looked up among the words at
once, so the walk goes no deeper than words share beginnings. Words above ``LONGEST`` code points do not enter the trie: of
these, hashes with one code point left out meet in one equi-join.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import utf8
from shardloom.llm.shingles import LOWER
from shardloom.session import materialize, scratch_path

RUN = re.compile("[a-zA-ZÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, LONGEST = 7, 2, 48
# A word is a variant of a near word that is this many times as common.
FACTOR = 10
# Distinct words that a task counts before it passes them on.
_HELD = 200_000


def count_words(docs: DataFrame, misspelt_one_in: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: words of at least ``min_length`` code points and how often they occur, if ``min_count`` times or more.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. With ``misspelt_one_in``, a run loses the code point
    ``h % length`` where that number divides ``h``, the crc32 of ``<doc_id>:<run>`` (a null id is the empty string). Null and
    empty texts have no words; rows that repeat count again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("bytes")):
                lower = text.as_py().translate(LOWER).decode()
                salt = zlib.crc32(f"{key or ''}:".encode())
                for run, n in Counter(r for r in RUN.findall(lower) if len(r) >= min_length).items():
                    if misspelt_one_in:
                        h = zlib.crc32(run.encode(), salt)
                        if h % misspelt_one_in == 0:
                            cut = h % len(run)
                            run = run[:cut] + run[cut + 1 :]
                            if len(run) < min_length:
                                continue
                    held[run] += n
                if len(held) >= _HELD:
                    yield out()
        yield out()

    counted = docs.select(F.col("doc_id").cast("string").alias("key"), utf8().alias("bytes")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def trie_edges(words: DataFrame) -> DataFrame:
    """``depth, node, ch, child, below, only``: edges from nodes that at least two words go through.

    A node is the beginning that leads to it. An edge without character ends the word that its node spells. ``below`` is
    the number of words behind the edge, ``only`` the word if there is one.
    """
    steps = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth"))
    edges = steps.select(
        "depth", F.expr("left(word, depth)").alias("node"), F.expr("substring(word, depth + 1, 1)").alias("ch"), "word"
    ).groupBy("depth", "node", "ch").agg(F.count(F.lit(1)).alias("below"), F.min("word").alias("only"))
    through = F.sum("below").over(Window.partitionBy("node"))
    return edges.select(
        "depth", "node", "ch", F.concat("node", "ch").alias("child"), "below",
        F.when(F.col("below") == 1, F.col("only")).alias("only"), through.alias("through"),
    ).filter("through > 1").drop("through")


def _met(u: Column, u_only: Column, v: Column, v_only: Column) -> tuple[Column, Column, Column]:
    """Where words are left alone behind ``u`` or ``v``: the word, the word it would be near, and whether that one is known."""
    rest_u, rest_v = F.expr("substring(u_only, length(u) + 1)"), F.expr("substring(v_only, length(v) + 1)")
    known = u_only.isNotNull() & v_only.isNotNull()
    word = F.when(u_only.isNotNull(), u_only).otherwise(v_only)
    near = F.when(known, F.when(rest_u == rest_v, v_only)).when(u_only.isNotNull(), F.concat(v, rest_u)).otherwise(F.concat(u, rest_v))
    return word, near, known


def near_words(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``word, near``: all pairs of words at one edit, each pair once. ``words`` has distinct words in ``word``.

    Every pair is reached by one way only: of equal code points in a row the last is the one that counts as left out.
    """
    spark = words.sparkSession
    short = words.select("word").filter(F.length("word") <= longest)
    found = _near_long(words, longest)
    path = scratch_path(spark, "edges")
    trie_edges(short).write.partitionBy("depth").parquet(path)
    edges = spark.read.schema("node string, ch string, child string, only string, depth int").parquet(path)
    deepest = edges.agg(F.max("depth")).first()[0]
    if deepest is None:
        return found
    none = F.lit(None).cast("string")
    # The levels lie in one table, so all that met can be read at once.
    levels, met = scratch_path(spark, "levels"), "u string, v string, u_only string, v_only string, left_out string"
    for level in range(deepest + 1):
        here, around = edges.filter(F.col("depth") == level), edges.filter(F.col("depth").between(level - 1, level))
        left = here.select(F.col("node").alias("u"), F.col("ch").alias("u_ch"), F.col("child").alias("u_next"), F.col("only").alias("u_only"))
        right = around.select(F.col("node").alias("v"), F.col("ch").alias("v_ch"), F.col("child").alias("v_next"), F.col("only").alias("v_only"))
        # Without an edit, both are the same node.
        unedited = left.select("u", F.col("u").alias("v"), F.lit(0).alias("edits"), none.alias("left_out"), "u_ch", "u_next", "u_only")
        stepped = unedited
        if level:
            states = spark.read.schema(met).parquet(f"{levels}/level={level - 1}").filter("u_only IS NULL AND v_only IS NULL")
            stepped = unedited.unionByName(states.select("u", "v", F.lit(1).alias("edits"), "left_out").join(left, "u"))
        both = stepped.join(right, "v").filter(
            "edits = 0 AND u_ch < v_ch AND u_ch <> '' "
            "OR edits = 1 AND u_ch = v_ch AND (left_out IS NULL OR u_ch <> left_out)"
        ).select(F.col("u_next").alias("u"), F.col("v_next").alias("v"), "u_only", "v_only", none.alias("left_out"))
        longer = unedited.filter("u_ch <> ''").select(
            F.col("u_next").alias("u"), "v", "u_only", none.alias("v_only"), F.col("u_ch").alias("left_out")
        )
        both.unionByName(longer).write.parquet(f"{levels}/level={level}")
    word, near, known = _met(*(F.col(c) for c in ("u", "u_only", "v", "v_only")))
    alone = spark.read.schema(met).parquet(levels).filter("u_only IS NOT NULL OR v_only IS NOT NULL")
    alone = alone.select(word.alias("word"), near.alias("near"), known.alias("known")).filter("near IS NOT NULL")
    # One word is known to be near where both were left alone; else it must be among the words.
    among = short.select(F.col("word").alias("near"), F.lit(True).alias("there"))
    looked_up = alone.join(among, "near", "left").filter("known OR there").select("word", "near")
    found = found.unionByName(looked_up)
    return found


def _near_long(words: DataFrame, longest: int) -> DataFrame:
    """``near_words`` of pairs in which a word has more than ``longest`` code points.

    A word is sent once for each of its code points, as a 16-byte hash of what is left without it; words that
    are equal but for one place meet under that place, a word and one with a code point more under the shorter word. Only
    words at one edit meet, so no pair is proposed that is not one.
    """
    modulus, base = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column("word").to_pylist():
                digest = hashlib.blake2b(word.encode(), digest_size=16).digest()
                size = len(word)
                before, power = [0], [1]
                for c in word:
                    before.append((before[-1] * base + ord(c)) % modulus)
                    power.append(power[-1] * base % modulus)
                keys, longer = [], []
                for i in range(size):
                    # Hash of the code points behind place i, put after those before it.
                    rest = (before[size] - before[i + 1] * power[size - i - 1]) % modulus
                    without = (before[i] * power[size - i - 1] + rest) % modulus
                    if size > longest:
                        keys.append(f"r{size}:{i}:{without:x}")
                        longer.append(None)
                        if i + 1 == size or word[i + 1] != word[i]:
                            keys.append(f"d{size - 1}:{without:x}")
                            longer.append(True)
                keys.append(f"d{size}:{before[size]:x}")
                longer.append(False)
                for a in range(0, len(keys), 10_000):
                    part = keys[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), pa.array([digest] * len(part), pa.binary()), pa.array(longer[a : a + 10_000], pa.bool_())],
                        names=["key", "id", "longer"],
                    )

    long = words.select("word").filter(F.length("word") >= longest)
    schema = "word string, near string"
    if long.filter(F.length("word") > longest).isEmpty():
        return words.sparkSession.createDataFrame([], schema)
    sent = materialize(long.mapInArrow(send, "key string, id binary, longer boolean"), "long")
    other = sent.select("key", F.col("id").alias("other"), F.col("longer").alias("other_longer"))
    pairs = sent.join(other, "key").filter("longer IS NULL AND id < other OR longer AND NOT other_longer").select("id", "other")
    named = materialize(pairs, "long_pairs")
    key = F.udf(lambda w: hashlib.blake2b(w.encode(), digest_size=16).digest(), "binary")
    ids = materialize(long.select("word", key("word").alias("id")), "long_ids")
    return named.join(ids, "id").select("word", "other").join(
        ids.select(F.col("id").alias("other"), F.col("word").alias("near")), "other"
    ).select("word", "near")


def group_variants(words: DataFrame, factor: int = FACTOR, longest: int = LONGEST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each row of ``words`` (``word, n``, words distinct).

    ``form`` is the near word with the largest ``n`` (ties: smallest in code-point order) if that is ``factor`` times the word's
    ``n`` or more, else null. ``root`` is where the forms lead in the end, the word itself if it has none. No words give no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_words(words, longest), "near")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    common = -F.col("best.less") >= F.lit(factor) * F.col("n")
    grouped = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
    ), "forms")
    # Each form is at least ``factor`` times as common, so chains are short; each round doubles the steps taken.
    top = words.agg(F.max("n")).first()[0] or 1
    roots = grouped.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    taken = 1
    while factor**taken <= top:
        roots = materialize(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
        taken *= 2
    return grouped.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
