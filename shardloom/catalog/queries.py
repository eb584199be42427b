"""One callable ``(spark, sf_dir) -> DataFrame`` per operator or pipeline."""

from __future__ import annotations

import re
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.catalog.inputs import (
    derive_samples, embedding_pairs, epoch_history, loss_steps, samples, shard_fields, table,
)
from shardloom.functions import captions as cap
from shardloom.functions.hashing import split_score
from shardloom.functions.json import json_object, json_string, set_json_string
from shardloom.functions.text import safe_caption
from shardloom.functions.tokens import CAPTION_TOKENS, TRANSLATION_TOKENS, encoded_column, whitespace_tokens
from shardloom.functions.tokens import pad_tokens as pad
from shardloom.operators import coverage, dataset, language, metrics, predict, routing, runs
from shardloom.operators.similarity import paired_score as paired
from shardloom.operators.translate import encode
from shardloom.plans import evaluation, training, translation
from shardloom.plans.submission import submission_from_lists as lists_to_submission
from shardloom.session import broadcast_if_small, materialize, prepare, qualified, scratch_path
from shardloom.sources import images, lists, submissions, tables, tar
from shardloom.sources.tar_format import _tars, register_shards
from shardloom.streaming import losses
from shardloom.streaming import shards as shard_stream

LOSS_BATCH, LOSS_SCALE, LOSS_BIAS = 32, 10.0, -10.0
SCORE_SCALE, SCORE_BIAS = 2.0, -1.0
TRAIN_BATCH = 16
# Documents of a JSON array, and bytes of a range of it.
ARRAY_DOCS, ARRAY_RANGE = 2_000, 1 << 18
# Bytes of a batch, and of a part, of the stream of tars.
STREAM_BATCH, STREAM_PART = 64 << 20, 4 << 20
SHUFFLE_SEED = 7

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    _QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Similarity, ranks, metrics


@query
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.retrieval_metrics(metrics.retrieval_ranks(*embedding_pairs(spark, sf_dir)))
    return rounded(out, *out.columns)


@query
def retrieval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.retrieval_ranks(*embedding_pairs(spark, sf_dir))


@query
def retrieval_ranks_by_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for two large sides."""
    return metrics.retrieval_ranks(*embedding_pairs(spark, sf_dir), resident_bytes=0)


@query
def paired_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired(*embedding_pairs(spark, sf_dir)), "score")


def top(spark: SparkSession, sf_dir: str, k: int, **sizes) -> DataFrame:
    return predict.predict_topk(
        *embedding_pairs(spark, sf_dir), k, logit_scale=SCORE_SCALE, bias=SCORE_BIAS, **sizes
    )


@query
def predict_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(top(spark, sf_dir, 5), "score")


@query
def predict_topk_by_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for two large sides."""
    return rounded(top(spark, sf_dir, 5, resident_bytes=0), "score")


@query
def predict_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = embedding_pairs(spark, sf_dir)
    return rounded(predict.predict_top1(*pairs, logit_scale=SCORE_SCALE, bias=SCORE_BIAS), "score")


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    left, right = embedding_pairs(spark, sf_dir)
    size = F.coalesce(F.max("id") + 1, F.lit(0))
    return left.agg(size).first()[0], right.agg(size).first()[0]


def coo(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return predict.to_coo(top(spark, sf_dir, k), *shape(spark, sf_dir))


@query
def prediction_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping prediction runs, so that duplicates occur."""
    both = top(spark, sf_dir, 5).unionByName(top(spark, sf_dir, 1))
    return predict.to_coo(both, *shape(spark, sf_dir))


@query
def pairs_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    submissions.write_pairs_csv(coo(spark, sf_dir, 5), path)
    return submissions.read_pairs_csv(spark, path, *shape(spark, sf_dir))


@query
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three images more than predictions, so that empty rows occur."""
    return predict.submission(coo(spark, sf_dir, 5), shape(spark, sf_dir)[0] + 3)


@query
def submission_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "submission")
    submissions.write_submission(submission(spark, sf_dir), path)
    return submissions.read_submission(spark, path)


@query
def merge_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = shape(spark, sf_dir)[0]
    multi = predict.submission(coo(spark, sf_dir, 5), n)
    return predict.merge_submissions(multi, predict.submission(coo(spark, sf_dir, 1), n))


@query
def prediction_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("caption_id"), F.col("text").alias("caption"))
    images, texts = embedding_pairs(spark, sf_dir)
    shown = predict.predict_topk(images.filter("id < 5"), texts, 5, logit_scale=SCORE_SCALE, bias=SCORE_BIAS)
    return predict.preview(shown, words)


# Captions


def with_caption(spark: SparkSession, sf_dir: str, choose: Callable[[Column, Column], Column]) -> DataFrame:
    return samples(spark, sf_dir).select("key", choose(F.col("json"), F.col("txt")).alias("caption"))


@query
def caption_en_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_caption(spark, sf_dir, cap.caption_en_first)


@query
def caption_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_caption(spark, sf_dir, cap.caption_raw)


@query
def caption_for_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_caption(spark, sf_dir, cap.caption_for_translation)


@query
def caption_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, the same text as bytes, and a number, each as a caption."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        safe_caption(F.col("text"), "string").alias("from_text"),
        safe_caption(F.col("text").cast("binary"), "binary").alias("from_bytes"),
        safe_caption(F.col("n_chars"), "bigint").alias("from_number"),
    )


@query
def pick_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = cap.pick_image(F.col("jpg"), F.col("png"))
    return samples(spark, sf_dir).select(
        "key", F.octet_length(image).cast("bigint").alias("n_bytes"), cap.has_image(image).alias("usable"),
    ).withColumn("usable", F.coalesce("usable", F.lit(False)))


# Language, routing, translation


_PROFILES: dict[tuple[str, str], language.LanguageProfile] = {}


def profile_of(spark: SparkSession, sf_dir: str) -> language.LanguageProfile:
    """The profile of all documents; a model is trained once per application and used often."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _PROFILES:
        _PROFILES[at] = language.train_language_profile(table(spark, sf_dir, "documents"))
    return _PROFILES[at]


@query
def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.trigram_counts(table(spark, sf_dir, "documents"))


@query
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.detect_language(table(spark, sf_dir, "documents"), profile_of(spark, sf_dir), ["doc_id"])
    return rounded(found, "prob", digits=4)


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language.assess_captions(d, profile_of(spark, sf_dir), ["doc_id"])


@query
def caption_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("doc_id", "letters", "has_cjk", "valid")


@query
def route_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route_model(assessed(spark, sf_dir), routing.routes(spark))
    return routed.select("doc_id", "lang", "model", "is_identity")


@query
def route_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = assessed(spark, sf_dir).filter("valid")
    return routing.route_groups(routing.route_model(valid, routing.routes(spark)))


def stand_in_model(name: str) -> Callable[[list[str]], list[str]]:
    """Deterministic model; the French one answers blanks."""
    if name == "m_fr":
        return lambda texts: ["   "] * len(texts)
    return lambda texts: [f"[{name}] {t}" for t in texts]


@query
def translate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = samples(spark, sf_dir).select("doc_id", "key", "json", "txt")
    done = translation.translate_samples(
        narrow, profile_of(spark, sf_dir), routing.routes(spark), stand_in_model, ["doc_id"]
    )
    return translated_view(done)


@query
def translate_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same translations with the rows dealt to tasks by the characters that the models are given."""
    narrow = samples(spark, sf_dir).select("doc_id", "key", "json", "txt")
    tasks = 2 * spark.sparkContext.defaultParallelism
    done = translation.translate_samples(
        narrow, profile_of(spark, sf_dir), routing.routes(spark), stand_in_model, ["doc_id"], deal=tasks
    )
    return translated_view(done)


def translated_view(done: DataFrame) -> DataFrame:
    parsed = json_object(F.col("new_json"))
    return done.select(
        "key", "translation",
        json_string(parsed, "caption_en").alias("caption_en"),
        F.try_variant_get(parsed, "$.n", "bigint").alias("n"),
    )


@query
def caption_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.caption_coverage(samples(spark, sf_dir), by="url")


@query
def caption_coverage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.caption_coverage(samples(spark, sf_dir))


@query
def translated_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.translated_examples(samples(spark, sf_dir))


# Data set


@query
def split_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("key"))
    return dataset.with_split(keyed).withColumn("score", split_score(F.col("key")))


@query
def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = training.batches_from_samples(samples(spark, sf_dir), batch_size=TRAIN_BATCH)
    return (
        train.withColumn("split", F.lit("train"))
        .unionByName(val.withColumn("split", F.lit("val")))
        .select("split", "url", "key", "batch", "row_in_batch", "caption", F.size("padded").cast("bigint").alias("width"))
    )


@query
def training_batches_from_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches read from tars, with the images' sizes."""
    train, val = training.training_batches(spark, stored_shards(spark, sf_dir) + "/*.tar", batch_size=TRAIN_BATCH)
    both = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    # A shard's batches are ordered within its source, in how many tars it may be.
    return both.select(
        "split", shard_name("source").alias("shard"), "key", "batch", "row_in_batch", "caption",
        F.size("padded").cast("bigint").alias("width"), F.octet_length("image").cast("bigint").alias("n_bytes"),
    )


@query
def pad_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding to the longest of a source, and to a fixed length without truncation."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", whitespace_tokens(F.col("text")).alias("tokens"))
    longest = pad(d, "tokens", ["source"], 64)
    fixed = pad(longest.withColumnsRenamed({"n_tokens": "n_cut", "padded": "a"}), "tokens", ["source"], 128, "max_length", False)
    return fixed.select(
        "doc_id", "n_cut", "n_tokens",
        F.array_join("a", " ").alias("longest"), F.array_join("padded", " ").alias("fixed"),
    )


@query
def buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a buffer of the validation size gives out the documents of each source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    piece = F.floor(F.col("doc_id") / 100_000)
    return dataset.buffer_shuffle(d, ["doc_id"], piece, dataset.VAL_BUFFER, "source", SHUFFLE_SEED)


def blank_tokenizer() -> Callable[[list[str]], list[tuple[list[int], list[int]]]]:
    """Stand-in tokenizer: runs between blanks, with their lengths as ids."""
    run = re.compile(r"[^\s]+")

    def tokenize(texts: list[str]) -> list[tuple[list[int], list[int]]]:
        found = [list(run.finditer(t)) for t in texts]
        return [([m.end() - m.start() for m in ms], [m.end() for m in ms]) for ms in found]

    return tokenize


@query
def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as ids and mask of fixed length: cut to what a model takes for translation, and to a caption in training."""
    long = encoded_column(blank_tokenizer, TRANSLATION_TOKENS)(F.col("text"))
    short = encoded_column(blank_tokenizer, CAPTION_TOKENS)(F.col("text"))
    both = table(spark, sf_dir, "documents").select("doc_id", long.alias("a"), short.alias("b"))
    return both.select(
        "doc_id", F.col("a.n_tokens").alias("n_tokens"), F.col("a.kept").alias("kept"),
        F.array_join(F.col("a.ids").cast("array<string>"), " ").alias("ids"), F.array_join(F.col("b.ids").cast("array<string>"), " ").alias("caption_ids"),
        F.array_join(F.col("b.mask").cast("array<string>"), "").alias("caption_mask"),
    )


# Loss and checks


def loss_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left, right = embedding_pairs(spark, sf_dir)
    return left.withColumn("batch", F.floor(F.col("id") / LOSS_BATCH).cast("bigint")), right


@query
def batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.batch_loss(*loss_batches(spark, sf_dir), LOSS_SCALE, LOSS_BIAS), "loss")


@query
def pair_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pair_loss(*embedding_pairs(spark, sf_dir), SCORE_SCALE, SCORE_BIAS), "loss")


@query
def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mean_loss(metrics.batch_loss(*loss_batches(spark, sf_dir), LOSS_SCALE, LOSS_BIAS)), "mean_loss")


@query
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.alignment_check(*embedding_pairs(spark, sf_dir), logit_scale=SCORE_SCALE), "diag", "off")


def named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(
        F.array(*map(F.lit, ("Lora_A", "lora_B", "bias", "proj.LORA_UP", "weight"))), (F.col("label") % 5 + 1).cast("int")
    )
    zeroed = F.when(F.col("vec_id") % 41 == 0, F.transform("embedding", lambda x: x * F.lit(0).cast("float")))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("layer."), F.col("vec_id").cast("string"), F.lit("."), kind).alias("name"),
        F.coalesce(zeroed, F.col("embedding")).alias("features"),
    )


@query
def vector_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.vector_audit(named_vectors(spark, sf_dir)), "norm")


@query
def vector_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.audit_summary(metrics.vector_audit(named_vectors(spark, sf_dir)))


# Runs


@query
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.early_stopping(epoch_history(spark, sf_dir))


@query
def stop_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stop_epochs(runs.early_stopping(epoch_history(spark, sf_dir)))


@query
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_epoch(epoch_history(spark, sf_dir))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = loss_batches(spark, sf_dir)
    return evaluation.evaluate(0, both, both, LOSS_BATCH, LOSS_SCALE, LOSS_BIAS)


@query
def epoch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluated(spark, sf_dir)
    return rounded(out, *[c for c in out.columns if c != "epoch"])


@query
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = evaluated(spark, sf_dir).withColumn("run", F.lit("r0"))
    return rounded(runs.metric_report(runs.best_epoch(stats)), "value")


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run, where it would have stopped and the report of its best epoch; metrics that were not taken are null."""
    stops, report = evaluation.summarize_run(epoch_history(spark, sf_dir))
    value = F.nanvl("value", F.lit(None)).alias("value")
    return report.join(stops, "run").select("run", "stop_epoch", "epoch", "metric", value)


@query
def ema_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = loss_steps(spark, sf_dir).select("run", "step", "loss")
    return rounded(runs.ema(steps, "run", "step", "loss"), "ema").drop("loss")


@query
def logged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.every_nth(loss_steps(spark, sf_dir).select("run", "step", "loss"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder names of every epoch, some of which are not epoch folders."""
    history = epoch_history(spark, sf_dir)
    number = F.col("epoch").cast("string")
    name = (
        F.when(F.col("epoch") % 7 == 3, F.concat(F.lit("epoch"), number, F.lit("b")))
        .when(F.col("epoch") % 7 == 5, F.concat(F.lit("epoch0"), number))
        .when(F.col("epoch") % 7 == 6, F.lit("best"))
        .otherwise(F.concat(F.lit("epoch"), number))
    )
    return runs.epoch_manifest(history.select("run", F.concat(F.lit("/ckpt/"), "run", F.lit("/"), name).alias("path")))


@query
def epoch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir)


@query
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(spark, sf_dir)
    plans = [("all", None), ("epoch", 4), ("keep_latest", None)]
    parts = [runs.retention_plan(found, m, e).withColumn("mode", F.lit(m)) for m, e in plans]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Sources and sinks


# Bytes of a stored tar, at about the most.
STORED_BYTES = 16 << 20
# Rounds in which stored tars are used up: bytes of one at the least, and their number at the most.
ROUND_BYTES, ROUNDS = 128 << 20, 12


def stored_shards(spark: SparkSession, sf_dir: str, part_bytes: int = STORED_BYTES) -> str:
    """All samples as tars. They are derived as they are written, so that the disk does not hold them as a table too."""
    out = scratch_path(spark, "shards")
    tar.write_shards(shard_fields(derive_samples(spark, sf_dir)), out, part_bytes)
    return out


def rounds_of(found: list[tuple[str, int]]) -> int:
    """Rounds for tars of these sizes."""
    return max(1, min(ROUNDS, len(found), sum(size for _, size in found) // ROUND_BYTES))


def used_up(spark: SparkSession, folder: str) -> Iterator[list[str]]:
    """The tars of a scratch folder in rounds of like size. Those of a round are removed when the next one is asked for.

    Tars that are copied would else be on the disk twice. The last round's stay.
    """
    found = _tars(qualified(spark, folder))
    rounds, total, before = rounds_of(found), sum(size for _, size in found) + 1, 0
    parts: list[list[str]] = [[] for _ in range(rounds)]
    for url, size in found:
        parts[before * rounds // total].append(url)
        before += size
    parts = [urls for urls in parts if urls] or [[]]
    for urls, after in zip(parts, [*parts[1:], None]):
        yield urls
        for url in urls if after else ():
            store, path = tar.locate(url)
            store.delete_file(path)


def shard_name(url: str) -> Column:
    return F.regexp_extract(url, r"([^/]+)\.tar$", 1)


@query
def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tar.read_shards(spark, stored_shards(spark, sf_dir) + "/*.tar", on_error="fail")
    typed = tar.typed_samples(read)
    return typed.select(
        shard_name("source").alias("shard"), "key", "txt",
        F.octet_length("jpg").cast("bigint").alias("jpg_bytes"),
        F.octet_length("png").cast("bigint").alias("png_bytes"),
        json_string(json_object(F.col("json")), "caption").alias("caption"),
    )


# Bytes of a damaged tar, at about the most.
DAMAGED_BYTES = 64 << 20
# Field that tells of a sample where it stands in its source; it is not written.
PLACE = "place"


class DamagedTar(tar.TarOut):
    """A tar that is damaged as it is written, by the number of its source.

    Samples count through the whole source, in however many tars it lies. Divided by 5 the number leaves the kind: the
    third sample is cut short (0), or its header overwritten (1), and the tar that would hold it or a later one gives
    nothing from there on; the third sample is repeated (2); junk (3); as it was (4). A source of under three samples
    has a damaged one more at the end (0, 1), or its last one repeated (2). A source without a number stays as it was.
    """

    def __init__(self, out_dir: str, url: str, part: int, parts: int):
        super().__init__(out_dir, url, part, parts)
        number = re.fullmatch(r"src(\d+)", url)
        self.kind = int(number[1]) % 5 if number else 4
        self.broken, self.last = False, None

    def add(self, key: str, fields: Iterable[tuple[str, bytes]]) -> None:
        found = dict(fields)
        place = found.pop(PLACE, b"")
        if self.broken or self.kind == 3:
            return
        if self.kind < 2 and place in (b"third", b"later"):
            self.spoil(key, found)
            return
        super().add(key, found.items())
        self.last = (key, found) if place == b"few" else None
        if self.kind == 2 and place == b"third":
            super().add(key, found.items())

    def spoil(self, key: str, found: dict[str, bytes]) -> None:
        """A sample that is cut short, or without a header; the tar itself must be known as one before."""
        self.broken = True
        if not self.samples:
            self.tar.addfile(tarfile.TarInfo("__part__"))
        data = b"".join(found.values())
        if self.kind == 1:
            self.tar.fileobj.write(b"\x7f" * tarfile.BLOCKSIZE + data)
            return
        info = tarfile.TarInfo(f"{key}.txt")
        info.size = len(data) + tarfile.BLOCKSIZE
        self.tar.fileobj.write(info.tobuf(tarfile.GNU_FORMAT) + data[: len(data) // 2])

    def end(self) -> None:
        if self.kind == 3:
            self.tar.fileobj.write(b"no tar" * 200)
        elif self.last and self.kind < 2:
            self.spoil("one-more", self.last[1])
        elif self.last and self.kind == 2:
            super().add(self.last[0], self.last[1].items())
        if self.broken or self.kind == 3:
            # Without the blocks that end a tar.
            self.tar.fileobj.close()
        else:
            super().end()


def damaged_shards(spark: SparkSession, sf_dir: str, part_bytes: int = DAMAGED_BYTES) -> str:
    """Text shards by source, damaged by ``DamagedTar`` in the tasks that write them."""
    folder = scratch_path(spark, "damaged")
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("url"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("key"), "text"
    )
    # A source's first rows are found inside tasks before they meet.
    rank = F.row_number().over(Window.partitionBy("url").orderBy("key"))
    third = docs.select("url", "key").withColumn("n", rank).filter("n = 3").select("url", F.col("key").alias("third"))
    placed = docs.join(broadcast_if_small(materialize(third, "third"), 100_000), "url", "left")
    place = (
        F.when(F.col("third").isNull(), "few").when(F.col("key") == F.col("third"), "third")
        .when(F.col("key") > F.col("third"), "later")
    )
    fields = F.create_map(F.lit("txt"), F.col("text").cast("binary"), F.lit(PLACE), place.cast("binary"))
    tar.write_shards(placed.select("url", "key", fields.alias("fields")), folder, part_bytes, DamagedTar)
    return folder + "/*.tar"


@query
def shard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with shards of four kinds of damage, once for a source."""
    kind = (
        F.when(F.col("error").contains("damaged header"), "damaged header")
        .when(F.col("error").contains("duplicate member"), "repeated member")
        .when(F.col("error").contains("unexpected end"), "cut short").otherwise("no tar")
    )
    return tar.shard_errors(spark, damaged_shards(spark, sf_dir)).select(
        shard_name("source").alias("shard"), kind.alias("kind")
    ).distinct()


@query
def shards_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that damaged shards give when errors are skipped."""
    read = tar.read_shards(spark, damaged_shards(spark, sf_dir), on_error="skip")
    return read.select(
        shard_name("source").alias("shard"), "key", F.octet_length(F.col("fields")["txt"]).cast("bigint").alias("n_bytes")
    )


@query
def json_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key set in documents that a variant could not hold whole; all other keys stay as they are."""
    n = F.col("doc_id").cast("string")
    text = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"x": NaN, "caption": "NaN, '), n, F.lit('"}')))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"big": 12345678901234567890123456789012345678901234'), n, F.lit(', "caption_en": "old"}')))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"x": {"y": [1, 2.5, null, true]}, "caption": "é'), n, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"k": 1, "caption": "a", "k": '), n, F.lit("}")))
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("json"))
    return docs.select(
        "doc_id", json_string(json_object(F.col("json")), "caption").alias("caption"),
        set_json_string(F.col("json"), "caption_en", F.concat(F.lit("new "), n)).alias("json"),
    )


@query
def translate_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples as tars, translated into a folder for each round of them."""
    source, out = stored_shards(spark, sf_dir), scratch_path(spark, "shards-en")
    for n, urls in enumerate(used_up(spark, source)):
        translation.translate_shards(
            spark, urls, f"{out}/round={n}", profile_of(spark, sf_dir), routing.routes(spark), stand_in_model
        )
    typed = tar.typed_samples(tar.read_shards(spark, out + "/round=*/*.tar", ("json",), "fail"))
    parsed = json_object(F.col("json"))
    return typed.select(
        shard_name("source").alias("shard"), "key",
        json_string(parsed, "caption_en").alias("caption_en"),
        F.try_variant_get(parsed, "$.n", "bigint").alias("n"),
    )


def stored_lines(spark: SparkSession, sf_dir: str) -> str:
    """Documents as padded text lines, every tenth of them blank."""
    path = scratch_path(spark, "lines")
    line = F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("  "), F.regexp_replace("text", r"[\r\n]+", " "), F.lit(" \t"))
    )
    table(spark, sf_dir, "documents").orderBy("doc_id").select(line.alias("value")).write.text(path)
    return path


@query
def line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.read_line_list(spark, stored_lines(spark, sf_dir), "caption_id", "caption")


@query
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.format_string("%09d.png", "doc_id").alias("path")
    )
    return lists.image_paths(named, "/data/imgs")


@query
def json_array_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document as a JSON array of its own."""
    arrays = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.split("text", "\n")).alias("json"))
    return lists.json_array_items(arrays, "json", ["doc_id"])


@query
def json_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents in files that hold one JSON array each, an element a line; ranges are shorter than files."""
    path = scratch_path(spark, "arrays")
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / ARRAY_DOCS).alias("slot"), F.to_json(F.array("text")).alias("one"))
    here = Window.partitionBy("slot")
    begin = F.when(F.row_number().over(here.orderBy("doc_id")) == 1, "[").otherwise(",")
    end = F.when(F.row_number().over(here.orderBy(F.desc("doc_id"))) == 1, "]").otherwise("")
    line = F.concat(begin, F.expr("substring(one, 2, length(one) - 2)"), end).alias("value")
    lines = d.select("slot", "doc_id", line).sortWithinPartitions("slot", "doc_id")
    lines.select("slot", "value").write.partitionBy("slot").text(path)
    read = lists.read_json_array(spark, path, file_col="file", range_bytes=ARRAY_RANGE)
    return read.select(F.regexp_extract("file", "slot=([0-9]+)", 1).cast("bigint").alias("slot"), "caption_id", "caption")


@query
def metadata_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metadata")
    tables.export_metadata(table(spark, sf_dir, "documents"), path)
    return spark.read.parquet(path)


def png(rgb: tuple[int, int, int], width: int = 3, height: int = 2) -> bytes:
    """A one-colour PNG."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    rows = (b"\0" + bytes(rgb) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def stored_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """A picture per document; every 13th is junk, and every 29th is listed but missing.

    A folder takes about 1,000 of them: tasks that make files in one folder wait for each other.
    """
    folder = qualified(spark, scratch_path(spark, "images"))
    names = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"),
        F.format_string("%06d/%09d.png", F.floor(F.col("doc_id") / 1000), "doc_id").alias("path"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = tar.locate(folder)
        made = set()
        for pdf in batches:
            for i, name in zip(pdf["image_id"], pdf["path"]):
                if i % 29:
                    slot = name.split("/")[0]
                    if slot not in made:
                        store.create_dir(f"{root}/{slot}", recursive=True)
                        made.add(slot)
                    data = b"junk" if i % 13 == 0 else png((i % 256, 0, 0), 2 + i % 5)
                    with store.open_output_stream(f"{root}/{name}") as out:
                        out.write(data)
            yield pdf[["image_id"]]

    store, root = tar.locate(folder)
    store.create_dir(root, recursive=True)
    names.mapInPandas(write, "image_id bigint").write.format("noop").mode("overwrite").save()
    return lists.image_paths(names, folder), folder


def sizes_of_image() -> Column:
    """An image without its pixels."""
    return F.col("image").dropFields("data")


@query
def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.read_images(spark, *stored_images(spark, sf_dir), image=sizes_of_image())
    return found.select(
        "image_id", F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
    )


@query
def unreadable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.unreadable_images(spark, *stored_images(spark, sf_dir)).select("image_id")


def pixel_encoder() -> Callable[[list[bytes]], np.ndarray]:
    """Stand-in encoder of decoded pictures two pixels high: by their width."""
    return lambda pixels: np.array([[len(p) // 6, 7 - len(p) // 6] for p in pixels], dtype=np.float32)


def length_encoder() -> Callable[[list[str]], np.ndarray]:
    """Stand-in encoder of captions: by their length."""
    return lambda texts: np.array([[len(t) % 11, 10 - len(t) % 11] for t in texts], dtype=np.float32)


@query
def submission_from_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a list of image files and a list of caption lines to a submission; unreadable pictures keep an empty row."""
    listed, folder = stored_images(spark, sf_dir)
    parts = images.image_parts(spark, listed, folder)
    pictures = (part.select("image_id", F.col("image.data").alias("image")) for part in parts)
    lines = lists.read_line_list(spark, stored_lines(spark, sf_dir), "caption_id", "caption")
    num_images = listed.agg(F.coalesce(F.max("image_id") + 1, F.lit(0))).first()[0]
    return lists_to_submission(pictures, lines, pixel_encoder, length_encoder, num_images, 5)


@query
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, folder = stored_images(spark, sf_dir)
    read = images.read_images(spark, listed, folder, image=sizes_of_image()).select("image_id", "image")
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.col("text").alias("caption"))
    return tables.profile_dataset(words.join(read, "image_id", "left"), "image_id", "caption", "image")


@query
def export_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = dataset.split_train_val(samples(spark, sf_dir))
    pairs = training.sample_pairs(train)
    out = tables.export_samples(pairs, "key", F.col("image"), F.col("caption"))
    return out.select("name", F.octet_length("image").cast("bigint").alias("n_bytes"), "caption")


# Hooks and streams

LETTERS = "abcdefgh"


def letter_encoder() -> Callable[[list[str]], np.ndarray]:
    """Stand-in encoder: counts of eight letters."""
    return lambda texts: np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32)


@query
def encode_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), letter_encoder, "text")
    return coded.select(
        "doc_id", *[F.round(F.col("features")[i].cast("double"), 4).alias(f"f{i}") for i in range(len(LETTERS))]
    )


@query
def stream_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = scratch_path(spark, "sample-stream"), scratch_path(spark, "translated")
    samples(spark, sf_dir).select("doc_id", "key", "json", "txt").write.parquet(path)
    stream = spark.readStream.schema("doc_id bigint, key string, json string, txt string").parquet(path)
    run = shard_stream.stream_translate_samples(
        stream, out, scratch_path(spark, "offsets"), profile_of(spark, sf_dir), routing.routes(spark),
        stand_in_model, ["doc_id"],
    )
    run.awaitTermination()
    return translated_view(spark.read.parquet(out))


@query
def stream_translate_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tars as they arrive, some at a time; each is translated once, into the folder of its batch."""
    source, out = stored_shards(spark, sf_dir), scratch_path(spark, "shards-en")
    found = _tars(qualified(spark, source))
    run = shard_stream.stream_translate(
        spark, source, out, scratch_path(spark, "offsets"), profile_of(spark, sf_dir), routing.routes(spark), stand_in_model,
        files_per_trigger=-(-len(found) // rounds_of(found)), use_up=True,
    )
    run.awaitTermination()
    typed = tar.typed_samples(tar.read_shards(spark, out + "/batch=*/*.tar", ("json",), "fail"))
    parsed = json_object(F.col("json"))
    return typed.select(
        shard_name("source").alias("shard"), "key", json_string(parsed, "caption_en").alias("caption_en"),
        F.try_variant_get(parsed, "$.n", "bigint").alias("n"),
    )


@query
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps arrive in three parts in time order, and the stream is restarted for each."""
    path, out, offsets = (scratch_path(spark, n) for n in ("step-stream", "smoothed", "offsets"))
    steps = materialize(loss_steps(spark, sf_dir), "steps")
    day = F.dayofmonth("ts")
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        steps.filter(part).select("run", "step", "loss").write.mode("append").parquet(path)
        stream = spark.readStream.schema("run string, step bigint, loss double").parquet(path)
        losses.stream_ema(stream, out, offsets).awaitTermination()
    return rounded(spark.read.parquet(out).select("run", "step", "ema"), "ema")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def shards_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples read as ``read.format`` with the members asked for by schema, written as ``write.format``, and read again."""
    register_shards(spark)
    stored, path = stored_shards(spark, sf_dir), qualified(spark, scratch_path(spark, "format-shards"))
    for urls in used_up(spark, stored):
        read = spark.read.format("shards").schema("url string, source string, key string, jpg binary, png binary, json string, txt string")
        first = read.option("on_error", "fail").load(qualified(spark, stored)).filter(F.col("url").isin(urls))
        named = first.withColumn("key", F.concat(shard_name("source"), F.lit("/"), F.col("key")))
        named.select("key", "jpg", "png", "json", "txt").write.format("shards").mode("append").option("split_bytes", 32 << 20).save(path)
    again = spark.read.format("shards").schema("key string, jpg binary, png binary, json string, txt string").load(path)
    return again.select(
        F.substring_index("key", "/", 1).alias("shard"), F.substring_index("key", "/", -1).alias("key"), "txt",
        F.octet_length("jpg").cast("bigint").alias("jpg_bytes"), F.octet_length("png").cast("bigint").alias("png_bytes"),
        json_string(json_object(F.col("json")), "caption").alias("caption"),
    )


@query
def stream_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of tars as a stream, a bounded number of bytes a batch, written as a table."""
    register_shards(spark)
    out, offsets = scratch_path(spark, "streamed"), scratch_path(spark, "offsets")
    read = spark.readStream.format("shards").schema("source string, key string, jpg binary, png binary, json string, txt string")
    options = {"log": qualified(spark, scratch_path(spark, "log")), "batch_bytes": STREAM_BATCH, "split_bytes": STREAM_PART, "on_error": "fail"}
    samples = read.options(**options).load(qualified(spark, stored_shards(spark, sf_dir)))
    run = samples.writeStream.format("parquet").option("checkpointLocation", offsets).start(out)
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(out).select(
        shard_name("source").alias("shard"), "key", "txt", F.octet_length("jpg").cast("bigint").alias("jpg_bytes"),
        F.octet_length("png").cast("bigint").alias("png_bytes"), json_string(json_object(F.col("json")), "caption").alias("caption"),
    )
