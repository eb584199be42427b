"""Token ids in a binary file format of 64-bit words (Simple-8b).

A word's top 4 bits select how many ids of how many bits fill the other 60. Selector 15 is the escape: the next
whole word is one id that 60 bits cannot hold. A file is a Parquet part; each of its rows is a block of
whole documents with the words, the first word of every run of ids, and the documents' lengths. Spark commits the
parts, so a lost executor leaves no half file, and any file system that Spark writes to will do.
"""

from __future__ import annotations

import json
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shardloom.llm.common import utf8

# Fixed layout, count and bits by selector; the two widest zero runs of the published code are one here.
LAYOUT = ((240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
          (3, 20), (2, 30), (1, 60))
SINGLE, ESCAPE = 14, 15
END_ID = 2
BLOCK_IDS, RUN_IDS = 1 << 16, 1 << 14
# Bytes of texts encoded together, and distinct words whose ids a worker remembers, and as many of the filling up before.
TEXT_BYTES, MEMORY = 4 << 20, 300_000


def encode_words(ids: np.ndarray) -> np.ndarray:
    """Pack unsigned ids into words, as many in each as fit, from left to right."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    # Bits of each id, of both halves apart, as doubles hold 32 bits exactly.
    low, high = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64), (ids >> np.uint64(32)).astype(np.float64)
    width = np.frexp(low)[1].astype(np.uint8)
    if high.any():
        width = np.where(high > 0, np.frexp(high)[1] + 32, width).astype(np.uint8)
    # For every place the widest selector that fits there: its count of ids must reach no wider id.
    selector = np.where(width > 60, ESCAPE, SINGLE).astype(np.uint8)
    for s in range(len(LAYOUT) - 2, -1, -1):
        count, bits = LAYOUT[s]
        narrow = width <= bits
        if count > n or np.count_nonzero(narrow) < count:
            continue
        wide = np.zeros(n + 1, np.int32)
        np.cumsum(~narrow, dtype=np.int32, out=wide[1:])
        np.copyto(selector[: n - count + 1], np.uint8(s), where=wide[count:] == wide[:-count])
    step = np.array([c for c, _ in LAYOUT] + [1], np.int64)[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    size = np.where(chosen == ESCAPE, 2, 1)
    place = np.r_[0, np.cumsum(size)[:-1]]
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(LAYOUT):
        mine = chosen == s
        if bits and mine.any():
            first, packed = starts[mine], np.zeros(int(mine.sum()), np.uint64)
            for k in range(count):
                packed |= ids[first + k] << np.uint64(k * bits)
            words[place[mine]] |= packed
    escaped = chosen == ESCAPE
    words[place[escaped] + 1] = ids[starts[escaped]]
    return words


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of packed words, a selector at a time over all its words at once."""
    if not len(words):
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    # A word after an escape is data, unless it is itself the data of the escape before.
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[at]:
            raw[at + 1] = True
    count = np.where(raw, 1, np.array([c for c, _ in LAYOUT] + [0], np.int64)[selector])
    place = np.r_[0, np.cumsum(count)]
    ids = np.zeros(int(place[-1]), np.uint64)
    for s, (k, bits) in enumerate(LAYOUT):
        mine = np.flatnonzero((selector == s) & ~raw)
        if bits and len(mine):
            mask = np.uint64((1 << bits) - 1)
            for j in range(k):
                ids[place[mine] + j] = (words[mine] >> np.uint64(j * bits)) & mask
    ids[place[:-1][raw]] = words[raw]
    return ids


# How a tokenizer must normalise and split for texts to be encoded part by part. No piece then reaches over a blank.
PART_NORMALIZERS = ("NFC", "Replace", "Lowercase")
PART_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_parts(tokenizer: Tokenizer) -> bool:
    """Whether the ids of a text's parts between blanks, in a row, are the text's ids."""
    told = json.loads(tokenizer.to_str())
    normal, split = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    steps, cuts = normal.get("normalizers", []), split.get("pretokenizers", [])
    blanks = [x for x in steps if x["type"] == "Replace" and (x["pattern"], x["content"]) != ({"Regex": r"\s+"}, " ")]
    return (
        tuple(x["type"] for x in steps) == PART_NORMALIZERS and not blanks
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": PART_PATTERN}, "Removed", True)
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and not any(" " in x["content"] or x["normalized"] or x["lstrip"] or x["rstrip"] for x in told["added_tokens"])
    )


# Byte-level tokenizers write a byte as a character: a printable one as itself, the others, in order, as those from 256 on.
HIDDEN_BYTES = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(HIDDEN_BYTES)}
# Latin letters, which end before U+0250, as such a tokenizer writes them.
LATIN_END = 0x250
LATIN_LETTERS = {chr(i): chr(i).encode().decode("latin-1").translate(BYTE_LETTERS) for i in range(LATIN_END)}
# Plain marks but those that special tokens are written with.
MARKS = "".join(c for c in string.punctuation if c not in "<|>")
# A word of Latin letters, without the one that becomes two characters in lower case, and the marks behind.
PLAIN_PART = (
    r"^(?P<word>[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+)"
    rf"(?P<marks>[{re.escape(MARKS)}]*)$"
)


class _Parts(dict):
    """Ids, as bytes, of the parts of texts between blanks; what is not known is tokenised when it is asked for.

    A word of Latin letters in lower case is one piece for the tokenizer, so its model takes it as it is, without
    normalising and splitting. What has been asked for since the last but one filling up stays known.
    """

    def __init__(self, tokenizer: Tokenizer, most: int) -> None:
        super().__init__()
        self.tokenizer, self.model, self.normal = tokenizer, tokenizer.model, tokenizer.normalizer.normalize_str
        self.most, self.older = most, {}

    def __missing__(self, part: str) -> bytes:
        known = self.older.get(part)
        if known is None:
            known = self._tokenise(part)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[part] = known
        return known

    def _tokenise(self, part: str) -> bytes:
        if part.isalpha() and _latin(part) and part == part.lower():
            letters = part if part.isascii() else "".join(map(LATIN_LETTERS.__getitem__, part))
            ids = [token.id for token in self.model.tokenize(letters)]
        else:
            word, marks = _word_and_marks(part, self.normal)
            if marks:
                return self[word] + self[marks]
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class _Encoder:
    """Ids of whole texts; where the tokenizer allows it, from the ids of parts, each tokenised once as long as it is remembered.

    A tokenizer that keeps parts between blanks apart is checked for by ``_by_parts``; with any other, texts are encoded
    whole.
    """

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _Parts(self.tokenizer, memory) if _by_parts(self.tokenizer) else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.parts is None:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if not texts:
            return []
        lists = pc.split_pattern(pa.array([t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts], pa.string()), " ")
        ends = lists.offsets.to_numpy()
        seen = lists.flatten().dictionary_encode()
        # Of the distinct parts, plain words in lower case and the marks behind them; all other parts as they are.
        both = pc.extract_regex(seen.dictionary, PLAIN_PART)
        word = pc.coalesce(pc.utf8_lower(pc.struct_field(both, "word")), seen.dictionary)
        marks = pc.fill_null(pc.struct_field(both, "marks"), "")
        pool = pa.concat_arrays([word, marks]).dictionary_encode()
        raw = list(map(self.parts.__getitem__, pool.dictionary.to_numpy(zero_copy_only=False)))
        ids, size = np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        # Each part is two entries of the pool; ids are gathered entry by entry.
        entry = pool.indices.to_numpy().reshape(2, -1)[:, seen.indices.to_numpy()].T.ravel()
        begin = np.r_[0, np.cumsum(size)[:-1]]
        n = size[entry]
        reached = np.r_[0, np.cumsum(n)]
        found = ids[np.repeat(begin[entry] - reached[:-1], n) + np.arange(reached[-1])]
        return np.split(found, reached[2 * ends[1:-1]])


def _latin(word: str) -> bool:
    """Whether Python lower-cases the word as the tokenizer does, and nothing in it is there to be composed."""
    return word.isascii() or ord(max(word)) < LATIN_END and "\u0130" not in word


def _word_and_marks(part: str, normal: Callable[[str], str]) -> tuple[str, str]:
    """A part as two that the tokenizer keeps apart: up to its last letter, and plain marks behind.

    What counts is the last character as the tokenizer has normalised it: lower-casing or composing may end a word in a
    combining mark, which is one piece with the marks behind. The tokenizer lower-cases, so Latin words may
    be so already; special tokens, which are not, have a ``<``.
    """
    word = part.rstrip(MARKS)
    latin = _latin(word)
    if not word or not (word if latin or len(word) == len(part) else normal(word))[-1:].isalpha():
        word = part
    marks = part[len(word) :]
    if latin:
        word = word if "<" in word else word.lower()
    return word, marks


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    """One for all tasks of a worker process."""
    return _Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every text of ``docs`` (``doc_id, text``) and write files in ascending order of ``doc_id``.

    A null text is empty; every document ends with ``end_id``. Rows that repeat an id follow each other by text; rows
    without id come first. ``tokenizer`` is a path that every worker can read.
    """
    spark = docs.sparkSession
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        block = 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids, raw = batch.column("doc_id").to_pylist(), batch.column("bytes")
            for lo, hi in _stretches(raw):
                texts = [b.decode("utf-8", "replace") for b in raw.slice(lo, hi - lo).to_pylist()]
                for doc, coded in zip(ids[lo:hi], encoder.encode(texts)):
                    names.append(doc)
                    held.append(np.concatenate([coded, end]))
                    size += len(held[-1])
                    if size >= BLOCK_IDS:
                        yield _block(block, names, held)
                        block, names, held, size = block + 1, [], [], 0
        if names:
            yield _block(block, names, held)

    ordered = (
        docs.select("doc_id", utf8().alias("bytes")).repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "bytes")
    )
    coded = ordered.mapInArrow(
        encode, "block long, doc_ids array<long>, lengths array<long>, run_starts array<long>, words binary"
    )
    coded.withColumn("file", F.spark_partition_id()).write.mode("overwrite").parquet(path)


def _stretches(raw: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows that are encoded together: about ``TEXT_BYTES``, one at least."""
    reached = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False)) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(reached)) + 1).tolist(), len(raw)]
    yield from zip(cuts, cuts[1:])


def _block(block: int, names: list, held: list[np.ndarray]) -> pa.RecordBatch:
    """One row: documents' ids and lengths, and their token ids in runs that start at known words."""
    ids = np.concatenate(held)
    runs = [encode_words(ids[i : i + RUN_IDS]) for i in range(0, len(ids), RUN_IDS)]
    starts = np.r_[0, np.cumsum([len(r) for r in runs])[:-1]]
    return pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([names], pa.list_(pa.int64())),
        pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([starts.tolist()], pa.list_(pa.int64())),
        pa.array([np.concatenate(runs).astype("<u8").tobytes()], pa.binary()),
    ], names=["block", "doc_ids", "lengths", "run_starts", "words"])


def _documents(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """``doc_id``, first position in the block, ids of the block's documents."""
    ids = decode_words(np.frombuffer(row["words"], "<u8")).astype("<u4")
    at = 0
    for doc, n in zip(row["doc_ids"], row["lengths"]):
        yield doc, at, ids[at : at + n]
        at += n


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of written files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(_documents(batch.slice(i, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([d for d, _, _ in found], pa.int64()), pa.array([len(x) for *_, x in found], pa.int64()),
                    pa.array([x.tobytes() for *_, x in found], pa.binary()),
                ], names=["doc_id", "n_tokens", "ids"])

    return spark.read.parquet(path).mapInArrow(decode, "doc_id long, n_tokens long, ids binary")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of written files.

    ``start`` counts all ids before the document: those of earlier files and blocks, from the small table of
    block sums, and those before it in its block. Ids are decoded once and never shuffled.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = list(_documents(row))
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["file"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()),
                    pa.array([d for d, _, _ in found], pa.int64()), pa.array([at for _, at, _ in found], pa.int64()),
                    pa.array([len(x) for *_, x in found], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for *_, x in found], pa.int64()),
                ], names=["file", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path)
    sums = blocks.select("file", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    # One row for each file goes through one task; the blocks of a file are numbered by themselves.
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(*earlier)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(*earlier)), F.lit(0))
    files = sums.groupBy("file").agg(F.sum("n").alias("n")).select("file", ahead.alias("ahead"))
    offsets = sums.select("file", "block", inside.alias("inside")).join(files, "file").select(
        "file", "block", (F.col("ahead") + F.col("inside")).alias("before")
    )
    documents = blocks.mapInArrow(
        index, "file int, block long, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return documents.join(offsets, ["file", "block"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
