"""The corpus pipeline: documents in, packed training batches out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows are written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm import decontamination, jaccard_join, packing, pii, toxicity
from shardloom.llm.common import prepared, read_table
from shardloom.session import broadcast_if_small, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Ids that one broadcast may hold; more are joined by an exchange.
BROADCAST_IDS = 1_000_000


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the threshold. The model learns from this stage's own texts."""
    prepared(spark)
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, keep=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Documents without words link with nothing and stay, as do rows without id. Of rows that repeat
    an id one stays, the first by text.
    """
    prepared(spark)
    found = materialize(jaccard_join.jaccard_components(docs), "components")
    drop = found.filter("component_id <> doc_id").select("doc_id").distinct()
    copies = broadcast_if_small(materialize(drop, "copies"), BROADCAST_IDS)
    kept = docs.select(*COLUMNS).join(copies, "doc_id", "left_anti").select(*COLUMNS)
    repeated = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    if repeated.filter("doc_id IS NOT NULL").isEmpty():
        return kept
    repeated = broadcast_if_small(repeated.select("doc_id"), BROADCAST_IDS)
    again = kept.join(repeated, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    one = again.withColumn("__n", first).filter("__n = 1").select(*COLUMNS)
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which test items cover a twentieth of the words or more."""
    prepared(spark)
    found = decontamination.contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.filter("NOT contaminated").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every document stays and ``n_chars`` follows the text."""
    prepared(spark)
    clean = pii.redact_pii(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of all remaining documents."""
    prepared(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", remove_contaminated),
    ("pii", redact),
    ("packing", batches),
]

# The toxicity model and the packing of a whole corpus are beyond plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    prepared(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
