"""The pipeline and the registered queries of this part."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_text_operators import base_spans, brute_components, rows
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_all_ten_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {m[1] for x in names if (m := re.match(r"(op\d+)_", x))} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(x for x in entry.oracle_sql() if re.match(r"op\d+_|pipeline", x)))
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows against a plain version over what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert out.columns == docs.columns
        kept[name], docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept[name + " out"] = docs
    text_of = {r.doc_id: r.text for r in kept["toxicity"].collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    left = {r.doc_id for r in kept["toxicity out"].collect()}
    # Eleven toxic labels in all, eight of them to learn from.
    assert len(left & toxic) < len(toxic) / 2 and len(left) >= 0.8 * (len(text_of) - len(toxic))
    data = [(r.doc_id, r.text) for r in kept["ngram_jaccard_join"].collect()]
    first = {d for d, _, c in brute_components(data) if d == c}
    assert {r.doc_id for r in kept["ngram_jaccard_join out"].collect()} == first
    before = {r.doc_id: r.text for r in kept["pii"].collect()}
    for r in kept["pii out"].collect():
        assert not base_spans(before[r.doc_id]) and r.text == before[r.doc_id] or "[" in r.text
        assert r.n_chars == len(r.text)
    packed = kept["packing out"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(before)
    whole = corpus_pipeline.run(spark, SF)
    assert rows(whole) == rows(packed)


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11),
           (3, "same words in this one here", "en", "s", 27), (4, "same words in this one here", "en", None, 27), (3, "other", "en", "s", 5)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(data)}-{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert bool(docs.count()) == bool(data)
