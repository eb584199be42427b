import dataclasses
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardloom.operators import language, routing, translate
from shardloom.operators.coverage import caption_coverage, translated_examples
from tests.conftest import rows

TRAIN = [("en", "the cat sat on the mat with the hat"), ("de", "die Katze saß auf der Matte mit dem Hut"),
         ("es", "el gato se sentó en la alfombra"), ("zh-cn", "这是一碗很好吃的拉面")]


@pytest.fixture(scope="module")
def small(spark):
    return language.train_language_profile(spark.createDataFrame(TRAIN, "lang string, text string"))


def grams(text):
    out, run = [" "], True
    for ch in text:
        if ch.isalpha():
            out.append(ch)
            run = False
        elif not run:
            out.append(" ")
            run = True
    if not run:
        out.append(" ")
    t = "".join(out)
    return [t[i : i + 3] for i in range(len(t) - 2)]


def model(text):
    counts = {g: Counter(grams(t)) for g, t in TRAIN}
    vocab = len(set().union(*counts.values()))
    found = grams(text)
    if not found:
        return "en", 0.0
    score = {
        g: sum(round(math.log((c[x] + 1) / (sum(c.values()) + vocab)) * 1e6) for x in found) for g, c in counts.items()
    }
    best = min(score, key=lambda g: (-score[g], g))
    return best, 1 / sum(math.exp((s - score[best]) / 3e6) for s in score.values())


TEXTS = ["the hat", "die Matte", "el gato", "拉面", "a", "", "  ", "123", "🍜", "𠀀𠀁𠀂", "xyz", "the" * 50, "ça va", None]


def test_detection_against_python(spark, small):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for i, lang, prob in rows(language.detect_language(df, small, ["i"])):
        want = model(TEXTS[i] or "")
        assert lang == want[0], TEXTS[i]
        assert math.isclose(prob, want[1], rel_tol=1e-9, abs_tol=1e-12), TEXTS[i]


def test_trigrams_keep_surrogate_pairs_whole(spark):
    df = spark.createDataFrame([("𠀀𠀁",)], "t string")
    assert df.select(language.trigrams(F.col("t"))).first()[0] == [" 𠀀𠀁", "𠀀𠀁 "]


def test_parts_of_a_profile_give_the_same(spark, small, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    want = rows(language.detect_language(df, small, ["i"]), "i")
    monkeypatch.setattr(language, "PROFILE_BYTES", 200)
    monkeypatch.setattr(language, "SLICE", 10)
    parted = dataclasses.replace(small)
    assert rows(language.detect_language(df, parted, ["i"]), "i") == want
    assert len(parted.scorers()) > 2


def test_texts_are_scored_where_they_lie(spark, small):
    """No join, no exchange and no row for a gram, also where a text is judged twice."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for found in (language.detect_language(df, small, ["i"]), language.assess_captions(df, small, ["i"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("Join", "Exchange", "Generate", "Aggregate") if x in plan]


def test_long_text_and_columns_of_the_same_name(spark, small):
    df = spark.createDataFrame([(1, "the cat " * 200_000, "x", 5), (2, None, "y", 6)], "i int, text string, lang string, grams int")
    got = rows(language.assess_captions(df, small, ["i"]).select("i", "grams", "lang", "valid"), "i")
    assert got[0][:2] == (1, 5) and got[0][2] == model("the cat " * 200)[0] and got[1] == (2, 6, "en", False)


def test_holdout_accuracy(spark, docs):
    train, test = docs.filter("doc_id % 5 > 0"), docs.filter("doc_id % 5 = 0")
    profile = language.train_language_profile(train)
    found = language.detect_language(test, profile, ["doc_id"]).join(test.select("doc_id", F.col("lang").alias("want")), "doc_id")
    right, n, low = found.agg(F.count_if(F.col("lang") == F.col("want")), F.count("*"), F.min("prob")).first()
    assert right >= 0.95 * n and low > 0


def test_no_training_rows(spark):
    empty = language.train_language_profile(spark.createDataFrame([], "lang string, text string"))
    df = spark.createDataFrame([(1, "abc")], "i int, text string")
    assert rows(language.detect_language(df, empty, ["i"])) == [(1, "en", 0.0)]


def test_validity_ignores_hash_but_routing_does_not(spark, small):
    df = spark.createDataFrame([(1, "the#cat sat"), (2, "#"), (3, None), (4, "the cat")], "i int, text string")
    got = {r.i: r for r in language.assess_captions(df, small, ["i"]).collect()}
    assert got[1].prob == pytest.approx(model("the cat sat")[1]) and got[1].letters == 9
    assert not got[2].valid and not got[3].valid and got[3].letters == 0
    assert got[4].valid == (model("the cat")[1] >= 0.75)


def test_routes(spark):
    detected = [("en", 0.90), ("en", 0.8999), ("en", 0.0), ("zh-cn", 0.99), ("zh-tw", 0.1), ("zh", 0.99),
                ("pt", 0.99), ("nl", 0.99), ("ja", 0.75), ("ko", 0.7499)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(detected)], "i int, lang string, prob double")
    got = rows(routing.route_model(df, routing.routes(spark)).select("i", "model", "is_identity"), "i")
    want = ["", "m_default", "m_default", "m_zh", "m_zh", "m_zh", "m_default", "m_default", "m_ja", "m_ko"]
    assert [g[1] for g in got] == want and [g[2] for g in got] == [True] + [False] * 9


def test_route_groups(spark):
    df = spark.createDataFrame([("m_de", False)] * 65 + [("m_ja", False)] + [("", True)] * 3, "model string, is_identity boolean")
    assert rows(routing.route_groups(df), "model") == [("m_de", 65, 2), ("m_ja", 1, 1)]


def upper_model(name):
    if name == "m_blank":
        return lambda texts: [" "] * len(texts)

    def run(texts):
        assert 0 < len(texts) <= 2
        return [f"  {name}:{t} " for t in texts]

    return run


@pytest.mark.parametrize("spread,deal", [(None, None), (3, None), (None, 5)])
def test_translate_micro_batches_and_order(spark, spread, deal):
    data = [(i, f" t{i} ", i % 7 != 0, ["m_a", "m_b", "m_blank", ""][i % 4], i % 4 == 3) for i in range(40)]
    df = spark.createDataFrame(data, "i int, text string, valid boolean, model string, is_identity boolean")
    got = dict(rows(translate.translate(df, upper_model, batch=2, spread=spread, spread_by=["i"], deal=deal).select("i", "translation")))
    for i, text, valid, model_name, identity in data:
        want = "" if not valid or model_name == "m_blank" else text.strip() if identity else f"{model_name}:{text.strip()}"
        assert got[i] == want


def test_wrong_model_answer_fails(spark):
    df = spark.createDataFrame([("t", True, "m", False)], "text string, valid boolean, model string, is_identity boolean")
    with pytest.raises(Exception, match="returned 0 texts"):
        translate.translate(df, lambda name: lambda texts: [], batch=2).collect()


def test_translate_one(spark, small):
    table = routing.routes(spark)
    assert translate.translate_one(spark, None, small, table, upper_model) == ""
    got = translate.translate_one(spark, " 这是一碗很好吃的拉面 ", small, table, upper_model)
    assert got == "m_zh:这是一碗很好吃的拉面"


def test_encode_keeps_nulls_and_batches(spark):
    import numpy as np

    def load():
        def run(values):
            assert len(values) <= 2
            return np.array([[len(v), 0.0] for v in values])

        return run

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "x"), (5, "yy")], "i int, t string")
    got = rows(translate.encode(df, load, "t", batch=2).select("i", "features"), "i")
    assert got == [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0])]


def test_coverage(spark):
    df = spark.createDataFrame(
        [("u", "1", '{"caption_en":"x"}'), ("u", "2", '{"caption_en":" "}'), ("v", "3", "{bad"), ("u", "0", '{"caption_en":"y"}')],
        "url string, key string, json string",
    )
    assert rows(caption_coverage(df)) == [(4, 2, 0.5)]
    assert rows(caption_coverage(df, by="url"), "url") == [("u", 3, 2, 0.667), ("v", 1, 0, 0.0)]
    assert rows(caption_coverage(df.filter("false"))) == [(0, 0, None)]
    assert rows(translated_examples(df, n=1)) == [("u", "0", "y")]


def test_a_filter_on_the_answer_calls_the_model_once(spark):
    df = spark.createDataFrame([("t", True, "m", False)], "text string, valid boolean, model string, is_identity boolean")
    out = translate.translate(df, upper_model, batch=2).filter("translation <> ''").select("translation")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and rows(out) == [("m:t",)]


def test_a_worker_loads_a_model_once(spark, tmp_path):
    """Loads are counted by process, over many more tasks than workers."""
    import os
    import uuid

    from shardloom.operators.translate import translate

    folder = str(tmp_path)

    def load(name):
        open(f"{folder}/{name}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: texts

    df = spark.range(200).selectExpr("id", "'t' AS text", "true AS valid", "concat('m', id % 3) AS model", "false AS is_identity")
    assert translate(df.repartition(40), load).filter("translation = 't'").count() == 200
    loads = [name.rsplit("-", 1)[0] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads))


def test_cost_is_dealt_evenly_whatever_the_routes(spark):
    """One model with nine tenths of the rows and the longest texts; nulls and repeated texts are dealt too."""
    cost = F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 10 < 9, F.col("id") % 700).otherwise(3))
    model = F.when(F.col("id") % 10 < 9, "m_hot").when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("m"), (F.col("id") % 50).cast("string")))
    df = spark.range(20_000).select("id", model.alias("model"), cost.alias("cost"), F.lit("x").alias("__text"))
    dealt = translate.deal_by_cost(df, 16, F.col("cost"), by=["id"])
    assert dealt.columns == df.columns and dealt.rdd.getNumPartitions() == 16
    got = rows(dealt.select(F.spark_partition_id(), "id", "model", "cost"))
    assert sorted(r[1] for r in got) == list(range(20_000))
    paid, models = [0] * 16, [set() for _ in range(16)]
    for task, _, name, c in got:
        paid[task] += (c or 0) + 1
        models[task].add(name)
    assert max(paid) <= 2 * min(paid)
    assert sum(len(m) == 1 for m in models) >= 13
    order = [(r[2] or "", -(r[3] or 0)) for r in got if r[0] == 15]
    assert order == sorted(order)


def test_deal_of_nothing_of_ties_and_of_one_row(spark):
    df = spark.createDataFrame([("m", 5)] * 30, "model string, cost int")
    assert translate.deal_by_cost(df, 4, F.col("cost")).count() == 30
    assert translate.deal_by_cost(df.limit(1), 4, F.col("cost")).count() == 1
    assert translate.deal_by_cost(df.filter("false"), 4, F.col("cost")).count() == 0
    with pytest.raises(ValueError):
        translate.deal_by_cost(df, 0, F.col("cost"))


def test_only_rows_for_a_model_are_dealt(spark, monkeypatch):
    """Rows that no model is given cost nothing and would all be one task's; they stay where they are."""
    dealt, deal = [], translate.deal_by_cost

    def counted(df, *args, **options):
        dealt.append(df.count())
        return deal(df, *args, **options)

    monkeypatch.setattr(translate, "deal_by_cost", counted)
    data = [(i, f"t{i}", [True, False, None][i % 3], "" if i % 2 else "m_a", bool(i % 2)) for i in range(600)]
    df = spark.createDataFrame(data, "i int, text string, valid boolean, model string, is_identity boolean")
    got = rows(translate.translate(df, upper_model, batch=2, deal=4, spread_by=["i"]).select("i", "translation"))
    assert dealt == [100] and sorted(r[0] for r in got) == list(range(600))


def test_grams_of_many_kinds_and_of_few(spark, monkeypatch):
    """Grams counted by cells or by sorting, in slices of any size, are the overlapping ones of each text."""
    texts = ["abcabc", "", None, "a", "été 𠀀𠀁𠀂 été", "a1b", "été", "x\ny"]
    df = spark.createDataFrame([(t, "aa" if i % 2 else "bb") for i, t in enumerate(texts)] + [("abc", None)], "text string, lang string")
    want = {}
    for t, g in zip(*zip(*df.select(F.explode(language.trigrams(F.col("text"))), "lang").collect())):
        if g:
            want[g, t] = want.get((g, t), 0) + 1
    for cells, size in ((1 << 21, 1 << 20), (0, 1 << 20), (1 << 21, 4)):
        monkeypatch.setattr(language, "CELLS", cells)
        monkeypatch.setattr(language, "SLICE", size)
        assert {(r.lang, r.gram): r.n for r in language.trigram_counts(df).collect()} == want


def test_a_batch_of_texts_yields_a_row_per_gram_not_per_place(spark):
    """Text reaches the exchange as counts of grams; no row stands for a place in a text."""
    df = spark.range(200).select(F.repeat(F.lit("soup and bread "), 50).alias("text"), F.lit("en").alias("lang")).coalesce(1)
    plan = language.trigram_counts(df)._jdf.queryExecution().toString()
    assert "Generate explode" not in plan and "MapInArrow" in plan
