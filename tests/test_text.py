import hashlib
import json
import sys

import pytest
from pyspark.sql import functions as F

from shardloom.functions import captions, text
from shardloom.functions.hashing import split_score
from shardloom.functions.json import json_object, json_string, set_json_string
from shardloom.functions.tokens import pad_tokens, whitespace_tokens
from tests.conftest import rows


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c"))).first()[0]


def test_strip_equals_python_for_every_code_point(spark):
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, c + "x" + c) for i, c in enumerate(chars)], "i int, c string")
    got = dict(rows(df.select("i", text.py_strip(F.col("c")))))
    assert all(got[i] == (c + "x" + c).strip() for i, c in enumerate(chars))


@pytest.mark.parametrize("value", ["", "   ", "　 a b \t", "  ", "a", None])
def test_strip_and_nonblank(spark, value):
    want = None if value is None else value.strip()
    assert one(spark, value, text.py_strip) == want
    assert one(spark, value, text.nonblank) == (want or None)


def test_utf8_ignore_drops_bad_bytes(spark):
    for raw in (b"a\xffb", "é日".encode(), b"\xe6\x97", b""):
        assert one(spark, raw, text.utf8_ignore, "binary") == raw.decode("utf-8", "ignore")


@pytest.mark.parametrize(
    "value,letters,cjk,enough",
    [
        ("これはラーメン", 7, True, True), ("这是拉面", 4, True, True), ("라면", 2, True, True),
        ("Сосиски", 7, False, True), ("#ab", 2, False, False), ("#abc", 3, False, True),
        ("###", 0, False, False), ("123 456", 0, False, False), ("🍜🍜", 0, False, False),
        ("面", 1, True, True), ("", 0, False, False), ("  ", 0, False, False), (None, None, False, False),
    ],
)
def test_validity_without_detection(spark, value, letters, cjk, enough):
    got = spark.createDataFrame([(value,)], "c string").select(
        text.letter_count(text.cleaned_for_validity(F.col("c"))), text.has_cjk(F.col("c")), text.enough_text(F.col("c"))
    ).first()
    assert tuple(got) == (letters, cjk, enough)


def test_cjk_ranges_end_where_they_should(spark):
    edges = {0x4DFF: False, 0x4E00: True, 0x9FFF: True, 0xA000: False, 0x303F: False, 0x3040: True,
             0x30FF: True, 0x3100: False, 0xABFF: False, 0xAC00: True, 0xD7AF: True, 0xD7B0: False}
    df = spark.createDataFrame([(i, chr(i)) for i in edges], "i int, c string")
    assert dict(rows(df.select("i", text.has_cjk(F.col("c"))))) == edges


BAD = ["{bad", "[1]", "5", '"x"', "null", "", None]


def test_json_object_takes_objects_only(spark):
    for value in BAD:
        assert one(spark, value, lambda c: json_object(c).isNull()) is True
    assert one(spark, '{"a":1}', lambda c: json_object(c).isNull()) is False


@pytest.mark.parametrize(
    "value,want",
    [
        ('{"caption":"x"}', "x"), ('{"caption":5}', None), ('{"caption":null}', None), ("{}", None),
        ('{"caption":"a","caption":"b"}', "b"), ('{"caption":["x"]}', None), ('{"caption":"5"}', "5"),
    ],
)
def test_json_string(spark, value, want):
    assert one(spark, value, lambda c: json_string(json_object(c), "caption")) == want


def test_json_key_with_special_characters(spark):
    assert one(spark, '{"a.b":"x"}', lambda c: json_string(json_object(c), "a.b")) == "x"


def test_set_json_string(spark):
    put = lambda c: set_json_string(c, "caption_en", F.lit("né\"w"))
    kept = json.loads(one(spark, '{"n":1,"deep":{"k":[1,"日"]},"caption_en":"old"}', put))
    assert kept == {"n": 1, "deep": {"k": [1, "日"]}, "caption_en": 'né"w'}
    for value in BAD:
        assert json.loads(one(spark, value, put)) == {"caption_en": 'né"w'}
    assert one(spark, "{bad", lambda c: set_json_string(c, "k", F.lit(None).cast("string"))) == "{bad"


def choose_en(js, txt):
    try:
        d = json.loads(js)
    except (TypeError, ValueError):
        d = None
    if isinstance(d, dict):
        for k in ("caption_en", "caption"):
            if isinstance(d.get(k), str) and d[k].strip():
                return d[k].strip()
    return (txt or "").strip()


def test_caption_choice_against_python(spark):
    jsons = BAD + ['{"caption":" a "}', '{"caption":"  "}', '{"caption":5}', '{"caption":null}', "{}",
                   '{"caption":"a","caption_en":"b"}', '{"caption":"a","caption_en":" "}', '{"caption_en":7,"caption":"a"}']
    cases = [(j, t) for j in jsons for t in (None, "", "  ", " t ")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, json string, txt string")
    cols = F.col("json"), F.col("txt")
    got = df.select("i", captions.caption_en_first(*cols), captions.caption_raw(*cols), captions.caption_for_translation(*cols))
    for i, en, raw, translate in rows(got):
        js, txt = cases[i]
        assert en == choose_en(js, txt)
        without = js.replace('"caption_en"', '"other"') if js else js
        assert raw == choose_en(without, txt)
        try:
            d = json.loads(js)
        except (TypeError, ValueError):
            d = {}
        c = d.get("caption") if isinstance(d, dict) else None
        c = txt if c is None else c
        assert translate == (c if isinstance(c, str) and c.strip() else None)


def test_pick_image(spark):
    df = spark.createDataFrame(
        [(1, b"j", b"p"), (2, b"", b"p"), (3, None, b"p"), (4, b"j", None), (5, None, None), (6, b"", None)],
        "i int, jpg binary, png binary",
    )
    got = rows(df.select("i", captions.pick_image(F.col("jpg"), F.col("png"))), "i")
    assert [bytes(x) if x is not None else None for _, x in got] == [b"j", b"p", b"p", b"j", None, None]


def test_split_score_equals_python(spark):
    keys = ["", "000000001", "é日", "x" * 500] + [f"k{i}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    for k, score in rows(df.select("k", split_score(F.col("k")))):
        assert score == int(hashlib.md5((k or "").encode()).hexdigest(), 16) % 1_000_000 / 1_000_000.0


def test_pad_tokens(spark):
    df = spark.createDataFrame([(1, "a", "x y z"), (2, "a", "x"), (3, "b", " "), (4, "b", "p　q")], "i int, b string, t string")
    df = df.withColumn("t", whitespace_tokens(F.col("t")))
    longest = rows(pad_tokens(df, "t", ["b"], 2).select("i", "n_tokens", "padded"), "i")
    assert longest == [(1, 2, ["x", "y"]), (2, 1, ["x", "[PAD]"]), (3, 0, ["[PAD]"] * 2), (4, 2, ["p", "q"])]
    assert rows(pad_tokens(df, "t", ["b"], 2, bounded=True).select("i", "n_tokens", "padded"), "i") == longest
    fixed = rows(pad_tokens(df, "t", ["b"], 2, "max_length", truncate=False).select("i", "padded"), "i")
    assert fixed[0][1] == ["x", "y", "z"] and fixed[1][1] == ["x", "[PAD]"]
    with pytest.raises(ValueError):
        pad_tokens(df, "t", ["b"], 2, "other")


def test_safe_caption_and_paths(spark):
    assert one(spark, b"a\xffb", lambda c: text.safe_caption(c, "binary"), "binary") == "ab"
    assert one(spark, 7, lambda c: text.safe_caption(c, "int"), "int") == "7"
    assert one(spark, "a.png", lambda c: text.join_path("/d", c)) == "/d/a.png"
    assert one(spark, "a.png", lambda c: text.join_path("/d/", c)) == "/d/a.png"
    assert one(spark, "/x/a.png", lambda c: text.join_path("/d", c)) == "/x/a.png"


def test_json_keeps_what_a_variant_cannot_hold(spark):
    put = lambda c: set_json_string(c, "k", F.lit("v"))
    big = "1" * 45
    assert one(spark, f'{{"a":NaN,"b":{big},"caption":"x"}}', put) == f'{{"a": NaN, "b": {big}, "caption": "x", "k": "v"}}'
    assert one(spark, '{"k":1,"a":{"k":[1]},"k":2}', put) == '{"k": "v", "a": {"k": [1]}}'
    assert one(spark, '{"a":"\\ud800"}', put) == '{"a": "\\ud800", "k": "v"}'
    read = lambda c: json_string(json_object(c), "caption")
    assert one(spark, '{"a":NaN,"b":[-Infinity],"caption":"NaN, \\"NaN\\""}', read) == 'NaN, "NaN"'
    assert one(spark, '{"caption":NaN}', read) is None and one(spark, '{"caption":"a",NaN}', read) is None


# Texts that are, or only look like, one object.
OBJECTS = [
    "{}", " {\n} \t", '{"a":1}', '{ "a" : [1, {"k": 2}] , "b":"}" }\n', '{"a":1} junk', '{"a":1}}', '{"a":1},{"b":2}', '{"a":1}] [{"b":2}',
    '{"a":1},"y":{}}', '{"a":1}, "x":{"b":2}', '{"a":1,}', '{"a":01}', '{"a":"\\ud800"}', '{"\\u006b":1,"a":2}', '{"k":"old","a":1}', '{"a":1,"a":2}',
    '{"a":NaN}', '{"a":"x\ty"}', "\ufeff{}", '{"a":"\ufeff"}', '{"a":1e400,"b":-0.0}', '{"a":"\\/\\"\\\\"}', '{"a":' + "[" * 1200 + "]" * 1200 + "}",
    '{"a":"' + "x" * 100_000 + '"}', "\u00a0{}", '{"日":"é\u2028"}', "{'a':1}", '{"a":1}/**/', '{"a":tru}', "", " ", None,
]


def test_set_json_string_reads_as_python_does(spark):
    """Whichever way a text goes, the result reads as if Python had parsed it, set the key and written it."""
    values = ["v", "", 'q"\\ \n\x01日\u2028\U0001f600', None]
    cases = [(i, t, v) for i, (t, v) in enumerate((t, v) for t in OBJECTS for v in values)]
    df = spark.createDataFrame(cases, "i int, t string, v string")
    got = dict(rows(df.select("i", set_json_string(F.col("t"), "k", F.col("v")))))
    for i, t, v in cases:
        if v is None:
            assert got[i] == t
            continue
        try:
            whole = json.loads(t)
        except (TypeError, ValueError, RecursionError):
            whole = {}
        whole = whole if isinstance(whole, dict) else {}
        want = json.dumps({**whole, "k": v})
        found = json.loads(got[i], object_pairs_hook=lambda pairs: pairs)
        assert len({name for name, _ in found}) == len(found), t
        assert json.dumps(json.loads(got[i])) == want, t


def test_set_json_string_stays_on_the_jvm_for_plain_objects(spark):
    from pyspark.sql.types import StringType

    from shardloom.functions import json as own

    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf(StringType())
    def counted(text, key, value):
        calls.add(int(value.notna().sum()))
        return own._put.func(text, key, value)

    df = spark.createDataFrame([('{"a":1}',)] * 40 + [('{"k":1}',)] * 3, "t string")
    kept = own._put
    counted_put, own._put = counted, None
    try:
        own._put = counted_put
        out = rows(df.select(set_json_string(F.col("t"), "k", F.lit("v"))))
    finally:
        own._put = kept
    assert calls.value == 3 and sorted(set(out)) == [('{"a":1, "k": "v"}',), ('{"k": "v"}',)]


def test_choosing_a_caption_parses_its_json_once(spark):
    df = spark.createDataFrame([('{"caption": " a ", "caption_en": ""}',), ("{bad",), (None,), ("[1]",)], "json string")
    for choose, first in ((captions.caption_en_first, "a"), (captions.caption_raw, "a"), (captions.caption_for_translation, " a ")):
        chosen = df.select(choose(F.col("json"), F.lit("t")))
        # Once as it is, and once without bare NaN and Infinity.
        assert chosen._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 2
        assert [r[0] for r in chosen.collect()] == [first, "t", "t", "t"]
