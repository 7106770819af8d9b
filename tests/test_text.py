import pytest
from pyspark.sql import functions as F

from mojiforge.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, want", [("  !!abc", "abc"), ("■,abc", ",abc"), ("A[b]&&c-d", "Ab&&cd"), ("", ""), (None, None)])
def test_remove_illegal(spark, value, want):
    assert one(spark, value, T.remove_illegal) == want


def test_half_width(spark):
    assert one(spark, "ＡＢ　１２！里", T.uniform) == "ab 12!里"


@pytest.mark.parametrize("value, want", [("一二三四五六七八九十", True), ("一二三四五六七八九", False), ("一二三四五六七八a1十", False), ("          ", False), ("", False), (None, None)])
def test_quality_gate(spark, value, want):
    assert one(spark, value, T.is_sentence_ok) == want


@pytest.mark.parametrize("value, want", [("a!!b?c!!", ["a!!", "b?c!!", "!!"]), ("没有标记", ["没有标记"]), ("甲。乙！丙。丁！", ["甲。", "乙！丙。", "丁！。"]), ("", [""])])
def test_split_dominant(spark, value, want):
    assert one(spark, value, T.split_dominant) == want


def test_split_dominant_with_gate(spark):
    assert one(spark, "一二三四五六七八九十。短。", lambda c: T.split_dominant(c, 10)) == ["一二三四五六七八九十。"]


def test_segment_long(spark):
    text = "一二三四五六七八九十。" * 20
    got = one(spark, text, T.segment)
    assert got == ["一二三四五六七八九十。"] * 20


def test_tokens(spark):
    assert one(spark, "我 爱NLP-2,你", T.split_tokens) == ["我", "爱", "NLP-2,", "你"]
    assert one(spark, "a a b b b a", lambda c: T.drop_repeated(F.split(c, " "))) == ["a", "b", "a"]
    assert [len(x) for x in one(spark, "x" * 25, lambda c: T.chunks(T.chars(c)))] == [10, 10, 5]


def test_apply_tags(spark):
    row = spark.createDataFrame([(["", "领", "按"], ["$KEEP", "$KEEP", "$REPLACE_安"]), (["按"], ["[REPLACE_UNK]"]), (["甲", "乙"], ["$APPEND_丙", "$DELETE"])], "t array<string>, l array<string>")
    assert [r.y for r in row.select(T.apply_tags(F.col("t"), F.col("l")).alias("y")).collect()] == ["领安", "", "甲丙"]


def test_tagged_codec(spark):
    df = spark.createDataFrame([(["甲", "乙"], [["$KEEP"], ["$DELETE", "$APPEND_x"], ["$KEEP"]])], "t array<string>, l array<array<string>>")
    back = df.select(T.decode_tagged(T.encode_tagged(F.col("t"), F.col("l"))).alias("y")).first().y
    assert [(x.token, x.labels) for x in back] == [("$START", ["$KEEP"]), ("甲", ["$DELETE", "$APPEND_x"]), ("乙", ["$KEEP"])]


@pytest.mark.parametrize("value, want", [("xuě", "xue3"), ("lǜ", "lü4"), ("ma", "ma")])
def test_pinyin(spark, value, want):
    assert one(spark, value, T.pinyin_digits) == want


def test_ratio(spark):
    df = spark.createDataFrame([("abca", "aacd"), ("", "")], "a string, b string")
    assert [r.y for r in df.select(T.multiset_ratio(F.col("a"), F.col("b")).alias("y")).collect()] == [0.75, 1.0]
