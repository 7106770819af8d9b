"""Line numbers of many wide rows, and what stands on them."""

import pytest
from pyspark.sql import functions as F

from mojiforge.operators import conversion, datasets
from mojiforge.operators.dictionaries import line_ids
from mojiforge.sources import files

N = 60_000


@pytest.fixture(params=[8, 200])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def wide(spark):
    return spark.range(N).select(F.col("id").alias("k"), F.concat(F.repeat(F.md5(F.col("id").cast("string")), 40), F.lit("x")).alias("text"))


def test_all_wide_rows_get_a_line(spark, partitions):
    got = line_ids(wide(spark), ["k"]).agg(F.count("*"), F.countDistinct("line"), F.min("line"), F.max("line"), F.count_if(F.col("line") == F.col("k")), F.count("text")).first()
    assert tuple(got) == (N, N, 0, N - 1, N, N)


def test_files_and_shards_of_wide_rows(spark, partitions, tmp_path):
    rows = wide(spark)
    path = str(tmp_path / "a")
    files.write_lines(rows, path, "text", ["k"])
    assert files.read_lines(spark, path).agg(F.countDistinct("line")).first()[0] == N
    both = files.read_parallel(spark, path, path)
    assert both.where("source = target").count() == N
    assert files.read_parallel(spark, path, path, first=10).count() == 10
    for keep, want in ((True, N), (False, N // 7 * 7)):
        assert datasets.shards(rows, ["k"], 7, keep).count() == want


def test_no_lines(spark):
    assert line_ids(wide(spark).limit(0), ["k"]).count() == 0


def test_repeated_sources_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(conversion, "MAX_ENTRIES", 3)
    t = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "9"), ("c", "7"), (None, "x")], "source string, target string")
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    assert {r.id: r.converted for r in conversion.convert(rows, "id", "text", t).collect()} == {1: "397", 2: None}
    with pytest.raises(ValueError):
        conversion.convert(rows, "id", "text", t.unionByName(spark.createDataFrame([("d", "e")], t.schema)))


def test_bytes_keep_a_spelled_replacement_character(spark):
    df = spark.createDataFrame([(bytearray("甲�乙".encode() + b"\xff\xe4"),)], "b binary")
    assert df.select(files.decode_bytes(F.col("b"))).first()[0] == "甲�乙"


def test_most_similar_is_brute_force(spark):
    import itertools
    from collections import Counter

    a = [(i, t) for i, t in enumerate(["今天天气很好", "aab", "", "今天天气", "x" * 50, "今天天气很好"])]
    b = [(10 + i, t) for i, t in enumerate(["今天天气不好", "aabb", "bbaa", "", "今天", "天今", "xx"])] + [(99, None)]
    want = sorted((-round(2 * sum((Counter(s) & Counter(t)).values()) / max(1, len(s) + len(t)), 6), i, j) for (i, s), (j, t) in itertools.product(a, b) if t is not None)[:10]
    left, right = spark.createDataFrame(a, "a_id long, a string"), spark.createDataFrame(b, "b_id long, b string")
    for chars in (1 << 22, 8):
        got = [(-r.ratio, r.a_id, r.b_id) for r in datasets.most_similar(left, right, 10, chars).collect()]
        assert got == want
    assert datasets.most_similar(left.limit(0), right).count() == 0


def test_training_examples(spark):
    pairs = spark.createDataFrame([(1, "今天天气真错", "今天天气真不错"), (2, "爱你", "我爱你"), (3, None, "x"), (4, "", ""), (5, "真天气" + "错天" * 20, "对天气" + "错天" * 20)], "id long, source string, target string")
    labels = spark.createDataFrame([("$KEEP", 0), ("[REPLACE_UNK]", 1), ("[APPEND_UNK]", 2), ("$APPEND_不", 3)], "label string, label_id long")
    tokens = spark.createDataFrame([(c, i) for i, c in enumerate("始今天气真错", 4)], "token string, id int")
    got = {r.id: (r.input_ids, r.attention_mask, r.tags) for r in datasets.training_examples(pairs, "id", labels, tokens, 12).collect()}
    assert got[1] == ([2, 4, 5, 6, 6, 7, 8, 9, 3, 0, 0, 0], [1] * 9 + [0] * 3, [-100, 0, 0, 0, 0, 0, 3, 0] + [-100] * 4)
    assert got[2] == ([2, 4, 1, 1, 3] + [0] * 7, [1] * 5 + [0] * 7, [-100, 2, 0, 0] + [-100] * 8)
    assert 3 not in got and len(got[5][2]) == 12 and got[5][2][1:3] == [0, 1]


def test_predictor_and_decoding(spark):
    from mojiforge.operators import tagging

    rows = spark.createDataFrame([(1, ["甲", "乙"], [[9.0, 0.0], [0.0, 1.0], [2.0, 0.0]], [[9.0, 0.0], [0.0, 1.0], [0.0, 2.0]])], "id long, tokens array<string>, a array<array<double>>, b array<array<double>>")
    tags = spark.createDataFrame([(0, "$KEEP"), (1, "$DELETE")], "id int, tag string")
    got = [(r.pos, r.token, r.tag) for r in tagging.predict(rows, "id", "tokens", ["a", "b"], tags).orderBy("pos").collect()]
    assert got == [(0, "甲", "$DELETE"), (1, "乙", "$KEEP")]  # equal probabilities: the smaller id
    biased = [r.tag for r in tagging.predict(rows, "id", "tokens", ["a", "b"], tags, bias=0.9).orderBy("pos").collect()]
    assert biased == ["$KEEP", "$KEEP"]
    ids = spark.createDataFrame([(0,), (-100,), (7,)], "label int")
    assert {r.label: r.tag for r in tagging.decode_labels(ids, "label", tags).collect()} == {0: "$KEEP", -100: "-100", 7: None}


def test_unknown_transform_fails(spark):
    from mojiforge.functions import text as T

    df = spark.createDataFrame([("a", "$TRANSFORM_CASE_NONE")], "t string, l string")
    with pytest.raises(Exception, match="unknown transform"):
        df.select(T.transform_token(F.col("t"), F.col("l"))).collect()


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("n", [0, 1, 10, 11, 95])
def test_pairs_of_several_batches_by_suffix(spark, small_batches, tmp_path, n):
    rows = [(i, f"错{i}\",", None if i % 7 == 0 else f"对{i}") for i in range(n)]
    path = str(tmp_path / "a.json")
    files.write_json_arrays(spark.createDataFrame(rows, "id long, source string, target string").coalesce(1), path, ["id"])
    assert sorted(tuple(r) for r in files.read_pairs(spark, path).collect()) == sorted(r[1:] for r in rows)


def test_pairs_and_dictionaries_of_several_batches(spark, small_batches, tmp_path):
    pairs = [(i, f"错{i}", f"对{i}" if i % 5 else None, "positive" if i % 3 else None) for i in range(95)]
    path = str(tmp_path / "pairs")
    files.write_json_arrays(spark.createDataFrame(pairs, files.PAIR).coalesce(1), path, ["id"])
    assert {tuple(r) for r in files.read_pairs_json(spark, path).collect()} == {*pairs}
    entries = spark.createDataFrame([(f"字{i}", i) for i in range(95)], "key string, value long").coalesce(1)
    files.write_dictionary(entries, str(tmp_path / "entries"))
    assert {r.key: r.value for r in files.read_dictionary(spark, str(tmp_path / "entries")).collect()} == {f"字{i}": i for i in range(95)}


def test_pairs_with_a_null_id_stay(spark, tmp_path):
    """The query gives what its SQL gives; the reader by itself still fails without a required field."""
    import __spark_entry__

    rows = [(1, "甲", "乙", "positive"), (None, "丙", None, None), (None, "丁", "戊", "negative"), (2, None, "己", "positive"), (None, "丙", None, None)]
    spark.createDataFrame(rows, files.PAIR).write.parquet(str(tmp_path / "json_data.parquet"))
    got = [tuple(r) for r in __spark_entry__.queries()["pairs_json_file"](spark, str(tmp_path)).collect()]
    assert len(got) == 3 and set(got) == {r for r in rows if r[1] is not None}
    files.write_json_arrays(spark.createDataFrame(rows[:3], files.PAIR), str(tmp_path / "pairs"), ["id"])
    with pytest.raises(Exception, match="missing field id"):
        files.read_pairs_json(spark, str(tmp_path / "pairs")).collect()
