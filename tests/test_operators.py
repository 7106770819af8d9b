import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mojiforge.operators import align, augment, conversion, datasets, metrics, segment, similarity, tagging, templates
from mojiforge.operators import dictionaries as D
from mojiforge.plans import catalogue, correction_queries  # noqa: F401  (registers its queries)
from mojiforge.sources import files


@pytest.mark.parametrize(
    "source, target, want",
    [
        ("今天天气真错", "今天天气真不错", ["$KEEP"] * 5 + ["$APPEND_不", "$KEEP"]),
        ("爱你", "我爱你", ["$APPEND_我", "$KEEP", "$KEEP"]),
        ("我我爱你", "我爱你", ["$KEEP", "$DELETE", "$KEEP", "$KEEP", "$KEEP"]),
        ("天气好", "天气非常好", ["$KEEP", "$KEEP", "$APPEND_非", "$KEEP"]),
        ("跑步快", "走路很快", ["$KEEP", "$REPLACE_走", "$REPLACE_路", "$KEEP"]),
        ("甲乙丙", "丁丙", ["$KEEP", "$DELETE", "$REPLACE_丁", "$KEEP"]),
        ("很高兴", "高兴很", ["$KEEP", "$DELETE", "$KEEP", "$APPEND_很"]),
        ("abc", "Abc", ["$KEEP", "$REPLACE_A", "$KEEP", "$KEEP"]),
        ("ABC", "aBC", ["$KEEP", "$TRANSFORM_CASE_LOWER", "$KEEP", "$KEEP"]),
        ("", "", ["$KEEP"]),
    ],
)
def test_labels(source, target, want):
    assert [x[0] for x in align.label_lists(list(source), list(target))] == want


@settings(max_examples=150, deadline=None)
@given(st.text("甲乙丙丁戊", max_size=12), st.text("甲乙丙丁戊", max_size=12))
def test_labels_round_trip(source, target):
    assert "".join(align.apply_levels(list(source), align.label_lists(list(source), list(target)))) == target


def test_legacy_and_spans():
    assert align.character_labels("我我爱你", "我爱你") == ["$KEEP", "$DELETE", "$KEEP", "$KEEP"]
    assert align.apply_spans(["a", "b", "c"], [(0, 1, ""), (1, 1, "$APPEND_x"), (2, 3, "$REPLACE_y")]) == ["x", "b", "y"]
    assert align.merged(["a", "$MERGE_SPACE", "b"]) == ["ab"] and align.merged(["a", "$MERGE_SWAP", "b"]) == ["b", "a"]


def test_edit_keys_poison():
    assert align.edit_keys("甲乙", "甲丙丁") == ([], [])
    assert align.edit_keys("甲乙", "甲丙") == ([1], [(1, "丙")])


def test_scores(spark):
    rows = spark.createDataFrame([(1, "甲乙", "甲丙", "甲丙"), (2, "甲乙", "甲乙", "甲丁"), (3, "一二", "一三", "一四"), (4, "五", "五", "五")], "id int, source string, target string, pred string")
    s = metrics.sentence_scores(rows).first()
    assert (s.pred_num, s.ref_num, s.hit_num) == (3, 2, 1) and s.f1 == 0.4
    c = metrics.character_scores(rows, "id").first()
    assert (c.ref, c.pred, c.detect, c.correct) == (2, 3, 2, 1)
    assert {r.type for r in metrics.character_errors(rows, "id").collect()} == {"false alarm", "wrong fix"}
    t = metrics.token_scores(rows).first()
    assert (t.detect_hit, t.correct_hit) == (2, 1)
    empty = rows.limit(0)
    assert metrics.sentence_scores(empty).first().f1 == 0 and metrics.final_scores(empty).first().final_f1 == 0


def test_templates(spark):
    assert templates.fixed_span("仅仅仅为", "仅仅", "为", "1") == "为"
    assert templates.fixed_span("约三左右", "约", "左右", "2") == "约三" and templates.fixed_span("约三左右", "约", "左右", "3") == "三左右"
    assert templates.fixed_span("ab", "a", "b", "1 x") == "xb"
    t = spark.createDataFrame([("约", "左右", "2"), ("约", "左右", "2"), ("大概", "上下", "3"), (None, "a", "1")], "left_text string, right_text string, action_code string")
    assert templates.patterns_of(t).count() == 3
    rows = spark.createDataFrame([(1, "约三天左右"), (2, "约三天，左右"), (3, None), (4, "")], "id long, text string")
    got = {r.id: (r.corrected, r.fixes) for r in templates.correct(rows, "id", "text", t).collect()}
    assert got == {1: ("约三天", 1), 2: ("约三天，左右", 0), 3: (None, 0), 4: ("", 0)}
    tie = spark.createDataFrame([("开始", "着手", "1"), ("着手", "开始", "3")], t.schema)
    assert templates.correct(spark.createDataFrame([(1, "开始着手工作")], "id long, text string"), "id", "text", tie).first().corrected == "开始工作"
    assert templates.fix_counts(templates.correct(rows, "id", "text", t)).first() == (1, 1)


@pytest.mark.parametrize("keep, sizes", [(False, [3, 3, 3]), (True, [3, 3, 4])])
def test_shards(spark, keep, sizes):
    got = datasets.shards(spark.range(10), ["id"], 3, keep).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in got] == sizes


def test_dev_split(spark):
    got = datasets.dev_split(spark.range(1000), "id", 0.013, "s")
    assert got.where("is_dev").count() == 13 and got.count() == 1000


def test_dictionaries(spark):
    groups = spark.createDataFrame([(1, ["甲", "乙"]), (2, ["甲", "丙丁"])], "gid long, words array<string>")
    words = spark.createDataFrame([("甲",), ("乙",), ("戊",), (None,)], "w string")
    got = {r.word: r.candidates for r in D.candidates(words, "w", groups, same_length=True).collect()}
    assert got == {"甲": ["甲"], "乙": ["乙", "甲"] if "乙" < "甲" else ["甲", "乙"], "戊": None}
    table = spark.createDataFrame([("zhang", ["张"]), ("zang", ["脏"]), ("shi", ["是"])], "key string, tokens array<string>")
    assert {r.key: r.tokens for r in D.merge_fuzzy(table).collect()} == {"zhang": ["脏", "张"], "zang": ["脏", "张"], "shi": ["是"]}
    labels = spark.createDataFrame([("a",), ("a",), ("b",)], "l string")
    assert {r.label for r in D.label_vocabulary(labels, "l", 1).collect()} == {"a", "@@UNKNOWN@@", "@@PADDING@@"}


def test_augment(spark):
    sets = augment.Sets(shape={"天": ["夫", "田"]}, char_sound={"天": ["田", "夫"]})
    rows = spark.createDataFrame([(1, "今天的天气非常非常好啊"), (2, "短"), (3, None)], "id long, text string")
    first = [tuple(r) for r in augment.augment(rows, "id", "text", sets, augment.CSC).orderBy("id").collect()]
    again = [tuple(r) for r in augment.augment(rows.repartition(3), "id", "text", sets, augment.CSC).orderBy("id").collect()]
    assert first == again and len(first) == 1 and len(first[0][1]) == len(first[0][2])


def test_augment_shares():
    import collections
    import random

    sets = augment.Sets()
    n = collections.Counter(augment._pick(random.Random(i), augment.EDITS) for i in range(4000))
    assert abs(n["replace"] / 4000 - 0.7) < 0.03 and abs(n["move"] / 4000 - 0.05) < 0.015
    assert augment.edit_chunk(random.Random(1), list("abc"), sets, False, augment.GEC) == list("abc")


def test_tagging(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],)], "x array<double>")
    r = df.select(tagging.top_labels(tagging.softmax(F.col("x")), 2).alias("t"), tagging.argmax(F.col("x")).alias("a")).first()
    assert [t.label for t in r.t] == [1, 2] and r.a == 1
    rows = spark.createDataFrame([(1, "A"), (2, "C"), (3, None)], "id long, text string")
    swap = lambda texts: [{"A": "B", "B": "A"}.get(t, t) for t in texts]
    got = {r.id: (r.corrected, r.n_rounds) for r in tagging.correct_until_stable(rows, "id", "text", swap, 3).collect()}
    assert got == {1: ("A", 2), 2: ("C", 0), 3: (None, 0)}


def test_conversion():
    c = conversion.Converter({"乾": "干", "乾坤": "乾坤", "頭": "头"})
    assert c.convert("乾坤大頭乾") == "乾坤大头干" and c.convert("") == ""


def test_similarity(spark):
    assert similarity.to_tree("⿱⿰甲乙丙") == "{⿱{⿰{甲}{乙}}{丙}}"
    with pytest.raises(ValueError):
        similarity.to_tree("⿱甲")
    assert similarity.canonical_distance("abc", "axc") == 2
    df = spark.createDataFrame([(["ab", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert df.select(similarity.best_similarity(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_segment():
    v = frozenset(["un", "##aff", "##able"])
    assert segment.word_pieces("unaffable", v) == ["un", "##aff", "##able"] and segment.word_pieces("x", v) == ["[UNK]"]
    assert segment.basic_tokens("Héllo,世界\t!") == ["hello", ",", "世", "界", "!"]
    assert segment.max_match("北京大学生", frozenset(["北京", "大学", "大学生"])) == ["北京", "大学生"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("错\t对\n\n误\t正\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "a.txt")).collect()] == [("错", "对"), ("误", "正")]
    (tmp_path / "p.json").write_text('[{"id": 1, "source": "a", "target": "b", "type": "negative"}]', encoding="utf-8")
    assert files.read_pairs(spark, str(tmp_path / "p.json")).first() == ("a", "b")
    (tmp_path / "t").write_text("约\n左右\n2\n\n大概\n上下\n3\n", encoding="utf-8")
    assert files.read_templates(spark, str(tmp_path / "t")).count() == 2
    (tmp_path / "v").write_text("a\nb\na\n", encoding="utf-8")
    assert {r.token: r.id for r in files.read_vocabulary(spark, str(tmp_path / "v")).collect()} == {"a": 2, "b": 1}
    assert files.read_lines(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "s").write_text("x \n\ny\n", encoding="utf-8")
    (tmp_path / "g").write_text("1\n2\n3\n", encoding="utf-8")
    assert [(r.source, r.target) for r in files.read_parallel(spark, str(tmp_path / "s"), str(tmp_path / "g")).orderBy("line").collect()] == [("x", "1"), ("y", "3")]
    lines = spark.createDataFrame([("p1, 3, 别字, 甲, 乙,",), ("p2, -1",), ("p3, 1, 2",)], "value string")
    assert {r.pid: len(r.errors) for r in files.parse_solutions(lines).collect()} == {"p1": 1, "p2": 0, "p3": 0}
    gold = spark.createDataFrame([(1, ["a", "b", "c"], [(0, 1, ["x", "y"]), (2, 3, [])])], "id long, tokens array<string>, edits array<struct<s:int,e:int,words:array<string>>>")
    assert files.gold_to_texts(gold).first().target == "xyb"
    rows = spark.createDataFrame([(2, "乙"), (1, "甲")], "id long, inference string")
    files.write_json_array(rows, str(tmp_path / "out.json"), ["id"])
    assert [r.id for r in spark.read.option("multiLine", True).json(str(tmp_path / "out.json")).collect()] == [1, 2]


def test_stream(spark, tmp_path):
    from mojiforge.streaming import pipelines

    spark.createDataFrame([("一二三四五六七八九十。",)], "content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("content string").parquet(str(tmp_path / "in"))
    q = pipelines.clean_stream(stream, "content").writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sentence from cleaned").first().sentence == "一二三四五六七八九十。"


def test_entry_without_training_operators():
    import __spark_entry__ as e

    assert "eval_scores" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_levels_of_all_pairs(spark, tmp_path):
    rows = [
        (1, "我爱Apple。", "我爱apple。", "我爱apple。"), (2, "用wifi上网", "用WIFI上网", "用WIFI上网"), (3, "他 们好", "他们好", "他们好"), (4, "他们好", "他 们好", "他 们好"),
        (5, "a-b c", "ab c", "ab c"), (6, "甲乙", "甲x y乙", "甲xy乙"), (7, "我爱你", "我爱她", "我爱她"), (8, "", "甲", None), (9, None, "甲", None),
    ]
    df = spark.createDataFrame([(i, a, b, None, "x", i) for i, a, b, _ in rows], "id long, source string, target string, type string, dataset string, loaded_at long")
    df.write.parquet(str(tmp_path / "json_data.parquet"))
    got = {r.id: r.made for r in catalogue.QUERIES["apply_levels_all"](spark, str(tmp_path)).collect()}
    assert got == {i: made for i, _, _, made in rows if made}


def test_character_ids(spark):
    v = spark.createDataFrame([("甲", 10), ("乙", 11)], "token string, id int")
    texts = {1: "甲" * 40 + "乙", 2: "乙" * 33, 3: None, 4: "", 5: "甲?\n乙"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    ids = lambda t: [2, *({"甲": 10, "乙": 11}.get(c, 1) for c in t or ""), 3]
    for max_len, widths in ((None, {1: 43, 2: 43, 3: 2, 4: 2, 5: 6}), (6, dict.fromkeys(texts, 6))):
        got = {r.id: (r.input_ids, r.attention_mask) for r in segment.character_ids(df, "id", "text", v, max_len).collect()}
        want = {i: ids((t or "")[: widths[i] - 2]) for i, t in texts.items()}
        assert got == {i: (x + [0] * (widths[i] - len(x)), [1] * len(x) + [0] * (widths[i] - len(x))) for i, x in want.items()}


def test_leakage_between_splits(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randrange(1, 12))), rng.choice(["train", "val", "test", None])) for i in range(0, 4000, 50)]
    rows += [(4000, None, "val"), (4001, None, "train"), rows[0], (None, "甲", "train")]
    spark.createDataFrame(rows, "id long, source string, split_name string").write.parquet(str(tmp_path / "json_data.parquet"))
    ratio = lambda a, b: round(2 * (Counter(a) & Counter(b)).total() / len(a + b), 6)
    known = {x for x in rows if x[0] is not None and x[1] is not None}
    want = sorted((-ratio(a[1], b[1]), a[0], b[0]) for a in known for b in known if a[2] in ("val", "test") and a[0] % 100 == 0 and b[2] == "train")[:10]
    assert [(-r.ratio, r.a_id, r.b_id) for r in catalogue.QUERIES["leakage_top10"](spark, str(tmp_path)).collect()] == want
