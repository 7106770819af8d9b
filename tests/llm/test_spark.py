import itertools
import random

import pytest
from pyspark.sql import functions as F

from mojiforge.llm import canonical, chunking, mixing, neardup, overlap, quality, sentences, tokens, truncation

BASE = "今天早上园丁把新鲜的苗圃花盆送到了河边的图书馆，几位老人都很开心，孩子们也跑来帮忙整理书架和桌椅"


def grams(t, n=5):
    t = "".join(t.split())
    return {t[i : i + n] for i in range(max(1, len(t) - n + 1))}


def test_near_duplicates(spark):
    rng = random.Random(5)
    texts = {1: BASE, 2: BASE + "。", 3: BASE.replace("老人", "工人"), 4: " " + BASE, 5: None, 6: "", 7: " \n", 8: "短", 9: "短", 10: "甲乙丙丁" * 3000, 11: "甲乙丙丁" * 3000 + "戊", 12: "完全不同的一段文字，没有任何相同的地方，写于秋天"}
    for i in range(20, 60):
        t = list(BASE)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(len(t))] = rng.choice("甲乙丙丁戊己庚辛")
        texts[i] = "".join(t)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(1, BASE, "x")], "id long, rep string, sig string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df.withColumnRenamed("rep", "text"), "id", "text").collect()}
    shown = {i: "".join(t.split()) for i, t in texts.items() if t and t.strip()}
    want = set()
    for a, b in itertools.combinations(sorted(shown), 2):
        x, y = grams(shown[a]), grams(shown[b])
        if len(x & y) / len(x | y) >= 0.6:
            want.add((a, b))
    assert got == want
    assert neardup.near_duplicate_pairs(df.limit(0), "id", "sig").count() == 0


def test_same_look(spark):
    rows = [("f", 1, "ＡＢＣ。"), ("f", 2, "ABC｡"), ("f", 3, "ABC。"), ("f", 3, "ABC。"), ("f", 4, None), ("f", 5, " "), ("g", 6, "ABC。"), ("f", 7, "АВС。"), ("f", 8, "abc。"), ("f", 9, "пpивeт"), ("f", 10, "привет"), ("f", 11, "привет")]
    df = spark.createDataFrame(rows, "field string, id long, text string")
    forms = canonical.canonical_forms(df)
    got = {tuple(r) for r in canonical.same_look_pairs(forms).collect()}
    assert got == {("f", 1, 2), ("f", 1, 3), ("f", 2, 3), ("f", 1, 7), ("f", 2, 7), ("f", 3, 7), ("f", 9, 10), ("f", 9, 11)}
    assert canonical.canonical_forms(df.limit(0)).count() == 0


def test_spelling_from_vocabulary(spark):
    df = spark.createDataFrame([("пpивeт",), ("привет",), ("привет",), ("ΒΟΜ",), ("BOM",)], "text string")
    got = {r.word: r.canonical for r in canonical.spellings(df, "text").collect()}
    assert got["пpивeт"] == "привет" and "ΒΟΜ" not in got


PLANTED = [
    ("老站长在エ厂门口等人", "老站长在工厂门口等人"), ("人ロ比去年多了", "人口比去年多了"), ("第ニ天努カ工作", "第二天努力工作"), ("ｃａｆé", "café"), ("cafe\u0301", "café"), ("a\u00a0b", "a b"), ("a\u3000b\u200b", "a b"), ("Ⅻ", "XII"), ("ﬁne", "fine"),
    ("﹐甲﹣", ",甲-"), ("\U0001d5a0x", "Ax"), ("⼯人", "工人"), ("ѵine", "vine"), ("ガラス", "ｶﾞﾗｽ"), ("エンジン", "工ンジン"), ("ราคา\u0e4d\u0e32", "ราคา\u0e33"),
]
DIFFERENT = [("ABC", "abc"), ("第1", "第①"), ("第1", "第¹"), ("图书馆", "圖書館"), ("甲乙", "甲 乙"), ("甲\n乙", "甲乙"), ("エビ", "工人"), ("好!", "好。")]


@pytest.mark.parametrize("limit", [1000, 0])
def test_planted_looks(spark, limit):
    texts = [t for pair in PLANTED + DIFFERENT for t in pair]
    # What stands beside them elsewhere tells which one is meant.
    texts += ["他在工厂门口", "在工厂门口", "本市人口比去年", "第二天", "努力工作", "エンジン"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)] + [("f", 0, texts[0]), ("f", 900, None), ("f", 901, " ")], "field string, id long, text string")
    got = {tuple(r)[1:] for r in canonical.same_look_pairs(canonical.canonical_forms(df, limit)).collect()}
    assert got >= {(2 * i, 2 * i + 1) for i in range(len(PLANTED))}
    apart = 2 * len(PLANTED)
    assert not {(apart + 2 * i, apart + 2 * i + 1) for i in range(len(DIFFERENT))} & got


def test_kana_pairs_need_the_trie(spark, monkeypatch):
    df = spark.createDataFrame([("f", 1, "老站长在エ厂门口等人"), ("f", 2, "老站长在工厂门口等人")], "field string, id long, text string")
    assert canonical.same_look_pairs(canonical.canonical_forms(df)).count() == 1
    by = {r.word: r.canonical for r in canonical.spellings(df, "text").collect()}
    assert len(by) == 1 and {*by, *by.values()} == {"在エ厂", "在工厂"}
    none = spark.createDataFrame([], "word string, canonical string")
    monkeypatch.setattr(canonical, "spellings", lambda *_: none)
    assert canonical.same_look_pairs(canonical.canonical_forms(df)).count() == 0


def test_cross_split(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("园木花书河城山灯石风雨竹布铁糖米茶酒车船桥路门窗桌椅杯盘笔纸") for _ in range(3))
    clause = [lambda: f"{word()}把{word()}送到了{word()}公园", lambda: f"{word()}里的{word()}比{word()}多了", lambda: f"在{word()}车站，{word()}和{word()}出现"]
    rows = []
    for i in range(150):
        rows.append((i, 0, 0, "，".join(rng.choice(clause)() for _ in range(4)) + "。"))
    for i in range(40):
        t = list(rows[rng.randrange(150)][3])
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = rng.choice("错别字里外")
        rows.append((1000 + i, 1, 0, "".join(t)))
    rows += [(2000, 1, 0, None), (2001, 1, 0, ""), (2002, 0, 0, "短句"), (2003, 1, 0, "短句"), (2004, 1, 1, rows[0][3]), (2005, None, 0, rows[0][3]), (0, 0, 0, rows[0][3])]
    df = spark.createDataFrame(rows, "id long, side int, field int, text string")
    got = {tuple(r) for r in overlap.cross_split_pairs(df).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == 1 and b[1] == 0 and a[2] == b[2] and a[3] and b[3]:
                x, y = overlap.pair_counts(a[3]), overlap.pair_counts(b[3])
                if a[3] == b[3] or overlap.dice(x, y) >= 0.6:
                    want.add((a[0], b[0]))
    assert got <= want and (2003, 2002) in got
    assert len(got) >= 0.97 * len(want), (len(got), len(want))
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def test_cross_split_hot_text(spark):
    rng = random.Random(3)
    signs = [chr(0x4E00 + i) for i in range(300)]
    rows = [(i, 0, 0, "".join(rng.choice(signs) for _ in range(40))) for i in range(300)]
    hot, tail = "园丁把花盆送到了河边图书馆", "木匠在车站检查了雨伞"
    rows += [(1000 + i, 0, 0, hot) for i in range(200)]
    rows += [(2000 + i, 0, 0, "".join(rng.choice(signs) for _ in range(6)) + tail) for i in range(40)]
    evals = [(5000, 1, 0, hot), (5001, 1, 0, hot.replace("河", "湖")), (5002, 1, 0, rows[500][3]), (5003, 1, 0, "错别" + rows[501][3][2:]), (5004, 1, 1, hot)]
    df = spark.createDataFrame(rows + evals, "id long, side int, field int, text string")
    got = {tuple(r) for r in overlap.cross_split_pairs(df).collect()}
    want = set()
    for a in evals:
        for b in rows:
            if a[2] == b[2] and overlap.dice(overlap.pair_counts(a[3]), overlap.pair_counts(b[3])) >= 0.6:
                want.add((a[0], b[0]))
    assert got == want


def test_cross_split_without_whole_segment(spark):
    rng = random.Random(3)
    signs = [chr(0x4E00 + i) for i in range(300)]
    rows = [(i, 0, 0, "".join(rng.choice(signs) for _ in range(40))) for i in range(300)]
    rows += [(1000, 0, 0, "哈" * 30), (2000, 1, 0, "哈" * 29 + "呵"), (2001, 1, 0, "哈" * 25), (2002, 1, 0, "哈" * 20 + "呵" * 40)]
    df = spark.createDataFrame(rows, "id long, side int, field int, text string")
    assert {tuple(r) for r in overlap.cross_split_pairs(df).collect()} == {(2000, 1000), (2001, 1000)}


def test_tokens(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", None, "  a\n\n b  ", "don't <|endoftext|> I'LL", "中文，和 English 2024！", "🎉\r\n\t", "字" * 5000, "a", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "ids long, text string")
    enc = tokens.encode_texts(df, "ids", "text")
    got = {r.id: r.ids for r in enc.collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert {r.id: r.ids for r in tokens.encode_by_word_table(df, "ids", "text").collect()} == got
    assert tokens.encode_by_word_table(df.unionByName(df), "ids", "text").count() == 2 * len(texts)
    assert {r.id: r.text for r in tokens.decode_ids(enc).collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert {r.ids: r.n_tokens for r in tokens.count_tokens(df, ["ids"], "text").collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode_texts(df.limit(0), "ids", "text").count() == 0


def test_table_limit():
    from array import array

    t = tokens.WordTable(tokens.read_ranks(open(tokens.vocabulary_path(), "rb").read()), limit=2)
    a, b = array("i"), array("i")
    t.encode("a b c a b c", a)
    tokens.WordTable(tokens.read_ranks(open(tokens.vocabulary_path(), "rb").read())).encode("a b c a b c", b)
    assert a == b


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, "big" if i % 3 else "small", rng.choice(["zh", "en", None]), rng.choice(["t1", "t2", None]), rng.randrange(0, 400) if i % 7 else 0) for i in range(3000)]
    docs += [(9001, None, "zh", "t1", 50), (9002, "other", "zh", "t1", 50)]
    d = spark.createDataFrame(docs, "doc_id long, source string, lang string, topic string, n_tokens long")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(d, t)
    report = {r.source: r for r in mixing.mix_report(mix, t).collect()}
    total = sum(x[4] for x in docs if x[1] in ("big", "small"))
    assert report["none"].tokens == 0 and report["small"].most_repeats <= 4 and report["big"].most_repeats == 1
    share = 0.5 / 0.9
    assert abs(report["big"].tokens - share * total) < 0.01 * total and abs(report["small"].tokens - (1 - share) * total) < 0.01 * total
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert mixing.mix_sources(d.limit(0), t).count() == 0


def test_capped_source_falls_short(spark):
    d = spark.createDataFrame([(1, "a", "zh", "t", 10), (2, "b", "zh", "t", 1000)], "doc_id long, source string, lang string, topic string, n_tokens long")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r.repeats for r in mixing.mix_sources(d, t).collect()}
    assert got.get("a") == 3


WORDS = [("zh", "了"), ("zh", "把"), ("zh", "在"), ("zh", "的"), ("en", "the"), ("en", "was")]


def test_quality(spark):
    rows = [(1, "今天园丁把花盆送到了公园，老人们都说了很多话。孩子们在河边唱起了歌。" * 3), (2, "- 苹果\n- 香蕉\n- 梨子\n- 桃子"), (3, "甲\t乙\t12\n丙\t丁\t34\n戊\t己\t56"), (4, None), (5, ""), (6, "  \n"), (7, "天地玄黄宇宙" * 60), (8, "the shop was closed and the keeper was gone. " * 5)]
    df = spark.createDataFrame(rows, "id long, q string").withColumnRenamed("q", "text")
    got = {r.id: r.no_prose for r in quality.not_prose(df, "text", WORDS).collect()}
    assert got == {1: False, 2: True, 3: True, 4: None, 5: None, 6: None, 7: True, 8: False}
    assert quality.not_prose(df.limit(0), "text", WORDS).count() == 0


def test_repeated_line_is_no_clause(spark):
    unit = "今天早上园丁把新鲜的苗圃花盆送到了河边图书馆，几位老人都很开心"
    prose = "木匠在车站检查了雨伞，会计修好书架。"
    df = spark.createDataFrame([(1, unit * 4 + "。"), (2, unit * 4 + "\n" + prose), (3, prose)], "id long, text string")
    got = {r.id: (r.q.clause_share, r.q.variety) for r in quality.statistics(df, "text", WORDS).collect()}
    assert got[1][0] == 0 and got[1][1] > 0.66 and got[3][0] == 1
    assert abs(got[2][0] - len(prose) / (4 * len(unit) + len(prose))) < 1e-9


def test_too_many_words():
    with pytest.raises(ValueError):
        quality.word_patterns([("zh", str(i)) for i in range(quality.MAX_WORDS + 1)])


def test_sentences_and_pieces_frames(spark):
    df = spark.createDataFrame([(1, "甲。乙"), (2, None), (3, ""), (1, "甲。乙"), (4, "字" * 600 + "。\n" + "句子很短。" * 200)], "ends long, text string")
    got = sorted((r.id, list(r.ends)) for r in sentences.split_sentences(df, "ends", "text").collect())
    assert got[:2] == [(1, [2, 3]), (1, [2, 3])] and got[2:4] == [(2, []), (3, [])]
    cut = chunking.cut_items(df, "ends", "text").collect()
    assert [r.id for r in cut] == [4] and cut[0].longest == 601 and cut[0].forced > 0
    pieces = chunking.pieces_of(df, "ends", "text").orderBy("piece_no").collect()
    text = "字" * 600 + "。\n" + "句子很短。" * 200
    assert all(p.piece == text[p.start_pos : p.end_pos] and len(p.piece) <= 512 for p in pieces)
    assert all(b.start_pos == a.end_pos - 64 for a, b in zip(pieces, pieces[1:])) and pieces[-1].end_pos == len(text)


def test_cut_off(spark):
    rng = random.Random(4)
    who, what = ["园丁", "木匠", "编辑", "会计"], ["新鲜的苹果", "陈旧的书架", "漂亮的花盆", "便宜的雨伞"]
    full = lambda: "".join(f"{rng.choice(who)}把{rng.choice(what)}送到了公园。{rng.choice(who)}检查了{rng.choice(what)}。" for _ in range(4))
    rows = [(i, "s", full()) for i in range(300)]
    rows += [(400 + i, "s", "\n".join(f"- {x}" for x in rng.sample(["苹果", "书架", "花盆", "雨伞"], 3))) for i in range(100)]
    cut = {1001: full() + "木匠把陈旧的书", 1002: full() + "编辑检查了漂�", 1003: full() + "会计检查了便宜的…展开", 1004: full() + "园丁检查了<br"}
    fine = {2001: full() + "\n【全文完】", 2002: full() + "\n【全文完】", 2003: full() + "\n【全文完】", 2004: "- 苹果\n- 书架\n- 花盆", 2005: None, 2006: "", 2007: " ", 2008: full() + "🎉"}
    rows += [(i, "s", t) for i, t in {**cut, **fine}.items()] + [(1001, "s", cut[1001])]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = [r.id for r in truncation.cut_off(df, "id", "source", "text", WORDS).collect()]
    assert sorted(got) == [1001, 1001, 1002, 1003, 1004]
    r = truncation.cut_report(df, "id", "source", truncation.cut_off(df, "id", "source", "text", WORDS)).first()
    assert r.cut_off == 5 and r.documents == len(rows)
    assert truncation.cut_off(df.where(F.lit(False)), "id", "source", "text", WORDS).count() == 0


def _cut_corpus(seed: int):
    rng = random.Random(seed)
    who, what = ["园丁", "木匠", "编辑", "会计"], ["新鲜的苹果", "陈旧的书架", "漂亮的花盆", "便宜的雨伞"]
    return rng, lambda: "".join(f"{rng.choice(who)}把{rng.choice(what)}送到了公园。{rng.choice(who)}检查了{rng.choice(what)}。" for _ in range(4))


@pytest.mark.parametrize("copies", [1, 2, 3, 6, 100])
def test_many_texts_with_one_cut_tail(spark, copies):
    _, full = _cut_corpus(copies)
    rows = [(i, "s", f"第{i}天。" + full()) for i in range(300)]
    rows += [(1000 + i, "s", f"第{i}天。" + full() + "\n木匠把陈旧的书") for i in range(copies)]
    rows += [(2000 + i, "s", f"第{i}天。" + full() + "\n【全文完】") for i in range(copies)]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    assert {r.id for r in truncation.cut_off(df, "id", "source", "text", WORDS).collect()} == {1000 + i for i in range(copies)}


def test_cut_word_of_a_spaced_script(spark):
    rng = random.Random(8)
    things = ["kettle", "compass", "lantern", "tapestry", "notebook"]
    line = lambda: f"The {rng.choice(things)} was near the {rng.choice(things)}"
    rows = [(i, "s", ". ".join(line() for _ in range(4)) + ".") for i in range(200)]
    # Lines without full stops: only the final token tells.
    rows += [(1000, "s", "\n".join([line(), line(), "The kettle was near the tapes"])), (1001, "s", "\n".join([line(), line(), "The kettle was near the tapestry"]))]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    assert {r.id for r in truncation.cut_off(df, "id", "source", "text", WORDS).collect()} == {1000}


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_cross_split_of_common_phrases(spark, partitions):
    """Phrases that a third of all texts hold, any number of buckets: what brute force finds."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rng = random.Random(12)
    signs = [chr(0x4E00 + i) for i in range(400)]
    some = lambda n: "".join(rng.choice(signs) for _ in range(n))
    head, tail = "本报记者从现场发来报道称", "以上内容由读者提供仅供参考"
    rows = [(i, 0, 0, (head if i % 3 == 0 else "") + some(50) + (tail if i % 3 == 1 else "")) for i in range(400)]
    rows += [(5000 + i, 1, 0, t[:20] + some(3) + t[23:] + ("。" if i % 2 else "")) for i, t in enumerate(r[3] for r in rows[:60])]
    try:
        df = spark.createDataFrame(rows, "id long, side int, field int, text string")
        got = {tuple(r) for r in overlap.cross_split_pairs(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    counts = {r[0]: overlap.pair_counts(r[3]) for r in rows}
    assert got == {(a[0], b[0]) for a in rows if a[1] for b in rows if not b[1] and overlap.dice(counts[a[0]], counts[b[0]]) >= 0.6}


def _brute_force(rows):
    held = [(i, side, field, "".join(t.split())) for i, side, field, t in rows if t]
    counts = [overlap.pair_counts(r[3]) for r in held]
    evals, trains = ([k for k, r in enumerate(held) if r[1] == side and r[3]] for side in (overlap.EVAL, overlap.TRAIN))
    like = lambda a, b: held[a][3] == held[b][3] or len(held[a][3]) > 1 and overlap.dice(counts[a], counts[b]) >= 0.6
    return {(held[a][0], held[b][0]) for a in evals for b in trains if held[a][2] == held[b][2] and like(a, b)}


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_cross_split_finds_every_pair(spark, monkeypatch, block):
    """Common phrases in another order, edits all over a text, lengths apart, few characters, repeated ones: what brute force finds."""
    monkeypatch.setattr(overlap, "BLOCK_CHARS", block)
    rng = random.Random(21)
    signs = [chr(0x4E00 + i) for i in range(300)]
    phrases = ["".join(rng.choice(signs) for _ in range(6)) for _ in range(40)]
    rows = [(i, 0, 0, "".join(rng.sample(phrases, 8))) for i in range(300)]
    rows += [(1000 + i, 0, 1, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 120)))) for i in range(200)]
    for i, r in enumerate(rows[:60]):
        parts = [r[3][k : k + 6] for k in range(0, 48, 6)]
        rng.shuffle(parts)
        rows.append((2000 + i, 1, 0, "".join(parts)))
    for i, r in enumerate(rows[300:500]):
        t = list(r[3])
        for k in range(rng.randrange(3), len(t), rng.randrange(4, 8)):
            t[k] = rng.choice(signs)
        rows.append((3000 + i, 1, 1, "".join(t[: rng.randrange(len(t) // 2, len(t)) + 1])))
    for k, t in enumerate(["甲", "乙", "甲乙", "甲乙丙", "甲甲", "甲甲甲甲", "甲" * 200, "甲" * 300, "甲乙" * 150, "甲乙" * 70, "甲 乙"]):
        rows += [(4000 + k, 0, 2, t), (5000 + k, 1, 2, t), (6000 + k, 0, 3, t)]
    df = spark.createDataFrame(rows, "id long, side int, field int, text string")
    got, want = {tuple(r) for r in overlap.cross_split_pairs(df).collect()}, _brute_force(rows)
    assert got == want and len(want) > 100, (len(got - want), len(want - got), len(want))


def test_cross_split_looks_rows_up_once_for_all_lengths(monkeypatch):
    """Texts of many lengths: look-ups for each class of training texts, not for each pair of classes; all pairs of brute force."""
    rng = random.Random(31)
    text = lambda n: "".join(chr(0x4E00 + rng.randrange(150)) for _ in range(n))
    evals = [text(n) for n in range(1, 200)]
    trains = sorted({text(n) for n in range(1, 200)} | {t[: len(t) * 2 // 3 + 1] + text(len(t) // 5) for t in evals})
    counts = {t: overlap.pair_counts(t) for t in evals + trains}
    want = {(a, b) for a in trains for b in evals if a == b or len(a) > 1 and overlap.dice(counts[a], counts[b]) >= 0.6}
    block, lookups = overlap.Block(evals, 0.6), []
    monkeypatch.setattr(overlap, "_parts", lambda sizes, most, f=overlap._parts: lookups.append(1) or f(sizes, most))
    got = {(trains[p], evals[q]) for p, q in block.meet(trains)}
    assert got == want and len(want) > 50
    classes = overlap._classes(overlap.np.array([max(len(t) - 1, 1) for t in trains]))
    assert len(lookups) < 2 * len(set(classes.tolist()))


def test_rows_of_repeated_pairs():
    """Every occurrence of a pair has a row of its own, the same in every text; sketches count their bits."""
    rank = overlap.np.arange(overlap.PAIR_SLOTS, dtype=overlap.np.int32)
    own, rows, sizes = overlap._rows(["甲甲甲甲", "甲", "甲乙甲乙甲", "乙甲乙", "甲甲"], rank)
    of = [rows[own == k].tolist() for k in range(5)]
    assert [len(set(r)) for r in of] == sizes.tolist() == [3, 1, 4, 2, 1]
    assert set(of[3]) < set(of[2]) and set(of[4]) < set(of[0]) and not set(of[1]) & set(of[0])
    words = overlap.np.array([[0] * 8, [2**64 - 1] * 8, [1, 2, 4, 8, 0, 0, 0, 2**63]], overlap.np.uint64)
    assert overlap._set_bits(words).tolist() == [0, 512, 5]
