import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mojiforge.llm import chunking, neardup, quality, sentences, textforms
from mojiforge.llm.canonical import Trie
from mojiforge.llm.quality_training import label


@pytest.mark.parametrize(
    "text, want",
    [("уíｎ 而", "yín 而"), ("ΒΟΜ", "BOM"), ("⻓⽤ＫＰＢ　a​b", "长用KPB ab"), ("é é", "é é"), ("ｶﾞ｡", "ガ。"), ("½ ² ①", "½ ² ①"), (" a \r\nb ", "a\nb"), ("館馆", "館馆"), (None, None), ("", ""), (" ​", "")],
)
def test_displayed(text, want):
    assert textforms.displayed(text) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_compact_many(texts):
    assert textforms.compact_many(texts) == [textforms.unpoints(textforms.compact(t)) for t in texts]


def test_trie():
    t = Trie()
    for w, n in (("BOM", 5), ("привет", 3), ("yín", 2)):
        t.add(w, n)
    assert t.match("ΒΟΜ") == [(0, -5, "BOM")] and t.match("пpивeт")[0][2] == "привет" and t.match("уі́n")[0][2] == "yín"
    assert t.match("BAM") == [] and t.match("BAM", 1) == [(1, -5, "BOM")] and t.match("") == []


def split(text):
    out, last = [], 0
    for e in sentences.sentence_ends(text):
        out.append(text[last:e].strip())
        last = e
    return out


@pytest.mark.parametrize(
    "want",
    [
        ["“前天夜里！”店主说。", "据 Dr. Crèmola 介绍，编号为 No.71。", "主持人提醒大家：“甲好？乙好。”", "小组长走了。"],
        ["园丁认为「小学的。」这种说法传开了。", "《雨季？》这篇文章提到（住在镇。）很好！！！", "下一句？！", "好……", "结束。🎉"],
        ["“Is the pantry still there?” asked the keeper.", "At 7:36 p.m. the shop was moved, e.g. to Nim!", "Dr. Bla cleaned 2.2 kg (see fig. 4.) and has it.", "No. 36 was cleaned… ".strip(), "Mrs. Y came."],
        ["Nach ca. 42,7 km hat Dr. Dus den Weg, z. B. über Ki, repariert.", "„Wo liegt Fähre?“, fragte man.", "Am 9. Mai wurde es bemalt.", "Hat Fe bzw. Pr den Preis von 1.491 Euro verkauft?"],
        ["マワさんは「古い？」と聞いて、見た。", "なぜ？", "珍しい！"],
        ["डॉ. बिबि का रसोई 23.5 किलो का है।", "क्या है?"],
    ],
)
def test_sentences(want):
    joint = "" if "。" in want[0] else " "
    assert split(joint.join(want)) == want


def test_sentence_lines():
    assert split("第5期\n\n 甲乙 \r\n丙；丁：戊") == ["第5期", "甲乙", "丙；丁：戊"]
    assert sentences.sentence_ends(None) == sentences.sentence_ends("") == sentences.sentence_ends(" \n ") == []
    assert split("版本v1.2.3发布了。编号为 No.82.在公园") == ["版本v1.2.3发布了。", "编号为 No.82.", "在公园"]
    assert split("“未闭合。第二句。第三句") == ["“未闭合。", "第二句。", "第三句"]
    assert sentences.sentence_ends("甲。​") == [3]


def test_fullwidth_abbreviation():
    assert split("Ｋｌａ Ｓｔ． ｉｓ ２．３ ｍｉｌｅｓ． Ｔｈｅ ｅｎｄ．") == ["Ｋｌａ Ｓｔ． ｉｓ ２．３ ｍｉｌｅｓ．", "Ｔｈｅ ｅｎｄ．"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), min_size=1, max_size=12), st.integers(0, 3))
def test_pieces(sizes, seed):
    rng = random.Random(seed)
    text = "".join("字" * n + rng.choice(["。", "\n", "！\n\n"]) for n in sizes)
    ends = sentences.sentence_ends(text)
    cuts, forced = chunking.cut_positions(text, ends)
    last, made = 0, ""
    for k, e in enumerate(cuts):
        start = last - 64 if k else 0
        assert 0 < e - start <= 512 and e > last
        made += text[last:e]
        last = e
    assert made == text
    assert forced == sum(c not in ends for c in cuts[:-1])
    if chunking.longest_stretch(text, ends) > 512:
        assert forced


def test_short_item_is_one_piece():
    assert chunking.cut_positions("甲" * 512, []) == ([512], 0)


def test_signatures_estimate():
    rng = random.Random(1)
    a = "".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(400))
    b = a[:200] + "错" + a[201:]
    g = [neardup.gram_hashes(textforms.points(x)) for x in (a, b)]
    s = neardup.signatures(g)
    assert (s[0] == s[1]).mean() > 0.85
    keys, _ = neardup.variants(s)
    assert len(set(keys[0]) & set(keys[1])) > 20 and keys.shape == (2, 48)
    assert len(neardup.gram_hashes(textforms.points("甲"))) == 1


def test_rules():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((900, 3))
    y = (x[:, 0] > 0.7) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality.induce(x, y)
    said = np.zeros(len(y), bool)
    for r in rules:
        said |= quality._covers(r, x)
    assert (said == y).mean() > 0.97
    assert quality.induce(x, np.zeros(900, bool)) == []
    assert quality.verdict_sql([[["a", ">", 1.5], ["b", "<=", 2.0]]]) == "CASE WHEN q IS NULL THEN NULL WHEN q.a > 1.5 AND q.b <= 2.0 THEN true ELSE false END"


def test_labels():
    assert label("今天天气很好，我们去了公园。") is False
    assert label("1. 苹果\n2. 香蕉\n3. 梨子") is True and label("a\tb\tc\n1\t2\t3") is True
    assert label(" ") is None and label(None) is None


def test_many_unlikely_ends_in_a_sentence():
    for text in ("Ha!" + " ha!" * 12 + " he laughed.", "他读过" + "《花盆！》" * 12 + "。"):
        assert sentences.sentence_ends(text) == [len(text)]
