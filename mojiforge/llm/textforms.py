"""The displayed form of a text: one spelling for texts that look the same.

Everything here works on whole texts with C-level primitives (``str.encode``,
numpy table look-ups, ``unicodedata``), so a batch costs a few nanoseconds a
character.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

# Letters of other scripts that are drawn like Latin ones.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ɑ": "a", "ɡ": "g", "Ꭺ": "A", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮮ": "L", "Ꮲ": "P", "Ꭲ": "T", "Ꮪ": "S", "µ": "μ",
    "к": "k", "ѵ": "v", "ρ": "p", "υ": "u", "ι": "i", "օ": "o", "ո": "n", "ս": "u", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
    "∶": ":", "։": ":", "‐": "-", "‑": "-", "−": "-", "⁄": "/", "∕": "/", "‒": "–", "―": "—", "ʼ": "’", "‛": "‘", "․": ".",
}
# Single signs that are drawn like several letters.
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅺ": "XI", "Ⅻ": "XII",
    "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix", "ⅺ": "xi", "ⅻ": "xii", "‥": "..", "ł": "l\u0335", "Ł": "L\u0335",
}
# Kana that are drawn like Han characters or like other kana.  Which one is meant depends on the characters beside it.
AMBIGUOUS = {"エ": "工", "カ": "力", "ニ": "二", "ロ": "口", "タ": "夕", "ト": "卜", "ハ": "八", "ノ": "丿", "ー": "一", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}
# CJK radical forms without a compatibility mapping, and the characters they look like.
RADICALS = {
    "⺀": "冫", "⺁": "厂", "⺄": "乙", "⺅": "亻", "⺆": "冂", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺌": "小", "⺍": "小", "⺎": "兀", "⺏": "尣", "⺒": "巳", "⺓": "幺", "⺔": "彑",
    "⺕": "彐", "⺖": "忄", "⺗": "心", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺥": "爫",
    "⺦": "丬", "⺧": "牛", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺵": "网", "⺶": "羊",
    "⺷": "羊", "⺸": "羊", "⺹": "耂", "⺺": "肀", "⺻": "聿", "⺼": "肉", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见",
    "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门",
    "⻕": "阜", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻞": "飠", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨",
    "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "齐", "⻬": "齐", "⻭": "齿", "⻮": "齿", "⻯": "龙", "⻰": "龙", "⻱": "龟", "⻲": "龟", "⻳": "龟",
}
# Characters without a picture that Unicode doesn't class as Cf.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
# The blocks of code points that hold all those with another displayed form.
CHANGING = ((0x0, 0x3400), (0xA640, 0xABF0), (0xF900, 0x10000), (0x11000, 0x11D00), (0x1BCA0, 0x1BCB0), (0x1D150, 0x1D250), (0x1D400, 0x1D800), (0x1E000, 0x1E960), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
DROP = 0xFFFFFFFF
MAX = 0x110000


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(by code point its displayed code point or DROP; whether it needs composition)."""
    to, odd = np.arange(MAX, dtype=np.uint32), np.zeros(MAX, bool)
    for c in chain(*(range(*r) for r in CHANGING)):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cn" or kind == "Cs" or kind == "Co":
            continue
        if kind == "Cf":
            to[c] = DROP
        elif kind == "Zs" or c == 9:
            to[c] = 32
        elif kind[0] == "M":
            odd[c] = unicodedata.combining(ch) != 0 or c == 0x0E4D
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<":
            # Precomposed letters whose base has a look-alike, singletons and compositions excluded from NFC.
            base = unicodedata.normalize("NFD", ch)
            odd[c] = unicodedata.normalize("NFC", ch) != ch or base[0] in LOOK_ALIKES
        elif d and d.split()[0] in ("<wide>", "<narrow>", "<small>", "<font>") and len(d.split()) == 2:
            to[c] = int(d.split()[1], 16)
        elif 0x2E80 <= c <= 0x2FD5 and d:
            to[c] = int(d.split()[-1], 16)
    for table in (LOOK_ALIKES, RADICALS):
        for a, b in table.items():
            to[ord(a)] = ord(b)
    for c in LIGATURES:
        odd[ord(c)] = True
    for c in INVISIBLE:
        to[c] = DROP
    odd[0xFF9E] = odd[0xFF9F] = True
    to[0xFF9E], to[0xFF9F] = 0x3099, 0x309A
    kept = to < MAX  # a table's target may have a target itself
    to[kept] = to[to[kept]]
    return to, odd


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def unpoints(a: np.ndarray) -> str:
    return a.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def fold(a: np.ndarray) -> np.ndarray:
    """Code points of the displayed form, without trimming."""
    to, odd = tables()
    if odd.take(a).any():
        s = unpoints(a)
        for c, many in LIGATURES.items():
            s = s.replace(c, many)
        b = to[points(unicodedata.normalize("NFD", s))]
        s = unicodedata.normalize("NFC", unpoints(b[b != DROP]))
        b = to[points(s.replace("ํา", "ำ"))]
    else:
        b = to.take(a)
    return b[b != DROP]


def displayed(text: str | None) -> str | None:
    """The text as it is displayed: same look, same string.

    Full and half width, kinds of space, white space at the ends of the text
    or before a line break, kinds of line end and invisible characters make no
    difference; letters of other scripts that look alike, ligatures and CJK radical
    forms become plain letters; accents are composed.  Null stays null; blank becomes
    empty.  Case, raised or circled digits, simplified and traditional
    characters, spaces inside and line breaks do differ.
    """
    if text is None:
        return None
    s = unpoints(fold(points(text)))
    if "\r" in s:
        s = s.replace("\r\n", "\n").replace("\r", "\n")
    if " \n" in s:
        s = "\n".join(x.rstrip(" ") for x in s.split("\n"))
    return s.strip()


@lru_cache(1)
def spaces() -> np.ndarray:
    """Whether a code point is white space."""
    a = np.zeros(MAX, bool)
    a[[c for c in range(sys.maxunicode + 1) if chr(c).isspace()]] = True
    return a


def compact(text: str | None) -> np.ndarray:
    """Code points of the displayed form without any white space."""
    if text is None:
        return np.zeros(0, np.uint32)
    b = fold(points(text))
    return b[~spaces().take(b)]


def compact_many(texts: list[str | None]) -> list[str]:
    """``compact`` of every text, as strings; all texts that need no composition at once."""
    kept = [i for i, t in enumerate(texts) if t]
    out = [""] * len(texts)
    if not kept:
        return out
    to, odd = tables()
    a = points("".join([texts[i] for i in kept]))
    lens = np.array([len(texts[i]) for i in kept], np.int64)
    stops = np.cumsum(lens)
    b = to.take(a)
    keep = b != DROP
    b[~keep] = 0
    keep &= ~spaces().take(b)
    size = np.concatenate([[0], np.cumsum(keep)])[stops]
    strange = np.add.reduceat(odd.take(a).astype(np.int32), stops - lens) > 0
    whole = unpoints(b[keep])
    last = 0
    for i, end, hard in zip(kept, size.tolist(), strange.tolist()):
        out[i] = unpoints(compact(texts[i])) if hard else whole[last:end]
        last = end
    return out
