"""Sentences of texts in any language and script, by semi-Markov dynamic programming.

Whole spans between possible ends are scored by how they close (marks,
abbreviations, numbers), how what follows opens (speaker, small letter, stray
mark), their quotations and brackets (none may be cut), and their length; the
best sequence of spans of each line wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiforge.llm.textforms import DROP, points, tables, unpoints

# Words that take a full stop inside a sentence, in lower case.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof rev hon sr jr st ave rd blvd mt co ltd inc corp llc bros no nos nr vol pp p ch sec art fig figs eq ed eds "
    "e.g i.e eg ie cf vs viz al approx est dept gov gen col capt lt sgt maj u.s u.k ph.d b.a m.a a.m p.m am pm "
    "jan feb mar apr jun jul aug sep sept oct nov dec ca bzw z b z.b d.h u.a usw o.ä evtl ggf inkl zzgl str hr fr frl "
    "abs abb bd ders geb gest jh mio mrd tel vgl zz डॉ श्री श्रीमती प्रो ม.ค พ.ศ ค.ศ".split()
)
# Months after an ordinal number in German.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez".split())
OPEN = {"“": "”", "‘": "’", "「": "」", "『": "』", "(": ")", "《": "》", "〈": "〉", "【": "】", "[": "]", "〔": "〕", "{": "}", "„": "“", "«": "»", "‚": "‘"}
CLOSE = frozenset(OPEN.values()) - {"“", "‘"}
SPEECH = frozenset("”」』\"“»")
EMOJI = re.compile("(?:[☀-➿⬀-⯿\U0001f000-\U0001faff][\ufe0f\u200d]*)+")
MARKS = "。.!?…।॥"
ENDING = re.compile(rf"[{MARKS}]+|(?<=[^{MARKS}”」』])[”」』]")
BRACKET = re.compile("[“”‘’「」『』()《》〈〉【】\\[\\]〔〕{}„«»‚\"]")
LINE = re.compile("[^\n\r\x0b\x0c\x85  ]+")
HAN = "㐀-鿿豈-﫿々\U00020000-\U0003ffff"
WORD_BEFORE = re.compile(r"[^\W\d_]+(?:[.][^\W\d_]+)*$|[\w़ाि-ौ्ंःँ]+$")
# A speaker named after a quotation: few characters, a verb of saying, and the end of the sentence.
SPEAKER = re.compile(r"\s*[^,，。.!?…;:“”「」『』]{0,14}?(?:说|道|问|答|喊|叫|笑|写|补充|解释|提醒(?:大家)?|表示|认为|指出|感叹|嘀咕|回应|介绍|と(?:言|聞|話|答)[^。]{0,12})\s*(?:[。.!?…]|$)")
SPEAKER_LATIN = re.compile(r"\s*(?:[A-Z][\w.]*\s+){1,4}(?:said|asked|replied|added|shouted|whispered|wrote|explained|answered|cried|warned)\b|\s*,")
FORBIDDEN = -100.0


def _matched(s: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Matched quotations and brackets of a line: (open, close) by close, and by close its open."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for m in BRACKET.finditer(s):
        c, at = m[0], m.start()
        if c == '"':
            if any(x == '"' for x, _ in stack):
                c_is_close, want = True, '"'
            else:
                stack.append((c, at))
                continue
        elif c in "“‘" and any(OPEN.get(x) == c for x, _ in stack):
            c_is_close, want = True, c
        elif c in OPEN:
            stack.append((c, at))
            continue
        else:
            c_is_close, want = True, c
        for k in range(len(stack) - 1, -1, -1):
            x, o = stack[k]
            if x == want == '"' or OPEN.get(x) == want:
                pairs.append((o, at))
                del stack[k:]
                break
    return pairs, {c: o for o, c in pairs}


def _stop_score(s: str, at: int, end: int) -> float:
    """How a run of marks that begins at ``at`` and holds only full stops of the Latin kind closes a sentence."""
    before, after = s[:at], s[end:]
    nxt = after[:1]
    if end - at > 1:
        return 2.0
    if nxt and (nxt.isdigit() and before[-1:].isdigit() or nxt.isascii() and (nxt.isalnum() or nxt in "_/@-")):
        return FORBIDDEN
    if nxt == ",":
        return FORBIDDEN
    if not before or before[-1].isspace():
        return -4.0
    rest = after.lstrip(" ")
    word = WORD_BEFORE.search(before[-24:])
    w = word[0].lower() if word else ""
    if w in ABBREVIATIONS or w.rpartition(".")[2] in ABBREVIATIONS and len(w) < 7:
        return -6.0 if rest else 2.0
    if len(w) == 1 and w.isalpha() and w.isascii() and rest:  # an initial
        return -5.0
    if before[-1].isdigit() and rest:
        head = re.match(r"[^\W\d_]+", rest)
        if head and head[0].lower() in MONTHS:
            return -6.0
        if re.fullmatch(r"\s*\(?\d{1,3}", before):  # the number of a list line
            return FORBIDDEN
    if rest[:1].islower():
        return -4.0
    return 2.0


def _ends_of_line(s: str) -> list[int]:
    """Ends of the sentences of one line (displayed form); the last is the line's."""
    n = len(s)
    matches = list(ENDING.finditer(s))
    if not matches:
        return [n]
    pairs, opened = _matched(s) if BRACKET.search(s) else ([], {})
    # (end, score, place of the quotation's opening that decides or None, whether a speaker follows)
    nodes: list[tuple[int, float, int | None, bool]] = []
    k, depth = 0, []
    opens = sorted(o for o, _ in pairs)
    closes = sorted(c for _, c in pairs)
    io = ic = 0
    for m in matches:
        at, end = m.span()
        first = end - at if s[at] in MARKS else 0
        quote = at if not first else None
        while first and end < n and (end in opened or s[end] in CLOSE and s[end] not in OPEN):
            quote = end if end in opened else quote
            end += 1
        if smile := EMOJI.match(s, end):
            end = smile.end()
        if end >= n:
            break
        while io < len(opens) and opens[io] < end:
            io += 1
        while ic < len(closes) and closes[ic] < end:
            ic += 1
        if io != ic:  # inside a quotation or bracket
            continue
        after = s[end:]
        nxt = after.lstrip(" ")[:1]
        o = opened.get(quote) if quote is not None else None
        told = o is not None and s[:o].rstrip()[-1:] == ":"  # the quotation has been introduced by a colon
        if first == 0:  # a quotation closed without a mark inside
            if told and s[quote] in SPEECH and nxt not in ",，、;。.!?…":
                nodes.append((end, 2.0, None, False))
            continue
        marks = s[at : at + first]
        score = 3.0
        if set(marks) == {"."}:
            score = _stop_score(s, at, at + first) if end == at + first else 2.0
        elif marks.strip("…") == "" and re.fullmatch(r"[\s.…·]*[\d\-—]{1,6}\s*", after):
            score = FORBIDDEN  # the leader of a table of contents
        decides, speaker = None, False
        if nxt and nxt in ",，、;；:)）》":
            score = FORBIDDEN
        elif o is not None and s[quote] in SPEECH:
            if told:
                score = 3.0 if not after[:1].islower() else 1.0
            else:
                decides = o
                speaker = bool(SPEAKER.match(after)) or nxt.islower() or bool(SPEAKER_LATIN.match(after))
        elif o is not None:  # a title or a bracket
            decides, speaker = o, s[quote] in "》〉】" or nxt.islower()
        elif nxt.islower() and marks[0] in "!?" and after[:1] == " ":
            score -= 4.0
        if score > -3.5:
            nodes.append((end, score, decides, speaker))
    ends = [0, *(x[0] for x in nodes), n]
    # The first place from each end on that is no white space.
    solid = [e + len(s[e:]) - len(s[e:].lstrip()) if s[e : e + 1].isspace() else e for e in ends]
    best, back, highest = [0.0], [0], [0.0]
    for j in range(1, len(ends)):
        own = nodes[j - 1] if j <= len(nodes) else (n, 0.0, None, False)
        top, arg = -1e18, 0
        for i in range(j - 1, -1, -1):
            size = ends[j] - ends[i]
            # Nothing from here on back can be better: spans only grow.
            if highest[i] + own[1] - min(size, 1000) * 1e-4 - (own[2] is not None) <= top:
                break
            score = best[i] + own[1]
            if own[2] is not None:
                begins = solid[i] >= own[2]
                # A quotation is a sentence of its own only where it begins one and no speaker follows.
                score += (-7.0 if own[3] else -1.0) if begins else -7.0
            if size < 2 or solid[i] >= ends[j]:
                score -= 3.0
            score -= min(size, 1000) * 1e-4
            if score > top:
                top, arg = score, i
        best.append(top)
        highest.append(max(highest[-1], top))
        back.append(arg)
    out, j = [], len(ends) - 1
    while j:
        out.append(ends[j])
        j = back[j]
    return out[::-1]


def sentence_ends(text: str | None) -> list[int]:
    """Code points of the text up to each sentence's last character, in order.

    A line break ends a sentence, blank lines hold none; white space belongs
    to none.  A null, empty or blank text has no sentence.
    """
    if not text:
        return []
    to, _ = tables()
    a = points(text)
    b = to.take(a)
    keep = b != DROP
    plain = bool(keep.all())
    s = unpoints(b if plain else b[keep])
    at = None if plain else np.flatnonzero(keep)
    out: list[int] = []
    for line in LINE.finditer(s):
        body = line[0].rstrip()
        lead = len(body) - len(body.lstrip())
        body = body[lead:]
        if not body:
            continue
        for e in _ends_of_line(body):
            out.append(line.start() + lead + len(body[:e].rstrip()))
    if at is None or not out:
        return out
    # Invisible characters after the last visible one of a line, and variation selectors, belong to the sentence.
    real = []
    size = len(a)
    for e in out:
        stop = int(at[e - 1]) + 1
        nxt = int(at[e]) if e < len(at) else size
        if nxt > stop and (e >= len(at) or s[e].isspace() or text[stop] in "️‍"):
            stop = nxt
        real.append(stop)
    return real


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat: list[int] = []
        ends = [0]
        for t in batch.column(1).to_pylist():
            flat += sentence_ends(t)
            ends.append(len(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["id", "ends"])


def split_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ends): each row's sentence ends in code points, in order; an empty list for null and blank texts.

    Narrow: no row moves.  Repeated rows stay.
    """
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_sentences, "id long, ends array<int>")
