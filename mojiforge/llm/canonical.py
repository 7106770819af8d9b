"""One consistent form for texts that look the same.

Tokens are looked up in vocabulary tries by a weighted edit automaton to which
look-alike characters, widths, accents written apart and invisible characters
cost nothing; of the tokens it reaches, the most frequent spelling is
canonical.  Tokens are the words of alphabetic scripts and, in scripts without
spaces, a character that looks like one of another script together with the
two beside it (katakana and Han characters: only what stands beside them tells
which one is meant).  Everything unmatched, and all other text, is normalised
by table (``textforms.displayed``).  A paid edit would be visible, so the
operator asks for matches without cost; the automaton takes any budget.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiforge.llm.textforms import AMBIGUOUS, DROP, displayed, fold, points, tables, unpoints
from mojiforge.session import settle

LETTER = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯḀ-ỿＡ-Ｚａ-ｚ"
WORD = re.compile(f"[{LETTER}][{LETTER}̀-ͯ­͏​-‏⁠-⁤︀-️﻿]*")


BESIDE = re.compile(f"(?s)(?<=.)[{''.join(AMBIGUOUS)}{''.join(AMBIGUOUS.values())}](?=.)")
SPELLINGS_BROADCAST = 200_000


@lru_cache(1 << 16)
def skeleton(word: str) -> str:
    """What words that look alike have in common."""
    return unpoints(fold(points(word))).translate(PLAIN)


PLAIN = str.maketrans(AMBIGUOUS)


def script(word: str) -> str | None:
    """The one script of a word's letters, or None where they mix or hold anything but letters."""
    kinds = {unicodedata.name(c, "?").split()[0] for c in word}
    return kinds.pop() if len(kinds) == 1 and kinds & {"LATIN", "GREEK", "CYRILLIC"} else None


class Trie:
    """A vocabulary with counts; ``match`` walks it with the edit automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = (word, count)

    def match(self, word: str, budget: int = 0) -> list[tuple[int, int, str]]:
        """(cost, -count, word) of the vocabulary words within the budget, best first.

        Free: letters with the same displayed form, invisible characters, and an
        accent that composes with its letter.  Any other replaced, added or
        missing letter costs 1.
        """
        to, _ = tables()
        pieces = re.findall(r"[^\u0300-\u036f][\u0300-\u036f]*|[\u0300-\u036f]+", unicodedata.normalize("NFD", "".join(c for c in word if to[ord(c)] != DROP)))
        shown = [skeleton(c) for c in pieces]
        found: dict[str, tuple[int, int]] = {}
        seen: dict[tuple[int, int], int] = {}
        stack = [(self.root, 0, 0)]
        while stack:
            node, i, cost = stack.pop()
            if cost > budget or seen.get((id(node), i), budget + 1) <= cost:
                continue
            seen[id(node), i] = cost
            if i == len(pieces) and "" in node:
                w, n = node[""]
                found[w] = min(found.get(w, (cost, -n)), (cost, -n))
            for c, child in node.items():
                if c == "":
                    continue
                if i < len(pieces):
                    same = c == pieces[i] or skeleton(c) == shown[i]
                    stack.append((child, i + 1, cost + (not same)))
                if cost < budget:
                    stack.append((child, i, cost + 1))
            if cost < budget and i < len(pieces):
                stack.append((node, i + 1, cost + 1))
        return sorted((cost, n, w) for w, (cost, n) in found.items())


def padded(text: str) -> str:
    """The displayed form between two line ends, so that every character has two beside it."""
    return f"\n{displayed(text)}\n"


def beside(s: str) -> Iterator[tuple[int, str]]:
    """(place, token of three characters) of the characters in question of a padded text."""
    for m in BESIDE.finditer(s):
        yield m.start(), s[m.start() - 1 : m.start() + 2]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (word, skeleton, n), counted for each batch."""
    for batch in batches:
        n: Counter = Counter()
        for t in batch.column(0).to_pylist():
            n.update(WORD.findall(t))
            n.update(w for _, w in beside(padded(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([skeleton(w) for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "skeleton", "n"])


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, skeleton, n) of a whole partition to (word, canonical) where the table alone says otherwise."""
    trie, odd = Trie(), []
    for batch in batches:
        for word, shown, n in zip(*(c.to_pylist() for c in batch.columns)):
            among = len(word) == 3 and bool(BESIDE.search(word))
            if word != shown or among:
                odd.append((word, shown, among))
            if among or script(word):
                trie.add(word, n)
    out = []
    for word, shown, among in odd:
        if (best := trie.match(word)) and best[0][2] != (word if among else shown):
            out.append((word, best[0][2]))
    # A clean spelling of such a class follows the class.
    known = {skeleton(w): c for w, c in out if not BESIDE.search(w)}
    out += [(s, c) for s, c in known.items()]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([c for _, c in out], pa.string())], ["word", "canonical"])


def spellings(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, canonical): the tokens whose canonical spelling is another than their displayed form.

    The vocabulary covers all texts.  Tokens are counted before they are
    shuffled, and each partition builds the trie of its own tokens: all tokens
    that the automaton reaches from one another without cost meet in one
    partition.
    """
    n = texts.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(_words, "word string, skeleton string, n long")
    n = n.groupBy("word", "skeleton").agg(F.sum("n").alias("n"))
    # Most classes have one spelling that is also the displayed one.
    return n.repartition("skeleton").mapInArrow(_spellings, "word string, canonical string").distinct()


def _digest(s: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


HASHED = "field string, id long, form binary, raw binary"


def _respelled(text: str, by: dict[str, str]) -> str:
    """The displayed form with canonical spellings, which survive the table: they are put in after it, at their places."""
    marks: list[str] = []

    def keep(m: re.Match) -> str:
        if (c := by.get(m[0])) is None or len(marks) >= 0xFFFD:
            return m[0]
        marks.append(c)
        return chr(0xF0000 + len(marks) - 1)

    s = padded(WORD.sub(keep, text))
    chars = None
    for at, token in beside(s):
        if c := by.get(token):
            chars = chars or list(s)
            chars[at] = c[1]
    s = "".join(chars) if chars else s
    return re.sub("[\U000f0000-\U000ffffd]", lambda m: marks[ord(m[0]) - 0xF0000] if ord(m[0]) - 0xF0000 < len(marks) else m[0], s)[1:-1]


def _hashes(by_text: bool, shared=None):
    """(field, id, text[, spellings]) to hashes of the canonical form and of the stored text, blank ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value if shared is not None else {}
        for batch in batches:
            rows = []
            own = batch.column(3).to_pylist() if by_text else [None] * batch.num_rows
            for field, i, text, words in zip(*(batch.column(k).to_pylist() for k in range(3)), own):
                if s := displayed(text):
                    if by := dict(words) if words else common:
                        s = _respelled(text, by)
                    rows.append((field, i, _digest(s), _digest(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["field", "id", "form", "raw"])

    return run


def _found_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, id, text) to (field, id, word) of the tokens of each text."""
    for batch in batches:
        rows = [(f, i, w) for f, i, t in zip(*(c.to_pylist() for c in batch.columns)) for w in {*WORD.findall(t), *(w for _, w in beside(padded(t)))}]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["field", "id", "word"])


def canonical_forms(texts: DataFrame, broadcast_up_to: int = SPELLINGS_BROADCAST) -> DataFrame:
    """(field, id, form, raw) of ``texts(field, id, text)``: hashes of 128 bits of the
    canonical form and of the stored text.

    Equal forms mean equal looks.  Null, empty and blank texts have no row;
    repeated rows stay.  Up to ``broadcast_up_to`` spellings that differ from
    the table's are sent to all tasks; more of them are joined to the texts
    that hold them, with the same result.
    """
    texts = texts.select("field", "id", "text").where("id is not null and text is not null")
    other = settle(spellings(texts, "text"))
    n = other.count()
    if n <= broadcast_up_to:
        by = {r.word: r.canonical for r in other.collect()}
        return texts.mapInArrow(_hashes(False, texts.sparkSession.sparkContext.broadcast(by)), HASHED)
    hit = texts.mapInArrow(_found_words, "field string, id long, word string").join(other, "word").distinct()
    hit = hit.groupBy("field", "id").agg(F.collect_list(F.struct("word", "canonical")).alias("by"))
    return texts.join(hit, ["field", "id"], "left").select("field", "id", "text", F.map_from_entries("by").alias("by")).mapInArrow(_hashes(True), HASHED)


def same_look_pairs(forms: DataFrame) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: texts of one field with equal forms that are stored differently, each pair once."""
    forms = forms.distinct()
    mixed = forms.groupBy("field", "form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("field", "form")
    some = settle(forms.join(mixed, ["field", "form"], "left_semi"))
    a = some.select("field", "form", F.col("id").alias("id_a"), F.col("raw").alias("raw_a"))
    b = some.select("field", "form", F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["field", "form"]).where("id_a < id_b and raw_a <> raw_b").select("field", "id_a", "id_b").distinct()
