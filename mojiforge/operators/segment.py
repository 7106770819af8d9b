"""Tokenisers: dictionary maximum match, characters, basic words and word pieces."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORD = 100
ROWS_AT_ONCE = 500


def max_match(text: str, vocabulary: frozenset[str]) -> list[str]:
    """The longest known word at each place, else one character."""
    longest = max(map(len, vocabulary), default=1)
    out, i = [], 0
    while i < len(text):
        n = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in vocabulary), 1)
        out.append(text[i : i + n])
        i += n
    return out


def basic_tokens(text: str, lower: bool = True) -> list[str]:
    """Words and marks: control characters dropped, Chinese characters and punctuation alone, accents stripped if ``lower``."""
    out: list[str] = []
    word = ""

    def flush() -> None:
        nonlocal word
        if word:
            out.append(word)
        word = ""

    for c in text:
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind == "Zs":
            flush()
        elif kind in ("Cc", "Cf") or c == "�":
            continue
        elif _is_ideograph(ord(c)) or _is_mark(c, kind):
            flush()
            out.append(c)
        else:
            word += c
    flush()
    if not lower:
        return out
    plain = ("".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn") for t in out)
    return [t for t in plain if t]


def _is_ideograph(c: int) -> bool:
    return 0x4E00 <= c <= 0x9FFF or 0x3400 <= c <= 0x4DBF or 0x20000 <= c <= 0x2CEAF or 0xF900 <= c <= 0xFAFF or 0x2F800 <= c <= 0x2FA1F


def _is_mark(c: str, kind: str) -> bool:
    return kind[0] == "P" or c.isascii() and not c.isalnum() and c.isprintable() and c != " "


def word_pieces(word: str, vocabulary: frozenset[str], unknown: str = "[UNK]") -> list[str]:
    """Greedy longest pieces, later ones marked ##; unknown where a part has none or the word is too long."""
    if len(word) > MAX_WORD:
        return [unknown]
    out, i = [], 0
    while i < len(word):
        mark = "##" if i else ""
        n = next((n for n in range(len(word), i, -1) if mark + word[i:n] in vocabulary), 0)
        if not n:
            return [unknown]
        out.append(mark + word[i:n])
        i = n
    return out


def tokens_with(f, texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, tokens) by a Python tokeniser, in Arrow batches; null texts have null tokens."""
    kind = dict(texts.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"key": x["key"], "tokens": [None if t is None else f(t) for t in x["text"]]})

    return texts.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInPandas(run, f"key {kind}, tokens array<string>").withColumnRenamed("key", key)


def character_ids(rows: DataFrame, key: str, text_col: str, vocabulary: DataFrame, max_len: int | None = None, unknown: int = 1, start: int = 2, end: int = 3, pad: int = 0) -> DataFrame:
    """(key, input_ids, attention_mask) of each row: start, the characters' ids, end, padding.

    With ``max_len`` texts are cut to as many places.  Without, none is cut:
    rows are padded to the longest text among those whose lengths have as
    many binary digits, so that padding at most doubles a row.
    ``vocabulary(token, id)`` is collected, at most one id for each character.
    """
    r = rows.select(F.col(key), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if max_len is None:
        r = r.withColumn("digits", F.length(F.bin(F.char_length("text").cast("long"))))
        longest = r.groupBy("digits").agg((F.max(F.char_length("text")) + 2).alias("width"))
        r = r.join(F.broadcast(longest), "digits").select(key, "text", "width")
    else:
        r = r.withColumn("width", F.lit(max_len))
    known = rows.sparkSession.sparkContext.broadcast({ord(x.token): x.id for x in vocabulary.collect() if x.token and len(x.token) == 1})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.full(0x110000, unknown, np.int32)
        ids[list(known.value.keys())] = list(known.value.values())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                widths = batch.column(2).to_numpy()
                offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
                out, mask = np.full(offsets[-1], pad, np.int32), np.zeros(offsets[-1], np.int32)
                for o, width, t in zip(offsets.tolist(), widths.tolist(), batch.column(1).to_pylist()):
                    a = ids[np.frombuffer(t[: width - 2].encode("utf-32-le", "surrogatepass"), np.uint32)]
                    out[o], out[o + 1 : o + 1 + len(a)], out[o + 1 + len(a)] = start, a, end
                    mask[o : o + len(a) + 2] = 1
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (out, mask))], ["key", "input_ids", "attention_mask"])

    kind = dict(rows.dtypes)[key]
    return r.mapInArrow(run, f"key {kind}, input_ids array<int>, attention_mask array<int>").withColumnRenamed("key", key)


def sentinel(source: Column, sign: str, max_len: int) -> Column:
    """A text with the start sign before it, cut to what fits between the special tokens."""
    return F.substring(F.concat(F.lit(sign), source), 1, max_len - 2)


def with_special(a: Column, b: Column | None, start: int, end: int) -> Column:
    """Ids with special ones: start a end, or start a end b end."""
    one = F.concat(F.array(F.lit(start)), a, F.array(F.lit(end)))
    return one if b is None else F.concat(one, b, F.array(F.lit(end)))


def special_mask(a: Column, b: Column | None = None) -> Column:
    """1 at the special places of ``with_special``."""
    zeros = lambda x: F.array_repeat(F.lit(0), F.size(x))
    one = F.concat(F.array(F.lit(1)), zeros(a), F.array(F.lit(1)))
    return one if b is None else F.concat(one, zeros(b), F.array(F.lit(1)))


def token_types(a: Column, b: Column | None = None) -> Column:
    """0 for the first text and its special places, 1 for the second."""
    one = F.array_repeat(F.lit(0), F.size(a) + 2)
    return one if b is None else F.concat(one, F.array_repeat(F.lit(1), F.size(b) + 1))


def pieces_to_text(tokens: Column) -> Column:
    """Word pieces joined: later pieces follow without a blank."""
    return F.replace(F.array_join(tokens, " "), F.lit(" ##"), F.lit(""))


def spaced(rows: DataFrame, key: str, text_col: str, vocabulary: frozenset[str]) -> DataFrame:
    """(key, text): tokens of the dictionary match joined by blanks."""
    out = tokens_with(lambda t: max_match(t, vocabulary), rows, key, text_col)
    return out.select(key, F.array_join("tokens", " ").alias("text"))
