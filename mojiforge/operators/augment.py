"""Reproducible error augmentation of clean sentences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiforge.functions.text import is_sentence_ok
from mojiforge.operators.segment import max_match

MAX_ENTRIES = 1_000_000
# Shares of the kinds of edit and of the confusion sets.
EDITS = (("replace", 0.7), ("delete", 0.15), ("append", 0.1), ("move", 0.05))
CHAR_SETS = (("shape", 0.1), ("sound", 0.9))
WORD_SETS = (("synonym", 0.1), ("sound", 0.9))
WORD_SETS_SAME_LENGTH = (("synonym", 0.0), ("sound", 1.0))
CHUNK = 10


@dataclass(frozen=True)
class Profile:
    word_prob: float = 0.5
    edit: str | None = None
    same_length: bool = False


GEC, CSC = Profile(), Profile(0.2, "replace", True)


@dataclass
class Sets:
    """Candidate lists: of characters by shape and sound, of words by meaning and sound."""

    shape: dict[str, list[str]] = field(default_factory=dict)
    char_sound: dict[str, list[str]] = field(default_factory=dict)
    synonym: dict[str, list[str]] = field(default_factory=dict)
    word_sound: dict[str, list[str]] = field(default_factory=dict)


class Draws:
    """Choices by hash: the n-th draw of a chunk is a number of 32 bits that depends on nothing but the seed, the key, the chunk and n,
    so it is the same wherever and in whatever order rows are processed, and SQL can repeat it."""

    def __init__(self, seed: int, key: object, chunk: int) -> None:
        self.head, self.n = f"{seed}|{key}|{chunk}|", -1

    def number(self) -> int:
        self.n += 1
        return int(hashlib.md5(f"{self.head}{self.n}".encode()).hexdigest()[:8], 16)

    def random(self) -> float:
        return self.number() / (1 << 32)

    def randrange(self, n: int) -> int:
        return self.number() % n

    def choice(self, options: Sequence):
        return options[self.number() % len(options)]


def _is_han(token: str) -> bool:
    return "一" <= token[:1] <= "龥"


def _pick(rng: Draws, shares) -> str:
    x = rng.random()
    for name, share in shares:
        x -= share
        if x < 0:
            return name
    return shares[-1][0]


def substitute(rng: Draws, token: str, sets: Sets, words: bool, same_length: bool) -> str | None:
    if words:
        which = _pick(rng, WORD_SETS_SAME_LENGTH if same_length else WORD_SETS)
        options = (sets.synonym if which == "synonym" else sets.word_sound).get(token, [])
    else:
        options = (sets.shape if _pick(rng, CHAR_SETS) == "shape" else sets.char_sound).get(token, [])
    if same_length:
        options = [x for x in options if len(x) == len(token)]
    return rng.choice(options) if options else None


def edit_chunk(rng: Draws, tokens: list[str], sets: Sets, words: bool, profile: Profile) -> list[str]:
    """One edit at a Chinese token; without one, or without a candidate, nothing changes."""
    places = [i for i, t in enumerate(tokens) if _is_han(t) and (not words or len(t) > 1)]
    if not places:
        return tokens
    kind = profile.edit or _pick(rng, EDITS)
    c = rng.randrange(len(places))
    at, out = places[c], list(tokens)
    if kind == "replace":
        new = substitute(rng, out[at], sets, words, profile.same_length)
        if new is not None:
            out[at] = new
    elif kind == "delete":
        if words:
            gone = rng.choice(out[at])
            out[at] = out[at].replace(gone, "")
        else:
            del out[at]
    else:
        near = [p for p in places[max(0, c - 2) : c + 2] if p != at]
        if kind == "append":
            synonyms = sets.synonym.get(out[at], []) if words and rng.random() < 0.5 else None
            if synonyms:
                out.insert(at + 1, rng.choice(synonyms))
            elif synonyms is None:
                out.insert((rng.choice(near) if near else at) + 1, out[at])
        elif near:
            other = rng.choice(near)
            out[at], out[other] = out[other], out[at]
    return out


def augment_text(text: str, seed: int, key: object, sets: Sets, vocabulary: frozenset[str], profile: Profile) -> str:
    """The text with one edit in each chunk of ten tokens; the same for the same seed and key, whatever else is processed."""
    words = Draws(seed, key, -1).random() < profile.word_prob
    tokens = max_match(text, vocabulary) if words else list(text)
    return "".join("".join(edit_chunk(Draws(seed, key, i // CHUNK), tokens[i : i + CHUNK], sets, words, profile)) for i in range(0, len(tokens), CHUNK))


def augment(rows: DataFrame, key: str, text_col: str, sets: Sets, profile: Profile = GEC, vocabulary: frozenset[str] = frozenset(), seed: int = 123, min_len: int = 10) -> DataFrame:
    """(key, aug, src) of the rows whose text is an ok sentence.

    A narrow, deterministic stage.  The candidate sets are bounded by
    MAX_ENTRIES before they are broadcast.
    """
    if sum(1 + len(x) for s in (sets.shape, sets.char_sound, sets.synonym, sets.word_sound) for x in s.values()) > MAX_ENTRIES:
        raise ValueError("the confusion sets are too large to broadcast")
    shared = rows.sparkSession.sparkContext.broadcast((sets, vocabulary))
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, v = shared.value
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "aug": [augment_text(t, seed, k, s, v, profile) for k, t in zip(f["key"], f["src"])], "src": f["src"]})

    good = rows.where(is_sentence_ok(F.col(text_col), min_len)).select(F.col(key).alias("key"), F.col(text_col).alias("src"))
    return good.mapInPandas(run, f"key {kind}, aug string, src string").withColumnRenamed("key", key)
