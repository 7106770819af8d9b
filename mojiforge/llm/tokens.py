"""Encoding texts with a public byte-level BPE vocabulary.

Texts are split into words by the vocabulary's pattern; a table of distinct
words holds the ids of each word, encoded once; a text's ids are the ids of
its words by position.  The table belongs to a task and is bounded, so no word
is moved: one table for all tasks would have every occurrence sent to its word
and every word's ids back to its text, several times the input.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiforge.session import settle

# Fixed value: the pattern that goes with the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TABLE_WORDS = 1 << 18

_loaded: dict[int, WordTable] = {}


def vocabulary_path() -> str:
    """Where the default vocabulary (byte_bpe_50k) lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class WordTable:
    """Distinct words and their ids."""

    def __init__(self, ranks: dict[bytes, int], limit: int = TABLE_WORDS) -> None:
        import regex
        import tiktoken

        self.split = regex.compile(PATTERN).findall
        self.encode_word = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.words: dict[str, array] = {}
        self.limit = limit

    def encode(self, text: str, out: array) -> None:
        words = self.words
        for w in self.split(text):
            if (ids := words.get(w)) is None:
                if len(words) >= self.limit:
                    words.clear()
                ids = words[w] = array("i", self.encode_word(w))
            out.extend(ids)


def word_table(shared) -> WordTable:
    """The worker's table for a broadcast vocabulary file; one is kept from task to task."""
    data = shared.value
    if (t := _loaded.get(key := hash(data))) is None:
        _loaded.clear()
        t = _loaded[key] = WordTable(read_ranks(data))
    return t


def share_vocabulary(spark: SparkSession, path: str | None = None):
    """Broadcasts a vocabulary file (of fixed size, under 1 MB) read by the driver."""
    with open(path or vocabulary_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(shared, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(shared)
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 2000):
                part = batch.slice(start, 2000)
                flat, ends = array("i"), [0]
                for t in part.column(part.num_columns - 1).to_pylist():
                    if t:
                        table.encode(t, flat)
                    ends.append(len(flat))
                if count_only:
                    out = pa.array(np.diff(np.array(ends, np.int64)))
                else:
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], [*part.schema.names[:-1], "__n" if count_only else "ids"])

    return run


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every row's text, without special tokens.

    Strings of special tokens are ordinary text.  Null and empty texts have
    the empty list.  Rows stay as they are, repeated ones included.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(share_vocabulary(df.sparkSession, path), False), "id long, ids array<int>")


def _split(distinct: bool):
    """(id, text) to the distinct (word) of each batch, or to (id, word, places), a row for each distinct word of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        for batch in batches:
            if distinct:
                words = {w for t in batch.column(1).to_pylist() if t for w in split(t)}
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string())], ["word"])
                continue
            ids, found, places = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at: dict[str, list[int]] = {}
                for k, w in enumerate(split(t) if t else ()):
                    at.setdefault(w, []).append(k)
                ids += [i] * len(at)
                found += at
                places += at.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(places, pa.list_(pa.int32()))], ["row", "word", "places"])

    return run


def _encoded_words(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_table(shared).encode_word
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(encode(w)) for w in words], pa.list_(pa.int32()))], ["word", "ids"])

    return run


def encode_by_word_table(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """``encode_texts`` by one table of distinct words for all tasks: words are split, each distinct one is encoded
    once, and a text's ids are joined from the table by position.

    Every distinct word of a text is moved to its row of the table and its ids
    are moved back, which is more than the input where words are long and
    rare, as in scripts without spaces.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = settle(rows)
    texts = rows.select("row", "text")
    words = texts.mapInArrow(_split(True), "word string").distinct().mapInArrow(_encoded_words(share_vocabulary(df.sparkSession, path)), "word string, ids array<int>")
    placed = texts.mapInArrow(_split(False), "row long, word string, places array<int>").join(words, "word")
    each = placed.select("row", F.explode("places").alias("place"), "ids").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("by"))
    ids = F.coalesce(F.flatten(F.col("by.ids")), F.array().cast("array<int>"))
    return rows.select("row", "id").join(each, "row", "left").select("id", ids.alias("ids"))


def count_tokens(df: DataFrame, columns: list[str], text_col: str, path: str | None = None) -> DataFrame:
    """``columns`` and n_tokens (0 for null and empty texts) of every row."""
    rows = df.select(*columns, F.col(text_col).alias("__text"))
    out = rows.mapInArrow(_encoded(share_vocabulary(df.sparkSession, path), True), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", __n long")
    return out.withColumnRenamed("__n", "n_tokens")


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(shared.value)
        pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for p, i in ranks.items():
            pieces[i] = p
        table = pa.array(pieces, pa.binary())
        for batch in batches:
            ids = batch.column(1)
            joined = table.take(ids.flatten())  # the id-to-piece join: one look-up for each position
            data, ends = joined.buffers()[2], np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
            data = data.to_pybytes() if data is not None else b""
            at = ends[np.asarray(ids.offsets) - ids.offsets[0].as_py()]
            texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) of ``encoded(id, ids)``; null ids count as none."""
    rows = encoded.select("id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoded(share_vocabulary(encoded.sparkSession, path)), "id long, text string")
