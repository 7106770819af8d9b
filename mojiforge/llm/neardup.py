"""Near-duplicate texts by one-wildcard signature segments.

A text's signature is a vector of min-hash symbols over its stretches of five
characters; the share of equal symbols estimates the Jaccard similarity.  The
vector is cut into segments so few that two similar texts differ by at most
one symbol in one of them (the pigeonhole of deletion-variant indexes), and
each segment is indexed once for each symbol left out.  An equality join of
those variants gives candidates, the whole signatures thin them out, and the
exact similarity of the whole texts decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiforge.llm.overlap import KeyFilter, key_filter
from mojiforge.llm.textforms import compact, unpoints
from mojiforge.session import settle

SEGMENTS, WIDTH, GRAM = 12, 4, 5
BLOCK = 1 << 16


def gram_hashes(a: np.ndarray, n: int = GRAM) -> np.ndarray:
    """One mixed 32-bit hash for each stretch of n code points; a shorter text is one stretch."""
    if not len(a):
        return np.zeros(0, np.uint32)
    m = max(1, len(a) - n + 1)
    h = np.zeros(m, np.uint64)
    for i in range(min(n, len(a))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : i + m].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def signatures(grams: list[np.ndarray], size: int = SEGMENTS * WIDTH) -> np.ndarray:
    """Min-hash symbols of 16 bits, a row for each array of gram hashes (none of them empty)."""
    rng = np.random.default_rng(20)
    factor = rng.integers(0, 1 << 32, size, np.uint64).astype(np.uint32) | np.uint32(1)
    salt = rng.integers(0, 1 << 32, size, np.uint64).astype(np.uint32)
    out = np.empty((len(grams), size), np.uint16)
    i = 0
    while i < len(grams):
        j, total = i, 0
        while j < len(grams) and (j == i or total + len(grams[j]) <= BLOCK):
            total += len(grams[j])
            j += 1
        flat = np.concatenate(grams[i:j])
        starts = np.cumsum([0, *map(len, grams[i : j - 1])])
        for k in range(size):
            out[i:j, k] = np.minimum.reduceat((flat ^ salt[k]) * factor[k], starts) & 0xFFFF
        i = j
    return out


def variants(sig: np.ndarray, segments: int = SEGMENTS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(keys, symbols left out): a key holds a segment's place, the wildcard's place and the other symbols."""
    s = sig.reshape(len(sig), segments, width).astype(np.uint64)
    keys = np.empty((len(sig), segments, width), np.uint64)
    for w in range(width):
        key = np.arange(segments, dtype=np.uint64)[None, :] * np.uint64(width) + np.uint64(w)
        key = np.broadcast_to(key, (len(sig), segments))
        for i in range(width):
            if i != w:
                key = (key << np.uint64(16)) | s[:, :, i]
        keys[:, :, w] = key
    return keys.reshape(len(sig), -1).view(np.int64), sig


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, h1, h2, sig) of the texts that aren't blank."""
    import xxhash

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        kept, h1, h2, grams = [], [], [], []
        for i, text in zip(ids, texts):
            if (text := text.as_py()) is None:
                continue
            a = compact(text)
            if not len(a):
                continue
            d = xxhash.xxh3_128_digest(a.tobytes())
            kept.append(i)
            h1.append(d[:8])
            h2.append(d[8:])
            grams.append(gram_hashes(a))
        sig = signatures(grams)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kept, pa.int64()),
                pa.array(np.frombuffer(b"".join(h1), np.int64)),
                pa.array(np.frombuffer(b"".join(h2), np.int64)),
                pa.array([x.tobytes() for x in sig], pa.binary()),
            ],
            ["id", "h1", "h2", "sig"],
        )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sig) to (key, rep, left_out, first)."""
    for batch in batches:
        n, size = batch.num_rows, SEGMENTS * WIDTH
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, size)
        keys, left_out = variants(sig)
        rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1)), pa.array(rep), pa.array(left_out.reshape(-1).astype(np.int32))],
            ["key", "rep", "left_out"],
        )


def _alike(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(n, -1) for k in (2, 3))
                same = (a == b).sum(1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 1)], ["a", "b"]).filter(pa.array(same))

    return run


def _texts(wanted):
    """(id, text) to (id, compact text) of ids that may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = KeyFilter(wanted.value)
        for batch in batches:
            batch = batch.filter(pa.array(only.has(batch.column(0).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unpoints(compact(x)) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return run


def _jaccard(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, set] = {}

        def grams(t: str) -> set:
            if (g := last.get(t)) is None:
                if len(last) > 64:
                    last.clear()
                g = last[t] = {t[i : i + GRAM] for i in range(max(1, len(t) - GRAM + 1))}
            return g

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = grams(x), grams(y)
                n = len(p & q)
                keep.append(n >= threshold * (len(p) + len(q) - n) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts that are nearly the same as displayed.

    ``members(id, rep)``: every row whose text isn't null or blank, with the
    smallest id among the rows of the same text (white space left out).
    ``links(a, b)``: pairs a < b of such representatives of different texts
    whose stretches of five characters have a Jaccard similarity of at least
    ``threshold``; a text of under five characters is one stretch.  Rows of
    null, empty or blank text are in neither.  Repeated ids count once.  Other
    columns of ``df`` don't matter, whatever their names.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    described = settle(rows.mapInArrow(_describe, "id long, h1 long, h2 long, sig binary"))
    reps = described.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    reps = settle(reps)
    members = described.select("id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep").distinct()
    sigs = reps.select("rep", "sig")
    p = sigs.mapInArrow(_variants, "key long, rep long, left_out int")
    q = p.select("key", F.col("rep").alias("b"), F.col("left_out").alias("left_out_b"))
    # Segments equal in all symbols meet once for each wildcard; only the first of them counts.
    first = F.shiftright("key", 48) % WIDTH == 0
    met = p.withColumnRenamed("rep", "a").join(q, "key").where((F.col("a") < F.col("b")) & ((F.col("left_out") != F.col("left_out_b")) | first)).select("a", "b").distinct()
    size = SEGMENTS * WIDTH
    # Below this share of equal symbols a similarity at the threshold is 4 standard deviations away.
    least = int(np.floor(size * threshold - 4 * np.sqrt(size * threshold * (1 - threshold))))
    near = (
        met.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_alike(least), "a long, b long")
    )
    near = settle(near)
    needed = near.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = df.sparkSession.sparkContext.broadcast(key_filter(needed))  # of one size; a full one only lets more rows through to the join
    texts = rows.mapInArrow(_texts(wanted), "id long, text string")
    texts = settle(texts.join(needed.distinct(), "id", "left_semi"))
    links = (
        near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_jaccard(threshold), "a long, b long")
    )
    return members, links.distinct()


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.6) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows that ``near_duplicate_classes`` links or puts in one class."""
    members, links = near_duplicate_classes(df, id_col, text_col, threshold)
    members = settle(members)
    left = members.select(F.col("id").alias("id_a"), F.col("rep").alias("a"))
    right = members.select(F.col("id").alias("id_b"), F.col("rep").alias("b"))
    same = left.join(right, F.col("a") == F.col("b")).where("id_a < id_b").select("id_a", "id_b")
    other = links.join(left, "a").join(right, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return same.unionByName(other)
