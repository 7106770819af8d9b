"""Cutting long items into overlapping pieces at natural boundaries.

Balanced targets: the least number of pieces gives cuts at equal distances;
each is moved to the strongest boundary near it, and where that breaks a limit
one piece more is tried.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiforge.llm.sentences import sentence_ends

LIMIT, OVERLAP = 512, 64
MORE_PIECES = 6
PAUSES = frozenset("，、；：,;:")


def _strength(text: str, end: int) -> int:
    """Of a sentence end: 3 before a blank line, 2 before a line break, 1 inside a line."""
    gap = 0
    for i in range(end, len(text)):
        c = text[i]
        if c in "\n\r":
            gap += 1
        elif not c.isspace():
            break
    return min(gap, 2) + 1


def cut_positions(text: str, ends: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], int]:
    """(ends of the pieces, cuts at no sentence end).

    The last piece ends with the text; each piece after the first starts
    ``overlap`` code points before the end of the one before it, and none is
    longer than ``limit``.  Only where two sentence ends lie too far apart a
    piece ends at a pause, else at white space, else at the limit.
    """
    size, step = len(text), limit - overlap
    if size <= limit:
        return [size], 0
    natural = [e for e in ends if 0 < e < size]
    strong: dict[int, int] = {}

    def strength(e: int) -> int:
        if e not in strong:
            strong[e] = _strength(text, e)
        return strong[e]

    least = -(-(size - overlap) // step)
    for m in range(least, least + MORE_PIECES):
        width = (size - overlap) / m
        cuts, last = [], 0
        for k in range(1, m):
            target = overlap + k * width
            low, high = max(last + 1, target - width / 2), min(target + width / 2, (last or overlap) + step)
            near = natural[bisect_left(natural, low) : bisect_right(natural, high)]
            if not near:
                break
            last = max(near, key=lambda e: (strength(e) - 4 * abs(e - target) / width, -abs(e - target)))
            cuts.append(last)
        if len(cuts) == m - 1 and size - cuts[-1] <= step:
            return [*cuts, size], 0
    # Somewhere the sentence ends lie too far apart, or too unevenly for any of these: the farthest end that fits.
    cuts, last, forced = [], 0, 0
    while size - (last or overlap) > step:
        high = (last or overlap) + step
        k = bisect_right(natural, high)
        if k and natural[k - 1] > last + (overlap if last else 0) // 2:
            last = natural[k - 1]
        else:
            forced += 1
            floor = max(last + 1, high - step // 2)
            last = next((i + 1 for i in range(high - 1, floor, -1) if text[i] in PAUSES), 0) or next((i + 1 for i in range(high - 1, floor, -1) if text[i].isspace()), high)
        cuts.append(last)
    return [*cuts, size], forced


def longest_stretch(text: str, ends: list[int]) -> int:
    """Code points of the longest stretch without a sentence end or line break inside, white space around it left out."""
    best = last = 0
    for e in ends:
        part = text[last:e]
        best = max(best, e - last - (len(part) - len(part.lstrip())))
        last = e
    return best


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cuts, forced, longest = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or len(text) <= limit:
                    continue
                ends = sentence_ends(text)
                c, f = cut_positions(text, ends, limit, overlap)
                ids.append(i)
                cuts.append(c)
                forced.append(f)
                longest.append(longest_stretch(text, ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cuts, pa.list_(pa.int32())), pa.array(forced, pa.int32()), pa.array(longest, pa.int32())],
                ["id", "cuts", "forced", "longest"],
            )

    return run


def cut_items(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, cuts, forced, longest) of the items of more than ``limit`` code points.

    ``cuts``: the pieces' ends; ``forced``: how many of them are at no sentence
    end or line break; ``longest``: the longest stretch without one.  Null,
    empty and shorter texts have no row, repeated rows stay.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    return rows.mapInArrow(_cut(limit, overlap), "id long, cuts array<int>, forced int, longest int")


def pieces_of(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, start_pos, end_pos, piece) of the same items; a piece is text[start_pos:end_pos]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None and len(text) > limit:
                    last = overlap
                    for k, e in enumerate(cut_positions(text, sentence_ends(text), limit, overlap)[0]):
                        rows.append((i, k, last - overlap, e, text[last - overlap : e]))
                        last = e
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["id", "piece_no", "start_pos", "end_pos", "piece"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    return rows.mapInArrow(run, "id long, piece_no int, start_pos int, end_pos int, piece string")
