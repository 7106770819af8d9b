"""The stateless stages on streams, and late-data counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mojiforge.functions.text import half_width, is_sentence_ok, remove_illegal, segment


def clean_stream(rows: DataFrame, text_col: str, max_len: int = 128, min_len: int = 10) -> DataFrame:
    """``rows`` exploded to cleaned sentences in ``sentence``: the batch stage unchanged, on a stream or a table."""
    return rows.withColumn("sentence", F.explode(segment(F.col(text_col), max_len, min_len)))


def quality_by_window(rows: DataFrame, text_col: str, time_col: str, window: str = "1 day", late: str = "30 days", min_len: int = 10) -> DataFrame:
    """(window, rows, ok) of event-time windows; later rows than ``late`` are left out on a stream."""
    ok = is_sentence_ok(remove_illegal(half_width(F.col(text_col))), min_len)
    marked = rows.withWatermark(time_col, late) if rows.isStreaming else rows
    return marked.groupBy(F.window(time_col, window)).agg(F.count("*").alias("rows"), F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("ok"))
