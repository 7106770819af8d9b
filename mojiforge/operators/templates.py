"""Correction by span templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiforge.functions.text import strip

# A span with one of these isn't corrected.
STOP_TOKENS = ("。", "，", "：", "、", "？", "！", "及", "和", "或", "而", "且", "但")
MAX_PATTERNS = 100_000


def patterns_of(templates: DataFrame) -> DataFrame:
    """(left_text, right_text, action_code) without repeats; action 3 gives the swapped pair as well; rows with a null side or action are left out."""
    t = templates.select("left_text", "right_text", "action_code").where("left_text is not null and right_text is not null and action_code is not null")
    swapped = t.where("action_code = '3'").select(F.col("right_text").alias("left_text"), F.col("left_text").alias("right_text"), "action_code")
    return t.unionByName(swapped).distinct()


def collect_patterns(templates: DataFrame) -> list[tuple[str, str, str]]:
    """The patterns, longest first, of equals in order of their texts, of one pair the highest action first; refuses more than MAX_PATTERNS."""
    rows = patterns_of(templates).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError("too many templates")
    by_action = sorted(((r.left_text, r.right_text, r.action_code) for r in rows), key=lambda p: p[2], reverse=True)
    return sorted(by_action, key=lambda p: (-len(p[0]) - len(p[1]), p[0], p[1]))


def fixed_span(span: str, left: str, right: str, action: str) -> str:
    """What the action makes of a span: 0 leaves it, 1 strips the left side's characters from its beginning, 2 the
    right side's from its end, 3 those of the shorter side; a text after the number is put in their place."""
    kind, _, text = action.partition(" ")
    if text:
        return text + span.lstrip(left) if kind == "1" else span.rstrip(right) + text
    if kind == "1" or kind == "3" and len(left) < len(right):
        return span.lstrip(left)
    if kind in ("2", "3"):
        return span.rstrip(right)
    return span


def correct_text(text: str, patterns: list[tuple[str, str, str, re.Pattern]]) -> tuple[str, int]:
    """(corrected text, spans corrected): each pattern sees what the ones before it left."""
    fixes = 0
    for left, right, action, found in patterns:
        if action == "0" or left not in text or right not in text:
            continue
        for span in found.findall(text):
            if not any(t in span for t in STOP_TOKENS):
                text = text.replace(span, fixed_span(span, left, right, action))
                fixes += 1
    return text, fixes


def correct(rows: DataFrame, key: str, text_col: str, templates: DataFrame) -> DataFrame:
    """(key, corrected, fixes) of every row; null texts stay null with 0 fixes."""
    shared = rows.sparkSession.sparkContext.broadcast(collect_patterns(templates))
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(a, b, c, re.compile(a + ".*" + b)) for a, b, c in shared.value]
        for f in frames:
            got = [(None, 0) if t is None else correct_text(t, compiled) for t in f["text"]]
            yield pd.DataFrame({"key": f["key"], "corrected": [g[0] for g in got], "fixes": [g[1] for g in got]})

    out = rows.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInPandas(run, f"key {kind}, corrected string, fixes long")
    return out.withColumnRenamed("key", key)


def correct_file(spark: SparkSession, source: str, target: str, templates: DataFrame) -> None:
    """The stripped lines of a text file or folder, corrected and written to another, in order."""
    from mojiforge.sources.files import numbered_lines, write_lines

    lines = numbered_lines(spark, source).select("line", strip(F.col("value")).alias("value"))
    write_lines(correct(lines, "line", "value", templates), target, "corrected", ["line"])


def fix_counts(corrected: DataFrame) -> DataFrame:
    """One row: texts with a correction and corrections."""
    return corrected.agg(F.coalesce(F.sum((F.col("fixes") > 0).cast("long")), F.lit(0)).alias("sentence_num"), F.coalesce(F.sum("fixes"), F.lit(0)).alias("error_num"))
