"""Phrase conversion between character variants (traditional to simplified and the like)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 1_000_000


class Converter:
    """Rewrites a text by a table of phrases so that it takes the fewest segments; of equals the longer first segment wins."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = {a: b for a, b in table.items() if a}
        self.longest = max(map(len, self.table), default=1)
        self.firsts = {a[0] for a in self.table}

    def convert(self, text: str) -> str:
        n = len(text)
        least, cut = [0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            least[i] = least[i + 1] + 1
            if text[i] in self.firsts:
                for k in range(2, min(self.longest, n - i) + 1):
                    if text[i : i + k] in self.table and least[i + k] + 1 <= least[i]:
                        least[i], cut[i] = least[i + k] + 1, k
        out, i = [], 0
        while i < n:
            part = text[i : i + cut[i]]
            out.append(self.table.get(part, part))
            i += cut[i]
        return "".join(out)


def convert_characters(c: Column, table: dict[str, str]) -> Column:
    """The single-character entries only, inside the JVM."""
    one = {a: b for a, b in table.items() if len(a) == len(b) == 1}
    return F.translate(c, "".join(one), "".join(one.values())) if one else c


def convert(rows: DataFrame, key: str, text_col: str, table: DataFrame) -> DataFrame:
    """(key, converted) by ``table(source, target)`` of at most MAX_ENTRIES sources; of a source listed twice the last target by order counts.

    Null texts stay null; entries with a null or empty side count as none.
    """
    once = table.where("source is not null and source <> '' and target is not null").groupBy("source").agg(F.max("target").alias("target"))
    entries = {r.source: r.target for r in once.limit(MAX_ENTRIES + 1).collect()}
    if len(entries) > MAX_ENTRIES:
        raise ValueError("the conversion table is too large to broadcast")
    shared = rows.sparkSession.sparkContext.broadcast(entries)
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Converter(shared.value)
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "converted": [None if t is None else c.convert(t) for t in f["text"]]})

    return rows.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInPandas(run, f"key {kind}, converted string").withColumnRenamed("key", key)


def convert_lists(table: DataFrame, mapping: dict[str, str], distinct: bool) -> DataFrame:
    """(key, tokens) with keys and tokens converted by character; lists of keys that meet are joined."""
    word = lambda x: convert_characters(x, mapping)
    x = table.select(word(F.col("key")).alias("key"), F.transform("tokens", word).alias("tokens"))
    out = x.groupBy("key").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return out.select("key", F.array_sort(F.array_distinct("tokens") if distinct else F.col("tokens")).alias("tokens"))
