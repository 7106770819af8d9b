"""Similarity of characters by shape and sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The description characters that take two and three parts.
TWO_PARTS, THREE_PARTS = "⿰⿱⿴⿵⿶⿷⿸⿹⿺⿻", "⿲⿳"


def canonical_distance(a: str, b: str) -> int:
    """Edit distance in which a substitution costs 2: both lengths less twice the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def to_tree(description: str) -> str:
    """An ideographic description in prefix order as a bracket tree: {⿰{a}{b}}."""

    def read(i: int) -> tuple[str, int]:
        if i >= len(description):
            raise ValueError(f"incomplete description {description}")
        c = description[i]
        i += 1
        parts = ""
        for _ in range(2 if c in TWO_PARTS else 3 if c in THREE_PARTS else 0):
            part, i = read(i)
            parts += part
        return "{" + c + parts + "}", i

    tree, end = read(0)
    if end != len(description):
        raise ValueError(f"more than one tree in {description}")
    return tree


def best_similarity(a: Column, b: Column) -> Column:
    """The largest 1 - distance / longer length over all pairs of two arrays of strings; 0 where there is none."""
    one = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.char_length(x), F.char_length(y), F.lit(1))
    best = F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: one(x, y)))))
    return F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(0.0))


def least_distance(a: Column, b: Column) -> Column:
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.levenshtein(x, y)))))


def sound_similarity(a: Column, b: Column) -> Column:
    """Mean over the languages that both characters have readings in of the best similarity; null where there is none.

    Arguments: arrays, by language, of arrays of readings, null or empty where unknown.
    """
    known = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: (F.size(z["x"]) > 0) & (F.size(z["y"]) > 0))
    each = F.transform(known, lambda z: best_similarity(z["x"], z["y"]))
    return F.when(F.size(known) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def character_similarity(pairs: DataFrame, meta: DataFrame, weights: tuple[float, float, float] = (0.8, 0.2, 0.0)) -> DataFrame:
    """(a, b, similarity) of ``pairs(a, b)`` by ``meta(char, shapes, sounds[, place])``; 0 where a character is unknown.

    The weights are of shape, sound and frequency: how early the second
    character's ``place`` comes among all of them, asked for only with a
    third weight.
    """
    third = weights[2] if len(weights) > 2 else 0.0
    if third:
        size = meta.agg(F.count("*").alias("n")).first()["n"]
        meta = meta.withColumn("early", 1.0 - F.col("place") / size)
    early = F.col("early") if third else F.lit(0.0)
    m = lambda s: meta.select(F.col("char").alias(s), F.col("shapes").alias(f"shapes_{s}"), F.col("sounds").alias(f"sounds_{s}"), early.alias(f"early_{s}"))
    x = pairs.join(m("a"), "a", "left").join(m("b"), "b", "left")
    total = weights[0] * best_similarity(F.col("shapes_a"), F.col("shapes_b")) + weights[1] * F.coalesce(sound_similarity(F.col("sounds_a"), F.col("sounds_b")), F.lit(0.0)) + third * F.col("early_b")
    return x.select("a", "b", F.when(F.col("shapes_a").isNull() | F.col("shapes_b").isNull(), 0.0).otherwise(total).alias("similarity"))


def unordered_pairs(table: DataFrame, col: str) -> DataFrame:
    """(a, b), a < b, of the distinct values of a small dimension, each value being a stated query against all."""
    v = table.select(F.col(col).alias("a")).where("a is not null").distinct()
    return v.join(v.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
