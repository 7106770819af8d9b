"""Frequency dictionaries, confusion sets and look-ups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mojiforge.session import settle


def frequencies(tokens: DataFrame, token_col: str, least: int = 1) -> DataFrame:
    """(token, cnt) of all tokens that occur at least ``least`` times; null and empty ones don't count."""
    rows = tokens.select(F.col(token_col).alias("token")).where("token is not null and token <> ''")
    return rows.groupBy("token").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sums (token, cnt) tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("token").agg(F.sum("cnt").alias("cnt"))


def label_vocabulary(labels: DataFrame, label_col: str, more_than: int) -> DataFrame:
    """(label, cnt) of labels that occur more often than ``more_than``, and the two special ones with null counts."""
    counted = frequencies(labels, label_col).where(F.col("cnt") > more_than).select(F.col("token").alias("label"), "cnt")
    special = labels.sparkSession.createDataFrame([("@@UNKNOWN@@", None), ("@@PADDING@@", None)], "label string, cnt long")
    return counted.unionByName(special)


def word_index(groups: DataFrame) -> DataFrame:
    """(word, gid) of ``groups(gid, words)``: a word of several groups belongs to the last."""
    return groups.select("gid", F.explode("words").alias("word")).groupBy("word").agg(F.max("gid").alias("gid"))


def candidates(words: DataFrame, word_col: str, groups: DataFrame, same_length: bool = False) -> DataFrame:
    """(word, candidates) of the distinct words: the words of the word's group, itself included; null where there is none."""
    w = words.select(F.col(word_col).alias("word")).where("word is not null").distinct()
    found = w.join(word_index(groups), "word", "left").join(groups.select("gid", "words"), "gid", "left")
    list_ = F.filter("words", lambda x: F.char_length(x) == F.char_length("word")) if same_length else F.col("words")
    return found.select("word", F.when(F.size(list_) > 0, F.array_sort(list_)).alias("candidates"))


def buckets(tokens: DataFrame, token_col: str, key: Column) -> DataFrame:
    """(key, tokens): the distinct tokens of each key in order; null keys are left out."""
    rows = tokens.select(key.alias("key"), F.col(token_col).alias("token")).where("key is not null and token is not null").distinct()
    return rows.groupBy("key").agg(F.array_sort(F.collect_list("token")).alias("tokens"))


def merge_fuzzy(table: DataFrame) -> DataFrame:
    """(key, tokens) with the lists of a key with an h as second letter and of the key without its h's joined for both.

    It applies only where both keys exist; lists are read from the input, so joins don't add up.
    """
    fuzzy = table.where(F.col("key").rlike("^[a-z]h")).select(F.col("key").alias("long"), F.replace("key", F.lit("h"), F.lit("")).alias("short"), F.col("tokens").alias("more"))
    pairs = fuzzy.join(table.select(F.col("key").alias("short"), F.col("tokens").alias("base")), "short")
    both = pairs.select("long", "short", F.concat("base", "more").alias("joined"))
    # Several long keys can share a short one: the one that comes last by name counts.
    new = both.select(F.col("long").alias("key"), "joined").unionByName(both.groupBy("short").agg(F.max_by("joined", "long").alias("joined")).select(F.col("short").alias("key"), "joined"))
    new = new.groupBy("key").agg(F.max("joined").alias("joined"))
    return table.join(new, "key", "left").select("key", F.coalesce("joined", "tokens").alias("tokens"))


def merge_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, tokens): the union of both tables' lists of a key, in order."""
    o, n = old.select("key", F.col("tokens").alias("a")), new.select("key", F.col("tokens").alias("b"))
    empty = F.array().cast("array<string>")
    return o.join(n, "key", "full").select("key", F.array_sort(F.array_union(F.coalesce("a", empty), F.coalesce("b", empty))).alias("tokens"))


def with_default(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default: Column) -> DataFrame:
    """``rows`` with ``value`` of the table's row of the key, else the default."""
    t = table.select(F.col(table_key).alias(key), F.col(value))
    return rows.join(t, key, "left").withColumn(value, F.coalesce(F.col(value), default))


def unambiguous_class(words: DataFrame, groups: DataFrame) -> DataFrame:
    """(word, members) of words that belong to exactly one group."""
    one = groups.select("gid", "words", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.first("words").alias("members")).where("n = 1")
    return words.join(one, "word").select("word", F.array_sort("members").alias("members"))


def line_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with a 0-based ``line``: positions come from per-partition offsets, so no task sees all rows.

    Rows are range-partitioned by ``order`` and written once with their place
    in their partition, so that the counts and the rows speak of the same
    partitions whatever adaptive execution makes of either.  The offsets table
    has one row for each partition.  Rows that are equal in ``order`` follow
    one another in any order; an empty table stays empty.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(ranged.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    place = F.col("__m").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn("line", F.col("__offset") + place).drop("__p", "__m", "__offset")


def sound_keys(words: DataFrame, word_col: str, readings: DataFrame, whole_words: bool) -> DataFrame:
    """(word, key): the readings of a word's characters joined by _, by ``readings(char, sound)``; null where a
    character has none, or for a whole word of one character."""
    w = words.select(F.col(word_col).alias("word")).where("word is not null and word <> ''").distinct()
    one = readings.groupBy("char").agg(F.min("sound").alias("sound"))
    each = w.select("word", F.posexplode(F.split("word", "")).alias("pos", "char")).join(one, "char", "left")
    key = each.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("pos", "sound"))).alias("x"))
    known = ~F.exists("x", lambda s: s["sound"].isNull())
    fits = known & (F.size("x") > 1) if whole_words else known
    return key.select("word", F.when(fits, F.array_join(F.transform("x", lambda s: s["sound"]), "_")).alias("key"))


def homophones(chars: DataFrame, char_col: str, readings: DataFrame) -> DataFrame:
    """(char, others): the other characters that share a reading, in order."""
    r = readings.select("char", "sound").distinct()
    c = chars.select(F.col(char_col).alias("char")).distinct().join(r, "char")
    pairs = c.join(r.withColumnRenamed("char", "other"), "sound").where("char <> other")
    return pairs.groupBy("char").agg(F.array_sort(F.collect_set("other")).alias("others"))
