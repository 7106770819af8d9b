"""Whole-dataset operations: quality gates, splits, shards, samples, coverage and leakage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mojiforge.functions.text import is_sentence_ok
from mojiforge.operators.align import align_labels
from mojiforge.operators.dictionaries import line_ids
from mojiforge.operators.segment import character_ids, sentinel

EDGE_ROWS = 100_000
BLOCK_CHARS = 1 << 22


def clean_gec(pairs: DataFrame, min_len: int = 10) -> DataFrame:
    """``pairs(src, aug, ...)`` whose right side is an ok sentence."""
    return pairs.where(is_sentence_ok(F.col("src"), min_len))


def clean_csc(pairs: DataFrame) -> DataFrame:
    """``pairs(src, aug, ...)`` with sides of one length."""
    return pairs.where(F.char_length("src") == F.char_length("aug"))


def pass_rate(rows: DataFrame, ok: Column, by: list[str]) -> DataFrame:
    """(by, total, passed, rate); a null verdict counts as failed."""
    good = F.sum(F.when(ok, 1).otherwise(0)).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("total"), good.alias("passed")).withColumn("rate", F.col("passed") / F.col("total"))


def shards(rows: DataFrame, order: list[str], number: int, keep_rest: bool) -> DataFrame:
    """``rows`` with a ``shard``: equal runs in order; what is left over joins the last shard or is dropped."""
    size = F.lit(rows.count() // number)
    numbered = line_ids(rows, order)
    if keep_rest:
        shard = F.when(size == 0, number - 1).otherwise(F.least(F.floor(F.col("line") / size), F.lit(number - 1)))
        return numbered.withColumn("shard", shard.cast("long")).drop("line")
    return numbered.where(F.col("line") < size * number).withColumn("shard", F.floor(F.col("line") / size).cast("long")).drop("line")


def dev_split(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """``rows`` with ``is_dev``: exactly max(int(n * share), 1) rows, chosen by hash of the key.

    The cut is found from counts of hash buckets, each level dividing the
    bucket of the cut by 4096, until EDGE_ROWS rows or fewer are left to put
    in order; no task sorts more.  Rows of one key stay on one side.
    """
    want = max(int(rows.count() * share), 1)
    hashed = rows.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    seen, cut, size = 0, "", None
    while len(cut) < 32 and (size is None or size > EDGE_ROWS):
        inside = hashed.where(F.startswith("__h", F.lit(cut)))
        for r in inside.groupBy(F.substring("__h", 1, len(cut) + 3).alias("b")).count().orderBy("b").collect():  # 4096 rows at most
            if seen + r["count"] >= want:
                cut, size = r["b"], r["count"]
                break
            seen += r["count"]
        else:
            return hashed.withColumn("is_dev", F.lit(True)).drop("__h")
    if len(cut) == 32:  # more rows than EDGE_ROWS have this one key
        return hashed.withColumn("is_dev", F.col("__h") <= cut).drop("__h")
    last = max(r["__h"] for r in hashed.where(F.startswith("__h", F.lit(cut))).select("__h").orderBy("__h").limit(want - seen).collect())
    return hashed.withColumn("is_dev", F.col("__h") <= last).drop("__h")


def label_coverage(current: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """One row: rows of ``current`` (repeated ones count), how many are in ``known``, and the ratio."""
    k = known.select(col).distinct().withColumn("__hit", F.lit(1))
    out = current.select(col).join(k, col, "left").agg(F.count("*").alias("total"), F.count("__hit").alias("covered"))
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.col("covered") / F.col("total")))


def uncovered(current: DataFrame, known: DataFrame, col: str) -> DataFrame:
    return current.join(known.select(col).distinct(), col, "left_anti")


def without_labels(rows: DataFrame, key: str, labels: str, unwanted: DataFrame, col: str) -> DataFrame:
    """Rows none of whose labels is unwanted; rows without labels stay."""
    bad = rows.select(key, F.explode(labels).alias(col)).join(unwanted.select(col).distinct(), col, "left_semi").select(key).distinct()
    return rows.join(bad, key, "left_anti")


class QueryBlock:
    """An inverted index of some texts' characters: the k-th occurrence of a character is a token of its own,
    so the tokens that two texts share are what their character multisets share."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids, self.sizes = ids, np.array([len(t) for t in texts], np.int64)
        own, token = self.tokens(texts)
        order = np.argsort(token, kind="stable")
        self.token, first = np.unique(token[order], return_index=True)
        self.own, self.bounds = own[order], np.append(first, len(order))

    @staticmethod
    def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, token) of every character."""
        a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        order = np.lexsort((a, own))
        a, own = a[order], own[order]
        begins = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (own[1:] != own[:-1])])) if len(a) else np.zeros(0, np.int64)
        nth = np.arange(len(a)) - np.repeat(begins, np.diff(begins, append=len(a)))
        return own, (nth << 21) | a

    def ratios(self, texts: list[str]) -> np.ndarray:
        """The multiset ratio of each text (a row) with each of the block's texts, rounded; 0 for two empty ones."""
        own, token = self.tokens(texts)
        at = np.searchsorted(self.token, token)
        at[at == len(self.token)] = 0
        hit = np.flatnonzero(self.token[at] == token) if len(self.token) else np.zeros(0, np.int64)
        at, own = at[hit], own[hit]
        n = self.bounds[at + 1] - self.bounds[at]
        place = np.repeat(self.bounds[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(np.repeat(own, n) * len(self.ids) + self.own[place], minlength=len(texts) * len(self.ids)).reshape(len(texts), -1)
        whole = np.array([len(t) for t in texts], np.int64)[:, None] + self.sizes[None, :]
        return np.round(2.0 * common / np.maximum(whole, 1), 6)


def most_similar(left: DataFrame, right: DataFrame, top: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``top`` most similar pairs (a_id, b_id, ratio) of ``left(a_id, a)`` and ``right(b_id, b)`` by multiset ratio; ties by the ids.

    ``left`` is the stated query set.  It is cut into blocks of about
    ``block_chars`` characters, each of which is broadcast as an inverted
    index and passes over all right rows where they lie: no row is moved, each
    task keeps its best pairs, and the tasks are those of the right scan.
    Null ids and texts are in no pair; repeated rows count each.
    """
    spark = left.sparkSession
    left, right = left.select("a_id", "a").where("a_id is not null and a is not null"), right.select("b_id", "b").where("b_id is not null and b is not null")
    chars = left.agg(F.sum(F.char_length("a") + 1)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    kinds = f"a_id {dict(left.dtypes)['a_id']}, b_id {dict(right.dtypes)['b_id']}, ratio double"
    best = None
    for k in range(blocks):
        rows = left.where(F.pmod(F.xxhash64("a_id", "a"), F.lit(blocks)) == k).collect()
        block = spark.sparkContext.broadcast(QueryBlock([r.a_id for r in rows], [r.a for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            q, found = block.value, []
            each = max(1, (1 << 22) // max(1, len(q.ids)))
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(ids) if q.ids else 0, each):
                    r = q.ratios(texts[at : at + each])
                    least = max(np.partition(r, r.size - top, axis=None)[r.size - top] if r.size > top else -1.0, -found[-1][0] if len(found) == top else -1.0)
                    found += [(-float(r[i, j]), q.ids[j], ids[at + i]) for i, j in zip(*np.nonzero(r >= least))]
                    found = sorted(found)[:top]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found]), pa.array([f[2] for f in found]), pa.array([-f[0] for f in found])], ["a_id", "b_id", "ratio"])

        part = right.mapInArrow(run, kinds)
        best = part if best is None else best.unionByName(part)
    return best.orderBy(F.desc("ratio"), "a_id", "b_id").limit(top)


def steps(rows: int, batch: int, nodes: int = 1) -> int:
    """Training steps of an epoch: the batches, dealt to the nodes, each rounded up."""
    return -(-(-(-rows // batch)) // nodes)


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int, shards: int) -> DataFrame:
    """``rows`` shuffled into ``shard`` and ``pos`` inside it, by a hash that changes with the epoch; the same for the same seed."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed + epoch)), F.col(key).cast("string")))
    dealt = rows.withColumn("__h", h).withColumn("shard", F.pmod(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long"), F.lit(shards)))
    inside = Window.partitionBy("shard").orderBy("__h", key)
    return dealt.withColumn("pos", (F.row_number().over(inside) - 1).cast("long")).drop("__h")


def best_so_far(scores: list[float], patience: int) -> tuple[int, float]:
    """(rounds done, best score): stops after ``patience`` rounds without a better score; a better one starts the count again."""
    best, bad = float("-inf"), 0
    for k, s in enumerate(scores, 1):
        best, bad = (s, 0) if s > best else (best, bad + 1)
        if bad >= patience:
            return k, best
    return len(scores), best


def training_examples(pairs: DataFrame, key: str, labels: DataFrame, tokens: DataFrame, max_len: int = 128, sign: str = "始", ignored: int = -100) -> DataFrame:
    """(key, input_ids, attention_mask, tags) of ``pairs(key, source, target)``, all of ``max_len`` places.

    ``labels(label, label_id)`` and ``tokens(token, id)`` are the vocabularies;
    ``labels`` holds [REPLACE_UNK], [APPEND_UNK] and $KEEP, which unknown
    labels of each family fall back to.  The source gets a start sign and is
    cut to what fits between the special places; these and the padding have
    the ignored tag.  Null sides make no example; keys must be unique.
    """
    rows = pairs.where("source is not null and target is not null").select(key, "source", "target", sentinel(F.col("source"), sign, max_len).alias("text"))
    each = rows.select(key, F.char_length("text").alias("n"), F.posexplode(align_labels(F.col("source"), F.col("target"))).alias("pos", "label")).where("pos < n")
    family = F.when(F.startswith("label", F.lit("$REPLACE")), "[REPLACE_UNK]").when(F.startswith("label", F.lit("$APPEND")), "[APPEND_UNK]").otherwise("$KEEP")
    known = each.join(labels.select("label", "label_id"), "label", "left")
    other = labels.select(F.col("label").alias("__family"), F.col("label_id").alias("__other")).where(F.col("__family").isin("[REPLACE_UNK]", "[APPEND_UNK]", "$KEEP"))
    known = known.withColumn("__family", family).join(other, "__family", "left").withColumn("label_id", F.coalesce("label_id", "__other").cast("int"))
    tags = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label_id"))), lambda x: x["label_id"]).alias("tags"))
    blank = F.lit(ignored)
    padded = F.concat(F.array(blank), "tags", F.array_repeat(blank, F.lit(max_len) - 1 - F.size("tags")))
    return character_ids(rows, key, "text", tokens, max_len).join(tags.select(key, padded.alias("tags")), key)


# Kinds of error of the solution files.
DELETED, WRONG, MISSING, SKIPPED = ("冗余", "语义重复"), ("别字",), ("缺失",), ("句式杂糅", "乱序")


def solution_labels(solutions: DataFrame) -> DataFrame:
    """(pid, loc, label) of ``solutions(pid, errors)``; texts with a kind that has no label are left out, unknown kinds fail."""
    e = solutions.select("pid", F.explode("errors").alias("e")).select("pid", "e.*")
    bad = e.where(F.col("typ").isin(*SKIPPED)).select("pid").distinct()
    label = (
        F.when(F.col("typ").isin(*DELETED), F.lit("$DELETE"))
        .when(F.col("typ").isin(*WRONG), F.concat(F.lit("$REPLACE_"), "correct"))
        .when(F.col("typ").isin(*MISSING), F.concat(F.lit("$APPEND_"), "correct"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind "), "typ")).cast("string"))
    )
    return e.join(bad, "pid", "left_anti").select("pid", "loc", label.alias("label"))
