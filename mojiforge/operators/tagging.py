"""Scoring with pluggable taggers: soft-max, ensembles, top labels, iterative correction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiforge.functions.text import let


def softmax(logits: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
    shares = lambda e: let(F.struct(e.alias("e"), total(e).alias("t")), lambda z: F.transform(z["e"], lambda x: x / z["t"]))
    powers = lambda z: F.transform(z["x"], lambda x: F.exp(x - z["m"]))
    return let(F.struct(logits.alias("x"), F.array_max(logits).alias("m")), lambda z: let(powers(z), shares))


def top_labels(probabilities: Column, k: int) -> Column:
    """The k most probable classes as (p, label) structs, of equals the smaller class first."""
    placed = F.transform(probabilities, lambda p, i: F.struct((-p).alias("n"), i.alias("label")))
    return F.transform(F.slice(F.array_sort(placed), 1, k), lambda x: F.struct((-x["n"]).alias("p"), x["label"].alias("label")))


def argmax(values: Column) -> Column:
    return F.get(top_labels(values, 1), F.lit(0))["label"]


def keep_bias(probabilities: Column, bias: float) -> Column:
    """Adds a constant to the keep label's probability (class 0)."""
    return F.transform(probabilities, lambda p, i: F.when(i == 0, p + bias).otherwise(p))


def weighted_mean(probabilities: list[Column], weights: list[float] | None = None) -> Column:
    """The models' probabilities averaged; models without a weight don't count, though all weights divide."""
    w = weights or [1.0] * len(probabilities)
    total = sum(w)
    scaled = lambda p, v: F.transform(p, lambda x: x * v / total)
    parts = [scaled(p, v) for p, v in zip(probabilities, w)]
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def ensemble(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(row, pos, label, p) of ``rows(row, pos, label, p, model)``: weighted means over ``weights(model, w)``."""
    total = weights.agg(F.sum("w").alias("total"))
    x = rows.join(F.broadcast(weights), "model").groupBy("row", "pos", "label").agg(F.sum(F.col("p") * F.col("w")).alias("s"))
    return x.join(F.broadcast(total)).select("row", "pos", "label", (F.col("s") / F.col("total")).alias("p"))


def decode_labels(rows: DataFrame, id_col: str, vocabulary: DataFrame, ignored: int = -100) -> DataFrame:
    """``rows`` with a column ``tag``: the tag of each id by ``vocabulary(id, tag)``; the ignored id stays as it is, unknown ones are null."""
    v = vocabulary.select(F.col("id").alias(id_col), "tag")
    out = rows.join(v, id_col, "left")
    return out.withColumn("tag", F.when(F.col(id_col) == ignored, F.lit(str(ignored))).otherwise(F.col("tag")))


def predict(rows: DataFrame, key: str, tokens: str, logits: list[str], vocabulary: DataFrame, weights: list[float] | None = None, bias: float = 0.0, k: int = 1) -> DataFrame:
    """(key, pos, token, rank, tag, p): the k most probable tags of every token.

    ``logits``: one column for each model, an array for each place of an array
    over the tags; place 0 is the start token's and is dropped.  Soft-max, the
    models' weighted mean and the keep bias come before the choice; of equal
    probabilities the smaller id comes first.  Places without a token or
    tokens without a place are left out, null rows as well.
    """
    at = rows.select(key, tokens, *logits, F.posexplode(tokens).alias("pos", "token"))
    mean = weighted_mean([softmax(F.get(F.col(c), F.col("pos") + 1)) for c in logits], weights)
    best = at.where(F.get(F.col(logits[0]), F.col("pos") + 1).isNotNull()).select(key, "pos", "token", F.posexplode(top_labels(keep_bias(mean, bias), k)).alias("rank", "t"))
    tagged = decode_labels(best.select(key, "pos", "token", (F.col("rank") + 1).alias("rank"), F.col("t.label").alias("label"), F.col("t.p").alias("p")), "label", vocabulary)
    return tagged.select(key, "pos", "token", "rank", "tag", "p")


def correct_until_stable(rows: DataFrame, key: str, text_col: str, tagger: Callable[[list[str]], list[str]], rounds: int) -> DataFrame:
    """(key, corrected, n_rounds): applies a batch corrector up to ``rounds`` times to the texts that still change.

    A text that comes back to an earlier form takes it and stops.  The rounds
    run inside one task for each batch, so no lineage grows.
    """
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = list(f["text"])
            seen = [{t} for t in texts]
            count = [0] * len(texts)
            active = [i for i, t in enumerate(texts) if t is not None]
            for _ in range(rounds):
                if not active:
                    break
                again = []
                for i, new in zip(active, tagger([texts[i] for i in active])):
                    if new != texts[i]:
                        texts[i] = new
                        count[i] += 1
                        if new not in seen[i]:
                            seen[i].add(new)
                            again.append(i)
                active = again
            yield pd.DataFrame({"key": f["key"], "corrected": texts, "n_rounds": count})

    return rows.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInPandas(run, f"key {kind}, corrected string, n_rounds int").withColumnRenamed("key", key)


def rule_tagger(rules: list[tuple[str, str]]) -> Callable[[list[str]], list[str]]:
    """A deterministic stand-in for a model: each pass applies the first rule that occurs, once."""

    def run(texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            hit = next(((a, b) for a, b in rules if a in t), None)
            out.append(t.replace(*hit, 1) if hit else t)
        return out

    return run
