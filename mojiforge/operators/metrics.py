"""Scores of corrections: sentence, character and token level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiforge.functions.text import chars, let
from mojiforge.operators.align import edits


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column, digits: int = 4) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.round(2 * p * r / (p + r), digits))


def sentence_scores(rows: DataFrame) -> DataFrame:
    """One row of sentence-level counts and scores of ``rows(source, target, pred)``."""
    wrong, changed = F.col("source") != F.col("target"), F.col("source") != F.col("pred")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = rows.agg(one(changed).alias("pred_num"), one(wrong).alias("ref_num"), one(wrong & (F.col("pred") == F.col("target"))).alias("hit_num"))
    sums = sums.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in sums.columns])
    sums = sums.withColumn("precision", ratio(F.col("hit_num"), F.col("pred_num"))).withColumn("recall", ratio(F.col("hit_num"), F.col("ref_num")))
    return sums.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def character_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, ref, pred, detect, correct) of rows whose three texts have one length."""
    s, t, p = chars(F.col("source")), chars(F.col("target")), chars(F.col("pred"))
    count = lambda f: F.size(F.filter(F.zip_with(F.zip_with(s, t, lambda a, b: F.struct(a.alias("s"), b.alias("t"))), p, lambda x, c: F.struct(x["s"].alias("s"), x["t"].alias("t"), c.alias("p"))), f)).cast("long")
    same = (F.char_length("source") == F.char_length("target")) & (F.char_length("source") == F.char_length("pred"))
    return rows.where(same).select(
        key,
        count(lambda x: x["s"] != x["t"]).alias("ref"),
        count(lambda x: x["s"] != x["p"]).alias("pred"),
        count(lambda x: (x["s"] != x["t"]) & (x["s"] != x["p"])).alias("detect"),
        count(lambda x: (x["s"] != x["t"]) & (x["p"] == x["t"])).alias("correct"),
    )


def character_scores(rows: DataFrame, key: str) -> DataFrame:
    """Detection and correction precision, recall (rounded first) and F1 over all characters."""
    sums = character_counts(rows, key).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("ref", "pred", "detect", "correct")])
    for kind in ("detect", "correct"):
        sums = sums.withColumn(f"{kind}_p", F.round(ratio(F.col(kind), F.col("pred")), 4)).withColumn(f"{kind}_r", F.round(ratio(F.col(kind), F.col("ref")), 4))
        sums = sums.withColumn(f"{kind}_f1", f1(F.col(f"{kind}_p"), F.col(f"{kind}_r")))
    return sums


def character_errors(rows: DataFrame, key: str) -> DataFrame:
    """(key, char_index, type, src_char, trg_char, pred_char): misses, false alarms and wrong fixes of rows of one length."""
    same = (F.char_length("source") == F.char_length("target")) & (F.char_length("source") == F.char_length("pred"))
    zipped = F.arrays_zip(chars(F.col("source")).alias("s"), chars(F.col("target")).alias("t"), chars(F.col("pred")).alias("p"))
    x = rows.where(same).select(key, F.posexplode(zipped).alias("char_index", "x")).select(key, F.col("char_index").cast("long").alias("char_index"), F.col("x.s").alias("src_char"), F.col("x.t").alias("trg_char"), F.col("x.p").alias("pred_char"))
    kind = (
        F.when((F.col("src_char") != F.col("trg_char")) & (F.col("pred_char") == F.col("src_char")), "miss")
        .when((F.col("src_char") == F.col("trg_char")) & (F.col("pred_char") != F.col("src_char")), "false alarm")
        .when((F.col("src_char") != F.col("trg_char")) & (F.col("pred_char") != F.col("trg_char")), "wrong fix")
    )
    return x.withColumn("type", kind).where("type is not null")


def token_counts(rows: DataFrame) -> DataFrame:
    """One row of detection and correction counts by edit keys: hits are sets, totals are lists."""
    x = rows.select(edits(F.col("source"), F.col("target")).alias("r"), edits(F.col("source"), F.col("pred")).alias("p"))
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return x.agg(
        total("r.detect").alias("detect_ref"), total("p.detect").alias("detect_pred"), total(F.array_intersect("r.detect", "p.detect")).alias("detect_hit"),
        total("r.correct").alias("correct_ref"), total("p.correct").alias("correct_pred"), total(F.array_intersect("r.correct", "p.correct")).alias("correct_hit"),
    )


def token_scores(rows: DataFrame) -> DataFrame:
    """Token-level scores: four fifths detection and one fifth correction."""
    out = token_counts(rows)
    for kind in ("detect", "correct"):
        p = F.when(F.col("detect_pred") == 0, 0.0).otherwise(F.col(f"{kind}_hit") / F.greatest(F.col(f"{kind}_pred"), F.lit(1)))
        r = F.when(F.col("detect_ref") == 0, 0.0).otherwise(F.col(f"{kind}_hit") / F.greatest(F.col(f"{kind}_ref"), F.lit(1)))
        out = out.withColumn(f"{kind}_p", p).withColumn(f"{kind}_r", r).withColumn(f"{kind}_f1", f1(p, r))
    return out.withColumn("token_f1", 0.8 * F.col("detect_f1") + 0.2 * F.col("correct_f1"))


def final_scores(rows: DataFrame) -> DataFrame:
    """Token-level and sentence-level F1 and their final combination."""
    s = sentence_scores(rows).select(F.col("f1").alias("sentence_f1"), F.lit(1).alias("one"))
    t = token_scores(rows).withColumn("one", F.lit(1))
    return t.join(s, "one").drop("one").withColumn("final_f1", F.round(0.8 * F.col("token_f1") + 0.2 * F.col("sentence_f1"), 4))


def smoothed_loss(logits: Column, gold: Column, smoothing: float = 0.1) -> Column:
    """Label-smoothing cross entropy of one position: (1 - s) of the gold class, s spread over all."""
    log_sum = lambda z: F.log(F.aggregate(z["x"], F.lit(0.0), lambda s, x: s + F.exp(x - z["m"]))) + z["m"]
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + x) / F.size(logits)
    norm = let(F.struct(logits.alias("x"), F.array_max(logits).alias("m")), log_sum)
    return -(1 - smoothing) * (F.get(logits, gold) - norm) - smoothing * (total - norm)


IGNORED = -100


def mean_loss(rows: DataFrame, logits: Column, gold: Column, smoothing: float = 0.1) -> DataFrame:
    """The mean smoothed loss over the places whose gold tag isn't IGNORED."""
    kept = rows.where((gold != IGNORED) & gold.isNotNull())
    return kept.agg(F.avg(smoothed_loss(logits, gold, smoothing)).alias("loss"))


def tag_scores(rows: DataFrame, keep: int = 0) -> DataFrame:
    """Character-level scores of ``rows(row, gold, pred)``, arrays of tag ids in which ``keep`` means no error; IGNORED places don't count."""
    z = F.filter(F.arrays_zip(F.col("gold").alias("g"), F.col("pred").alias("p")), lambda x: x["g"] != IGNORED)
    count = lambda f: F.coalesce(F.sum(F.size(F.filter(z, f))), F.lit(0)).cast("long")
    sums = rows.agg(
        count(lambda x: x["g"] != keep).alias("ref"), count(lambda x: x["p"] != keep).alias("pred"),
        count(lambda x: (x["g"] != keep) & (x["p"] != keep)).alias("detect"), count(lambda x: (x["g"] != keep) & (x["p"] == x["g"])).alias("correct"),
    )
    for kind in ("detect", "correct"):
        sums = sums.withColumn(f"{kind}_p", F.round(ratio(F.col(kind), F.col("pred")), 4)).withColumn(f"{kind}_r", F.round(ratio(F.col(kind), F.col("ref")), 4))
        sums = sums.withColumn(f"{kind}_f1", f1(F.col(f"{kind}_p"), F.col(f"{kind}_r")))
    return sums
