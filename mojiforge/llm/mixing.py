"""Mixing sources to target weights by iterative proportional fitting.

Token sums of the cells (source, language, topic) are raked to the target
shares of the sources and to the natural shares of languages and topics; a
cell's factor is the expected number of uses of each of its documents, at most
the source's cap.  Systematic sampling along each source, ordered by length,
turns the expectations into whole repeats whose token sums stay close to the
targets.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mojiforge.session import settle

BUCKET_ROWS = 100_000
NONE = ""


def rake(tokens: np.ndarray, share: np.ndarray, cap: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Expected uses of each cell of ``tokens[source, language, topic]``.

    Each source aims at its share of as many tokens as all sources hold
    together; one that cannot reach it within its cap is used as often as the
    cap allows, and the total falls short by what it lacks.  Languages and topics are raked to their natural shares as
    far as the caps allow; the last step of each round restores the sources'
    shares by spreading what the cap cuts off over the source's other cells.
    Margins that the caps make impossible leave it moving; then it warns.
    """
    total = tokens.sum()
    own = tokens.sum((1, 2))
    live = (own > 0) & (share > 0)
    if not live.any():
        return np.zeros_like(tokens)
    target = np.minimum(np.where(live, share, 0) / share[live].sum() * total, cap * own)
    goal = target.sum()
    lang, topic = (tokens.sum(axes) / total * goal for axes in ((0, 2), (0, 1)))
    top = cap[:, None, None]
    w = np.ones_like(tokens)

    def to_sources(w: np.ndarray) -> np.ndarray:
        for _ in range(50):
            w = np.minimum(w, top)
            free = (w < top) & (tokens > 0)
            fixed, rest = (np.where(free, 0, w) * tokens).sum((1, 2)), (np.where(free, w, 0) * tokens).sum((1, 2))
            f = np.divide(target - fixed, rest, out=np.ones_like(rest), where=rest > 0)
            w = np.where(free, w * np.maximum(f, 0)[:, None, None], w)
            if (w <= top + 1e-12).all():
                break
        return np.minimum(w, top)

    w = to_sources(w)
    for _ in range(rounds):
        before = w
        now = (w * tokens).sum((0, 2))
        w = w * np.divide(lang, now, out=np.ones_like(now), where=now > 0)[None, :, None]
        now = (w * tokens).sum((0, 1))
        w = w * np.divide(topic, now, out=np.ones_like(now), where=now > 0)[None, None, :]
        w = to_sources(w)
        if (moved := np.abs(w - before).max()) < tolerance:
            break
    else:
        warnings.warn(f"the mix has not converged after {rounds} rounds: uses still move by {moved:.2g}", stacklevel=2)
    return w


def mix_sources(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, repeats) of the documents used.

    ``docs(doc_id, source, lang, topic, n_tokens)``, ``targets(source,
    target_share, max_repeats)``.  Documents of sources that aren't listed, of
    null source or without tokens aren't used; null languages and topics are
    values of their own.  Of a source listed twice the first by share counts.
    The cells' token sums, one row for each combination of the three
    dimensions' values, are fitted on the driver.
    """
    spark = docs.sparkSession
    want = {}
    for r in sorted(targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").collect(), reverse=True):
        want[r.source] = (float(r.target_share), int(r.max_repeats))
    names = sorted(want)
    docs = docs.select("doc_id", "source", F.coalesce("lang", F.lit(NONE)).alias("lang"), F.coalesce("topic", F.lit(NONE)).alias("topic"), "n_tokens")
    docs = docs.where(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")).collect()
    langs, topics = sorted({r.lang for r in cells}), sorted({r.topic for r in cells})
    tokens = np.zeros((len(names), len(langs), len(topics)))
    for r in cells:
        tokens[names.index(r.source), langs.index(r.lang), topics.index(r.topic)] = r.n
    w = rake(tokens, np.array([want[n][0] for n in names]), np.array([float(want[n][1]) for n in names])) if cells else tokens
    rows = [(r.source, r.lang, r.topic, float(w[names.index(r.source), langs.index(r.lang), topics.index(r.topic)]), want[r.source][1]) for r in cells]
    fitted = spark.createDataFrame(rows, "source string, lang string, topic string, uses double, cap int")
    # Order within a source: classes of length, split by hash so that no bucket grows with the data.
    size = F.floor(F.log2("n_tokens") * 8).cast("int")
    placed = docs.join(F.broadcast(fitted), ["source", "lang", "topic"]).withColumn("size", size)
    strata = placed.groupBy("source", "size").agg(F.count("*").alias("n"))
    placed = placed.join(F.broadcast(strata), ["source", "size"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long")).drop("n")
    placed = settle(placed)
    sums = placed.groupBy("source", "size", "part").agg(F.sum("uses").alias("whole"))
    before = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "size", "part", F.coalesce(F.sum("whole").over(before), F.lit(0.0)).alias("offset"))
    inside = Window.partitionBy("source", "size", "part").orderBy("n_tokens", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(sums, ["source", "size", "part"]).withColumn("upto", F.col("offset") + F.sum("uses").over(inside) + 0.5)
    repeats = F.least(F.floor(F.col("upto") + 1e-9) - F.floor(F.col("upto") - F.col("uses") + 1e-9), F.col("cap")).cast("int")
    none = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return placed.withColumn("repeats", repeats).where("repeats > 0").select("doc_id", "source", none("lang"), none("topic"), "n_tokens", "repeats")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_repeats, tokens, actual_share) of every listed source."""
    got = mix.groupBy("source").agg(F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left")
    out = out.select("source", "target_share", "max_repeats", zero("documents", "long"), zero("most_repeats", "int"), zero("tokens", "long"))
    return out.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
