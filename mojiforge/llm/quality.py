"""Statistics of each document's text, and telling natural prose from lists, tables and junk.

Statistics are column expressions; the verdict is an ordered list of rules
over them, induced from labelled documents by incremental reduced-error
pruning (``induce``) and exported as one SQL CASE expression.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mojiforge.llm.textforms import DROP, INVISIBLE, LOOK_ALIKES

RULES = Path(__file__).with_name("quality_rules.json")
MAX_WORDS = 10_000
# Common words that lists of things hold as well, so that they say nothing about clauses.
WEAK = frozenset(["的", "和", "里", "और", "の", "と", "und", "and", "of"])
SPACED = frozenset(["en", "de", "hi"])
STATISTICS = (
    "n_chars", "n_lines", "mean_line", "n_words", "mean_word", "longest_word", "letter_ratio", "han_ratio", "digit_ratio", "symbol_ratio", "space_ratio",
    "separator_ratio", "ending_lines", "clause_share", "common_ratio", "variety", "marks_ratio",
)


def word_patterns(words: list[tuple[str, str]]) -> tuple[str, str]:
    """(common words, those that mark a clause) as patterns, from (lang, word) rows."""
    if len(words) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} common words")

    def pattern(kept: list[tuple[str, str]]) -> str:
        whole = sorted({re.escape(w) for lang, w in kept if lang in SPACED}, key=lambda w: (-len(w), w))
        part = sorted({re.escape(w) for lang, w in kept if lang not in SPACED}, key=lambda w: (-len(w), w))
        ends = r"[^\p{L}\p{M}]"
        return "|".join([f"(?i:(?<={ends}|^)(?:{'|'.join(whole)})(?={ends}|$))"] * bool(whole) + part) or "$^"

    return pattern(words), pattern([x for x in words if x[1] not in WEAK])


def plain(text: Column) -> Column:
    """Half width, Latin look-alikes, no invisible characters: a near native stand-in for the displayed form."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    half = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    alike = {a: b for a, b in LOOK_ALIKES.items() if len(a) == len(b) == 1}
    folded = F.translate(text, wide + "　｡､" + "".join(alike), half + " 。、" + "".join(alike.values()))
    return F.regexp_replace(F.regexp_replace(folded, r"\p{Cf}|[︀-️]", ""), r"\r\n?", "\n")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once for each row, however often later expressions and filters use them."""
    name = "__" + "_".join(columns)
    made = rows.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias(name))
    return made.select(*rows.columns, *[F.col(f"{name}.{k}").alias(k) for k in columns])


def _prepared(df: DataFrame, text_col: str, words: list[tuple[str, str]]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with the columns __t, __lines, __n and __variety, and the statistics as expressions over them."""
    common, clause = word_patterns(words)
    t = F.col("__t")
    rows = _once(df, __t=plain(F.col(text_col)))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    # Characters of a class: what is lost without their runs, which takes one match for each run.
    share = lambda p: (F.length(t) - F.length(F.regexp_replace(t, f"{p}+", ""))).cast("double")
    spaces = share(r"(?U)\s")
    n = F.greatest(F.length(t) - spaces, F.lit(1.0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
    width = lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", ""))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + width(x))
    closing = r"[。.!?…।][”」』\")）\]]*\s*$"
    barred = r"\t|\|.*\||</t[dr]>|   "  # fields of a table
    prose = lambda x: (x.rlike(clause) | x.rlike(closing)) & ~x.rlike(barred) & ~x.rlike(r"(.{2,40}?)\1{3,}")
    n_words = F.greatest(count(r"[\p{L}\p{M}\p{N}]+"), F.lit(1.0))
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    variety = F.log(F.greatest(F.size(F.array_distinct(F.split(t, ""))), F.lit(2)).cast("double")) / F.log(F.col("__n") + 2)
    rows = _once(rows, __lines=lines, __n=n)
    n = F.col("__n")
    return rows, {
        "n_chars": n,
        "n_lines": n_lines,
        "mean_line": n / n_lines,
        "n_words": n_words,
        "mean_word": share(r"[\p{L}\p{M}\p{N}]") / n_words,
        "longest_word": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{M}\p{N}+/=&#;]{24,}"), 0), lambda x: F.length(x))), F.lit(0)).cast("double"),
        "letter_ratio": share(r"[\p{L}\p{M}]") / n,
        "han_ratio": share(r"\p{IsHan}") / n,
        "digit_ratio": share(r"\p{N}") / n,
        "symbol_ratio": share(r"[\p{S}\p{Cc}&&[^\n\t\r]]") / n,
        "space_ratio": spaces / (n + spaces),
        "separator_ratio": share(r"[\t|/>#、;<=,&]") / n,
        "ending_lines": F.size(F.filter("__lines", lambda x: x.rlike(closing))) / n_lines,
        "clause_share": total(F.filter("__lines", prose)) / n,
        "common_ratio": count(common) / n,
        "variety": variety,
        "marks_ratio": count(r"[。!?…।.][^\p{N}a-z]|[。.!?…।]$") / n,
    }


def statistics(df: DataFrame, text_col: str, words: list[tuple[str, str]], names: tuple[str, ...] = STATISTICS) -> DataFrame:
    """``df`` with a column ``q`` holding a struct of STATISTICS (or of those in ``names``), all double; null for null, empty and blank texts.

    Ratios are of the characters that aren't white space (``space_ratio``: of
    all).  ``clause_share``: those in lines with a clause-marking word or a
    closing mark, runs of repetition left out; ``variety``: logarithm of the
    distinct characters over that of all.
    """
    rows, values = _prepared(df, text_col, words)
    q = F.struct(*[values[k].cast("double").alias(k) for k in names])
    return _once(rows, q=F.when(F.col("__t").rlike(r"(?U)\S"), q)).drop("__t", "__lines", "__n")


# --- rules ---------------------------------------------------------------------------------------------------------------------------

Rule = list[tuple[int, bool, float]]  # (statistic, at most, threshold), all to hold


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, low, cut in rule:
        out &= x[:, k] <= cut if low else x[:, k] > cut
    return out


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Adds the condition of the largest FOIL gain until only positives are covered."""
    rule: Rule = []
    while y.any() and not y.all() and len(rule) < 6:
        p0, n0 = y.sum(), (~y).sum()
        base = np.log2(p0 / (p0 + n0))
        best = (1e-9, None)
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, pos = x[order, k], np.cumsum(y[order])
            every = np.arange(1, len(v) + 1)
            edges = np.flatnonzero(v[1:] > v[:-1])
            for low, p, n in ((True, pos[edges], every[edges]), (False, p0 - pos[edges], len(v) - every[edges])):
                if len(edges):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - base), 0)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (k, low, float((v[edges[i]] + v[edges[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        keep = _covers([best[1]], x)
        x, y = x[keep], y[keep]
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The beginning of the rule that does best on the pruning set, by (p - n) / (p + n)."""
    worth = []
    for k in range(1, len(rule) + 1):
        c = _covers(rule[:k], x)
        p, n = (y & c).sum(), (~y & c).sum()
        worth.append((p - n) / (p + n) if p + n else -1)
    return rule[: int(np.argmax(worth)) + 1] if worth else rule


def induce(x: np.ndarray, y: np.ndarray, seed: int = 7, most_rules: int = 24) -> list[Rule]:
    """An ordered list of rules for the positive class: each is grown on two
    thirds of what is left, pruned on the rest, and kept while it errs on less
    than half of the pruning set it covers."""
    rng, rules = np.random.default_rng(seed), []
    x, y = np.asarray(x, float), np.asarray(y, bool)
    while y.any() and len(rules) < most_rules:
        grow = rng.random(len(y)) < 2 / 3
        if not y[grow].any() or not y[~grow].any():
            break
        rule = _prune(_grow(x[grow], y[grow]), x[~grow], y[~grow])
        c = _covers(rule, x[~grow])
        if not rule or not c.any() or y[~grow][c].mean() < 0.5:
            break
        rules.append(rule)
        left = ~_covers(rule, x)
        x, y = x[left], y[left]
    return rules


def verdict_sql(rules: list[list[list]], column: str = "q") -> str:
    """The rules as a CASE expression: true where a text is no prose, null where it has no statistics."""
    whens = " ".join(f"WHEN {' AND '.join(f'{column}.{name} {op} {cut!r}' for name, op, cut in rule)} THEN true" for rule in rules)
    return f"CASE WHEN {column} IS NULL THEN NULL {whens} ELSE false END"


def verdict(rules: list[list[list]], values: dict[str, Column], known: Column) -> Column:
    """The same CASE over the expressions themselves: a statistic is computed only where the rules before it leave the text open."""
    out = F.when(~known, F.lit(None).cast("boolean"))
    for rule in rules:
        holds = None
        for name, op, cut in rule:
            one = values[name] <= cut if op == "<=" else values[name] > cut
            holds = one if holds is None else holds & one
        out = out.when(holds, True)
    return out.otherwise(False)


def load_rules(path: Path = RULES) -> list[list[list]]:
    return json.loads(path.read_text())["rules"]


def not_prose(df: DataFrame, text_col: str, words: list[tuple[str, str]], names: tuple[str, ...] | None = None) -> DataFrame:
    """``statistics`` and a column ``no_prose``: whether the text is, by more than half, no natural prose; null for null and blank texts.

    Without ``names`` there is no ``q``, and a statistic is computed only where
    the rules ask for it.
    """
    rules = load_rules()
    if names is None:
        rows, values = _prepared(df, text_col, words)
        known = F.coalesce(F.col("__t").rlike(r"(?U)\S"), F.lit(False))
        return _once(rows, no_prose=verdict(rules, values, known)).drop("__t", "__lines", "__n")
    asked = tuple(k for k in STATISTICS if k in names or any(k == c[0] for r in rules for c in r))
    return statistics(df, text_col, words, asked).withColumn("no_prose", F.expr(verdict_sql(rules)))
