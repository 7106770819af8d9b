"""Learning the prose rules: ``python -m mojiforge.llm.quality_training SF_DIR``.

Labels come from reading each text line by line with patterns that the
statistics don't see (item marks, field separators, code, encodings, runs of
repetition, function words); a text is no prose if more than half of its
characters lie in lines that aren't.  At most SAMPLE rows, the first by hash
of their id, are labelled; every tenth of them is held out.

Beside them stand the labels of ``quality_labels.json``: row ids of the tables
of scale 0.1 that were read and judged one by one, in three strata (by
language: 110 Chinese, 20 to 25 of each other; 150 with few closing marks; 28
on which rules of different samples disagreed).  Those with an even id
overrule the patterns and count WEIGHT times in learning; those with an odd id
only measure the rules, together with the rules that are learned without
``clause_share``.
"""

from __future__ import annotations

import json
import re
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiforge.llm.quality import RULES, STATISTICS, induce, statistics
from mojiforge.llm.textforms import displayed

SAMPLE, WEIGHT = 20_000, 10
READ = Path(__file__).with_name("quality_labels.json")

FIELDS = re.compile(r"\t|\|.*\||</?t[dr]>|\S {3,}\S|^[^,，。]+(?:,[^,，。 ]+){2,}$|^\S{1,8}\s*[:：=＝]\s*\S{1,20}$")
ITEM = re.compile(r"^\s*(?:[-*·•▶◆●■]\s?|\(?\d{1,3}[.)、]|[(（]\d{1,3}[)）]|第\d+[项条]|[a-z][.)])")
BARE = re.compile(r"^\S[^，。！？,.!?]{0,30}(?:\d+元|[（(][^）)]*[）)])?$")
# Function words, adverbs and endings of Chinese clauses.
HAN_CLAUSE = re.compile(r"了|把|被|比|从|向|让|使|是|有|没|不|还|都|也|就|才|又|已经|正在|可以|必须|如果|虽然|但是|然后|因为|所以|由于|因此|我们|他们|大家|自己|今天|昨天|仍然|起来|认为|表示|进行|成为|其中|以后|之前|时候")
LATIN_CLAUSE = re.compile(r"\b(?:the|a|an|was|were|is|has|had|of|to|and|with|that|in|at|der|die|das|den|wurde|hat|am|und|über|nach|von|man|bei)\b", re.I)
REPEATS = re.compile(r"(.{2,40}?)\1{3,}")


def line_is_prose(line: str) -> bool:
    s = line.strip()
    if not s or FIELDS.search(s) or REPEATS.search(s) or s.count("#") >= 2 and re.search(r"#[^#\s]+#", s):
        return False
    if re.search(r"[฀-๿]", s):
        return bool(re.search(r"ที่|และ|วันนี้|เมื่อวาน|เช้านี้", s)) and len(s) >= 15
    if re.search(r"[ऀ-ॿ]", s):
        return bool(re.search(r"है|ने|में|था|का|की|से", s)) and len(s) >= 12
    if re.search(r"[぀-ヿ]{2,}", s):
        return bool(re.search(r"[をはでにが]", s)) and len(s) >= 8
    han = len(re.findall(r"[一-鿿]", s))
    if han >= 4 and han >= 0.2 * len(s):
        pieces = [x for x in re.split(r"[，。！？；：、,.!?;…“”「」]+", s) if len(x) >= 3]
        good = sum(len(x) for x in pieces if HAN_CLAUSE.search(x))
        known = bool(re.search(r"[。！？!?…；，]", s)) or han >= 14
        return bool(pieces) and good >= 0.25 * sum(map(len, pieces)) and (known or not ITEM.match(s)) or bool(re.search(r"[。！？!?]”?$", s)) and han >= 5
    words = re.findall(r"[A-Za-zÀ-ɏ]+", s)
    if len(words) >= 4 and max(map(len, words)) < 25:
        hits = len(LATIN_CLAUSE.findall(s))
        return hits >= 0.12 * len(words) and not ITEM.match(s)
    return False


def label(text: str | None) -> bool | None:
    """Whether a text is, by more than half, no natural prose; None for blank ones."""
    if not text or not text.strip():
        return None
    lines = [x for x in displayed(text).split("\n") if x.strip()]
    if not lines:
        return None
    size = [len(re.sub(r"\s", "", x)) for x in lines]
    prose = sum(n for x, n in zip(lines, size) if line_is_prose(x))
    return prose < 0.5 * sum(size)


def named(rules: list, names: list[str]) -> list[list[tuple[str, str, float]]]:
    return [[(names[k], "<=" if low else ">", round(cut, 6)) for k, low, cut in rule] for rule in rules]


def says(rules: list[list[tuple[str, str, float]]], table) -> np.ndarray:
    """What the rules say of each row of a table of statistics."""
    out = np.zeros(len(table), bool)
    for rule in rules:
        out |= np.logical_and.reduce([table[k] <= c if op == "<=" else table[k] > c for k, op, c in rule])
    return out


def _measured(rules, table, y: np.ndarray) -> dict:
    said = says(rules, table)
    hit = (said & y).sum()
    return {"rows": len(y), "positive": int(y.sum()), "precision": round(float(hit / max(1, said.sum())), 4), "recall": round(float(hit / max(1, y.sum())), 4)}


def train(spark: SparkSession, corpus: DataFrame, words: list[tuple[str, str]], sample: int = SAMPLE, read: Path = READ) -> dict:
    """Rules, how they do on the held-out tenth and on the labels that were read, and the same for rules without ``clause_share``."""
    judged = json.loads(read.read_text())
    known = {**dict.fromkeys(judged["no_prose"], True), **dict.fromkeys(judged["prose"], False)}
    rows = corpus.select("row_id", "content").orderBy(F.xxhash64("row_id"), "row_id").limit(sample)
    table = statistics(rows, "content", words).where("q is not null").select("row_id", "content", "q.*").toPandas()
    y = np.array([bool(label(t)) for t in table["content"]])
    own = table["row_id"].isin(known).to_numpy()
    held = (np.arange(len(y)) % 10 == 9) & ~own
    y[own] = [known[i] for i in table["row_id"][own]]
    odd = own & (table["row_id"] % 2 == 1).to_numpy()
    learn = np.repeat(np.arange(len(y)), np.where(held | odd, 0, np.where(own, WEIGHT, 1)))
    out = {}
    for kind, names in (("", list(STATISTICS)), ("without_clause_share", [k for k in STATISTICS if k != "clause_share"])):
        rules = named(induce(table[names].to_numpy(float)[learn], y[learn]), names)
        got = {"rules": rules, "held_out": _measured(rules, table[held], y[held]), "read": _measured(rules, table[odd], y[odd])}
        out.update({kind: got} if kind else got)
    return out


def main(sf_dir: str) -> None:
    from mojiforge.session import local_session, ship_package

    spark = local_session()
    ship_package(spark)
    words = [(r.lang, r.word) for r in spark.read.parquet(f"{sf_dir}/common_words.parquet").collect()]
    got = train(spark, spark.read.parquet(f"{sf_dir}/weixin_corpus.parquet"), words)
    print(json.dumps(got))
    RULES.write_text(json.dumps(got, indent=1) + "\n")


if __name__ == "__main__":
    main(sys.argv[1])
