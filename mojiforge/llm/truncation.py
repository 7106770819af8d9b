"""Texts that were cut off.

The corpus' vocabulary is a trie, kept as a table of its nodes and counted over
all texts for the nodes in question.  In scripts with spaces it holds words:
each node how many words pass it and how many end there.  A text's final token
is cut if it is a proper prefix of known words and hardly ever a word itself.
In scripts without spaces it holds what texts read backwards from a place:
each node how often its string occurs, how often a sentence or a field ends
there, and how often more follows; a final string that is frequent and hardly
ever an end is a prefix of known words only.  How the text's other lines end,
marks that a cut leaves behind, and text lengths that are suspiciously frequent
in a source complete the evidence.

All of it is measured by shares, so a corpus and a part of it are judged by one
measure; what a part is too small to show goes by the other evidence.  Final
strings that many texts share (a cut passage of many copies) count as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mojiforge.llm.overlap import BASE, INVERSE, KeyFilter, _joined, _mixed, key_filter
from mojiforge.llm.quality import WEAK, word_patterns
from mojiforge.llm.sentences import BRACKET, _matched
from mojiforge.llm.textforms import displayed
from mojiforge.session import settle

LEVELS = (1, 2, 3, 4, 6)
ENDS = "。！!？?….।”\"」』\n"
BREAKS = ENDS + "，,；;：:、“\t|<>（）()《》【】#/"
# Particles after which a clause may be complete.
DONE = "了到"
# What pages write after a cut text.
HINTS = "展开|全文|更多|查看全文|阅读全文|显示更多|查看更多|read more|see more|more|continue reading|weiterlesen|mehr|続きを読む|もっと見る|อ่านต่อ|और पढ़ें"
REMNANT = re.compile(rf"(?:�+|&#?[A-Za-z0-9]{{0,8}}|<[^<>\n]{{0,200}}|(?:…|\.{{3}})\s*[\[【（(]?(?:{HINTS})[\]】）)]?|\s*[\[【（(](?:{HINTS})[\]】）)]?)$", re.I)
FIELDS = re.compile(r"\t|\|.*\||</?t[dr]>|   ")
INSIDE = re.compile(r"《[^》]*》|（[^）]*）|\([^)]*\)|「[^」]*」|“[^”]*”")
STOPS = re.compile(r"[。！？!?।…](?=.)|[a-zäöüß]{2,}[.] +[A-ZÄÖÜ„“]")
CLOSED = re.compile("(?:[)）】》#>]|[☀-➿⬀-⯿\U0001f000-\U0001faff])$")
DIGITS = re.compile("[0-9]+")
TOKEN = re.compile("[A-Za-zÀ-ɏḀ-ỿऀ-ॿ]+$")
WORDS = re.compile("[A-Za-zÀ-ɏḀ-ỿऀ-ॿ]+")
# A share is known once a single end among that many occurrences would be more than it: about 1 / share of them.
RARE, ELLIPSIS_RARE, WORD_RARE = 0.02, 0.03, 0.05
NEED, ELLIPSIS_NEED = round(1.2 / RARE), round(0.36 / ELLIPSIS_RARE)
TAIL = 12
DEEP = 3  # from this level on a node says what line it ends
SHARED, KNOWN_START, START_SHARE = 3, 4, 7e-4
SURPRISE = 4.0  # standard deviations


def shown(text: str) -> str:
    return DIGITS.sub("0", displayed(text))


def body_of(s: str) -> str:
    """Without a single ellipsis at the end."""
    return s if s.endswith("……") else re.sub(r"(?:…|\.\.\.)$", "", s)


def _digest(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    return out


def _nodes(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: (level, text, place after the string, node, next code point or 0 at a text's end)."""
    a, stops = _joined(texts)
    size = len(a)
    lens = np.diff(stops, prepend=0)
    begins = np.repeat(stops - lens, lens)
    own = np.repeat(np.arange(len(texts)), lens)
    here = np.arange(size)
    broken = np.maximum.accumulate(np.where(_table(BREAKS)[a], here, -1))
    done = np.maximum.accumulate(np.where(_table(DONE)[a], here, -1))
    flag = (done > np.maximum(broken, begins - 1)).astype(np.uint64)
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, BASE))])
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, INVERSE))])
    whole = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(a.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * powers[:-1])])
    following = np.concatenate([a[1:], [0]]).astype(np.uint32)
    following[stops - 1] = 0
    for k in LEVELS:
        last = np.flatnonzero(here - begins >= k - 1)  # the strings' last characters
        node = _mixed((whole[last + 1] - whole[last + 1 - k]) * back[last + 1 - k] + np.uint64(k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) + flag[last])
        yield k, own[last], last, node.view(np.int64), following[last]


def word_node(prefix: str) -> int:
    return _digest("word " + prefix)


def _word_counts(texts: list[str], only: KeyFilter, cache: dict[str, list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, words that pass them, words that end there) of the wanted nodes; a text's final token is no word of the vocabulary."""
    n: dict[str, int] = {}
    for t in texts:
        for m in WORDS.finditer(t):
            if m.end() < len(t):
                w = m[0].casefold()
                n[w] = n.get(w, 0) + 1
    fresh = [w for w in n if w not in cache]
    if fresh:
        if len(cache) > 1 << 18:
            cache.clear()
            fresh = list(n)
        nodes = np.array([word_node(w[:k]) for w in fresh for k in range(1, len(w) + 1)], np.int64)
        keep = only.has(nodes)
        at = 0
        for w in fresh:
            cache[w] = [int(x) if k else 0 for x, k in zip(nodes[at : at + len(w)], keep[at : at + len(w)])]
            at += len(w)
    passed: dict[int, list[int]] = {}
    for w, count in n.items():
        nodes = cache[w]
        for k, node in enumerate(nodes, 1):
            if node:
                c = passed.setdefault(node, [0, 0])
                c[0] += count
                c[1] += count * (k == len(nodes))
    if passed:
        yield np.array(list(passed), np.int64), *np.array(list(passed.values()), np.int64).T


def _count_nodes(wanted):
    """(text) to (node, n, ends, breaks) of the wanted nodes, not counting texts' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = KeyFilter(wanted.value)
        ends, breaks = _table(ENDS), _table(BREAKS)
        cache: dict[str, list[int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                texts = [s for t in whole.column(0).slice(at, 1000).to_pylist() if (s := body_of(shown(t)))]
                if not texts:
                    continue
                for _, _, _, node, after in _nodes(texts):
                    keep = (after > 0) & only.has(node)
                    keys, place = np.unique(node[keep], return_inverse=True)
                    nxt = after[keep]
                    n, e, b = (np.bincount(place, x, len(keys)).astype(np.int64) for x in (None, ends[nxt], breaks[nxt]))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, n, e, b)], ["node", "n", "ends", "breaks"])
                for keys, n, e in _word_counts(texts, only, cache):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (keys, n, e, e)], ["node", "n", "ends", "breaks"])

    return run


def _unclosed(line: str) -> bool:
    pairs, _ = _matched(line)
    used = {x for p in pairs for x in p}
    return any(m.start() not in used and m[0] in "“「『„" for m in BRACKET.finditer(line))


FINAL = "id long, source string, size int, same long, verdict string, style string, ellipsis boolean, closed boolean, line long, starts array<long>, tail long, word long, nodes array<long>"


def _finals(clause: str):
    """(id, source, text) to what its end says by itself; texts that are complete by a closing mark have no row."""
    words = re.compile(clause)

    def judge(text: str) -> tuple | None:
        if not text or not text.strip():
            return None
        raw = text.rstrip()
        s = ""
        if raw[-1] in "。！？!?।”」』." and not raw.endswith("..."):
            line = displayed(raw.split("\n")[-1])
            if raw[-1] in "。！？!?।." and _unclosed(line) and words.search(line):
                return ("cut", "prose", False, False, None, [], [], text)
            return None
        s = shown(text)
        if not s:
            return None
        if REMNANT.search(s[-210:]):
            return ("cut", "prose", False, False, None, [], [], s)
        body = body_of(s)
        ellipsis = bool(body) and body != s
        if not ellipsis and s[-1] in ENDS:
            return None
        lines = [x for x in s.split("\n") if x.strip()]
        line, before = lines[-1], lines[:-1]
        if FIELDS.search(line) or line.count("#") >= 2:
            style = "item"
        else:
            sample = line
            if len(line) < 12 and before and not re.search("[。！？]", line):
                sample = before[-1]
            style = "item" if FIELDS.search(sample) or not (words.search(sample) or re.search("[。！？!?]", sample)) else "prose"
        full = bool(STOPS.search(INSIDE.sub("x", line))) or bool(before) and 2 * sum(x.rstrip()[-1] in ENDS for x in before) >= len(before)
        starts = []
        if before and len(line) <= 20:
            for k in (1, 2, 3):
                p = line[:k]
                if any(not c.isalpha() and not c.isspace() and c not in "“「《„\"'" for c in p):
                    starts.append(_digest(p))
        verdict = "ask"
        if style == "prose" and full and not ellipsis:
            verdict = "stopless"  # its other sentences have closing marks
        elif style == "prose" and s[-1] in "，,、：:；;“(（":
            verdict = "stopless"
        whole = _digest(line) if before and len(line) <= 30 else None
        return (verdict, style, ellipsis, bool(CLOSED.search(s)), whole, starts, body if ellipsis else s, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, asked = [], []
            for i, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if got := judge(text):
                    token = TOKEN.search(got[6]) if got[6] else None
                    rows.append([i, source, len(text), _digest(got[7]), *got[:6], _digest(got[6][-TAIL:]) if got[6] else None, word_node(token[0].casefold()) if token else None])
                    asked.append(got[6] or "")
            nodes: list[list[int]] = [[] for _ in rows]
            where = [k for k, s in enumerate(asked) if s]
            # Only the last clause of a text matters for the nodes of its end.
            tails = [asked[k][-400:] for k in where]
            if tails:
                for _, own, _, node, after in _nodes(tails):
                    for k, x in zip(own[after == 0].tolist(), node[after == 0].tolist()):
                        nodes[where[k]].append(x)
            columns = list(zip(*rows)) if rows else [()] * 12
            types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array(nodes, pa.list_(pa.int64()))], [x.split()[0] for x in FINAL.split(", ")])

    return run


def cut_off(docs: DataFrame, id_col: str, source_col: str, text_col: str, words: list[tuple[str, str]]) -> DataFrame:
    """(id, source) of the texts whose end is missing.

    ``words``: (lang, word) rows of frequent function words, which tell
    sentences from items of lists and tables.  Null, empty and blank texts are
    no case; repeated texts count each, and support one another nowhere.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    clause = word_patterns([x for x in words if x[1] not in WEAK])[1].replace(r"(?<=[^\p{L}\p{M}]|^)", r"(?<![^\W\d_])").replace(r"(?=[^\p{L}\p{M}]|$)", r"(?![^\W\d_])")
    finals = settle(docs.mapInArrow(_finals(clause), FINAL))
    texts = finals.dropDuplicates(["same"])
    # Lines and beginnings of lines that many different texts end with: signatures and the like.
    least = F.greatest(F.lit(KNOWN_START), START_SHARE * F.col("docs"))
    lines = texts.where("line is not null").groupBy(F.col("line").alias("key")).count().where(F.col("count") >= SHARED).select("key", F.lit(1).alias("known"))
    starts = texts.select(F.explode("starts").alias("key")).groupBy("key").count().join(docs.agg(F.count("*").alias("docs"))).where(F.col("count") >= least).select("key", F.lit(2).alias("known"))
    keys = finals.select("id", "same", F.explode(F.concat(F.array("line"), "starts")).alias("key"))
    known = keys.join(lines.unionByName(starts), "key").groupBy("id", "same").agg(F.min("known").alias("known"), F.max("known").alias("known_by"))
    # The nodes of the texts' ends, counted over the corpus and over the other texts' ends.
    asked = finals.where("verdict <> 'cut'").select("id", "same", F.posexplode(F.concat(F.array(F.coalesce("word", F.lit(0))), "nodes")).alias("level", "node")).where("node <> 0")
    wanted = spark.sparkContext.broadcast(key_filter(asked.select("node")))
    counts = docs.select("text").mapInArrow(_count_nodes(wanted), "node long, n long, ends long, breaks long")
    others = texts.select("tail", F.explode("nodes").alias("node")).groupBy("node").agg((F.count_distinct("tail") - 1).alias("n"))
    own, none = [F.col(c) for c in ("n", "ends", "breaks")], F.lit(0).cast("long")
    counts = counts.select("node", *own, own[0].alias("inner"), own[2].alias("inner_breaks")).unionByName(
        others.select("node", "n", F.col("n").alias("ends"), F.col("n").alias("breaks"), none.alias("inner"), none.alias("inner_breaks"))
    )
    counts = counts.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", "ends", "breaks", "inner", "inner_breaks")])
    found = asked.join(counts, "node").groupBy("id", "same").agg(F.collect_list(F.struct("level", "n", "ends", "breaks", "inner", "inner_breaks")).alias("all"))
    found = found.select("id", "same", F.filter("all", lambda x: x["level"] > 0).alias("found"), F.get(F.filter("all", lambda x: x["level"] == 0), F.lit(0)).alias("word_node"))
    # Lengths that many texts of a source have, unlike the lengths near them.
    sizes = docs.where("source is not null").groupBy("source", F.length("text").alias("size")).agg(F.count("*").alias("n"))
    near = Window.partitionBy("source").orderBy("size").rangeBetween(-10, 10)
    sizes = sizes.join(sizes.groupBy("source").agg(F.sum("n").alias("all")), "source")
    expected = (F.sum("n").over(near) - F.col("n")) / 20
    often = (F.col("n") >= 0.005 * F.col("all")) & (F.col("n") >= 6 * expected) & (F.col("n") >= expected + SURPRISE * F.sqrt(expected + 1))
    limits = sizes.withColumn("limit", often).where("limit").select("source", "size", "limit")
    rows = finals.join(known, ["id", "same"], "left").join(found, ["id", "same"], "left").join(limits, ["source", "size"], "left")
    # A line that is continued wherever else it stands is no signature, however many texts end with it, unless it begins like one.
    inner = F.array_max(F.filter("found", lambda x: (x["level"] > DEEP) & (x["inner"] >= NEED)))
    signature = (F.col("known") == 1) & ((F.col("known_by") == 2) | ~F.coalesce(inner["inner_breaks"] / inner["inner"] < RARE, F.lit(False)))
    rows = rows.withColumn("known", F.when(signature, 1).when(F.col("known_by") == 2, 2))
    style = F.when(F.col("known").isNotNull(), "item").otherwise(F.col("style"))
    need = F.when(F.col("ellipsis"), ELLIPSIS_NEED).otherwise(NEED)
    best = F.array_max(F.filter("found", lambda x: x["n"] >= need))
    share = F.when(style == "prose", best["ends"]).otherwise(best["breaks"]) / best["n"]
    limit = F.coalesce("limit", F.lit(False)) & F.col("known").isNull()
    word = F.col("word_node")
    prefix = F.coalesce((word["ends"] + 1) / (word["n"] + 2) < WORD_RARE, F.lit(False))
    cut = (
        F.when(F.col("verdict") == "cut", True)
        .when(F.col("known") == 1, False)
        .when(prefix, True)
        .when(F.col("ellipsis"), best.isNull() | (best["ends"] / best["n"] < ELLIPSIS_RARE))
        .when(F.col("closed") & ~limit, False)
        .when(F.col("verdict") == "stopless", (style == "prose") | limit)
        .when(best.isNull(), limit)
        .otherwise((share < RARE) | limit)
    )
    return rows.where(cut).select("id", "source")


def cut_report(docs: DataFrame, id_col: str, source_col: str, cut: DataFrame) -> DataFrame:
    """(source, documents, cut_off, share) of every source, the null one included."""
    all_docs = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("documents"))
    hits = cut.groupBy(F.col("source").alias("hit")).agg(F.count("*").alias("cut_off"))
    out = all_docs.join(hits, F.col("source").eqNullSafe(F.col("hit")), "left")
    return out.select("source", "documents", F.coalesce("cut_off", F.lit(0)).cast("long").alias("cut_off")).withColumn("share", F.col("cut_off") / F.col("documents"))
