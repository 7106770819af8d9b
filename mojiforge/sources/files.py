"""Reading and writing the file formats of text-correction corpora."""

from __future__ import annotations

import json
import os

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiforge.functions.text import remove_illegal, strip
from mojiforge.operators.dictionaries import line_ids

PAIR = "id long, source string, target string, type string"
RESULT = "id long, inference string"
MAX_FIELDS = 10_000


def read_pairs_json(spark: SparkSession, path: str, schema: str = PAIR, required: tuple[str, ...] = ("id", "source")) -> DataFrame:
    """A JSON array of labelled pairs; a record without a required field fails the read."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing field {c}")).cast(dict(df.dtypes)[c])).otherwise(F.col(c)))
    return df


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(content) of the lines that have one."""
    return spark.read.schema("content string").json(path).where("content is not null and content <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines by their 0-based place in the file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    return line_ids(raw, ["__f", "__b", "__m"]).select("line", "value")


def read_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """(line, value): stripped lines without blank ones, or all lines as they are; a missing file has none."""
    try:
        rows = numbered_lines(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "line long, value string")
    return rows if keep_blank else rows.select("line", strip(F.col("value")).alias("value")).where("value <> ''")


def read_tsv_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of tab-separated lines; the first column is the source. Blank lines are left out."""
    part = F.split(strip(F.col("value")), "\t", -1)
    rows = spark.read.text(path).where(F.length(strip(F.col("value"))) > 0)
    return rows.select(part[0].alias("source"), F.get(part, F.lit(1)).alias("target"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) by the kind of file its name tells; another name gives an empty table."""
    name = os.path.basename(path)
    if ".txt" in name:
        return read_tsv_pairs(spark, path)
    if ".json" in name:
        return read_pairs_json(spark, path).select("source", "target")
    return spark.createDataFrame([], "source string, target string")


def read_parallel(spark: SparkSession, sources: str, targets: str, first: int | None = None) -> DataFrame:
    """(line, source, target) of two files of one length, without pairs with a blank side; ``first``: only so many lines of each file."""
    a, b = numbered_lines(spark, sources).withColumnRenamed("value", "source"), numbered_lines(spark, targets).withColumnRenamed("value", "target")
    if first is not None:
        a, b = a.where(F.col("line") < first), b.where(F.col("line") < first)
    both = a.join(b, "line", "full")
    checked = F.when(F.col("source").isNull() | F.col("target").isNull(), F.raise_error(F.lit("files of different length")).cast("string")).otherwise(strip(F.col("source")))
    return both.select("line", checked.alias("source"), strip(F.col("target")).alias("target")).where("source <> '' and target <> ''")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(left_text, right_text, action_code) of three-line records between blank lines."""
    part = F.split(F.regexp_replace("value", r"\n+$", ""), "\n", -1)
    rows = spark.read.option("lineSep", "\n\n").text(path).where(F.length(strip(F.col("value"))) > 0)
    return rows.select(part[0].alias("left_text"), F.get(part, F.lit(1)).alias("right_text"), F.get(part, F.lit(2)).alias("action_code"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token): a token's id is its line; of a repeated token the last line counts."""
    rows = numbered_lines(spark, path)
    return rows.groupBy(F.col("value").alias("token")).agg(F.max("line").cast("int").alias("id")).select("id", "token")


def read_classes(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(gid, code, words) of lines "code word word"."""
    rows = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("text")) if encoding.lower() not in ("utf-8", "utf8") else None
    lines = numbered_lines(spark, path) if rows is None else rows.select(F.posexplode(F.split("text", r"\r?\n")).alias("line", "value"))
    part = F.split(strip(F.col("value")), r"\s+")
    return lines.where(F.length(strip(F.col("value"))) > 0).select(F.col("line").cast("long").alias("gid"), part[0].alias("code"), F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))).alias("words"))


def read_verb_forms(spark: SparkSession, path: str) -> DataFrame:
    """(w1, w2, t1, t2) of lines w1_w2:T1_T2; of lines with the same first word and forms the first counts."""
    m = lambda k: F.regexp_extract("value", r"^([^_]+)_([^:]+):([^_]+)_(.+)$", k)
    rows = read_lines(spark, path).select("line", m(1).alias("w1"), m(2).alias("w2"), m(3).alias("t1"), m(4).alias("t2")).where("w1 <> ''")
    return rows.groupBy("w1", "t1", "t2").agg(F.min_by("w2", "line").alias("w2")).select("w1", "w2", "t1", "t2")


def parse_solutions(lines: DataFrame) -> DataFrame:
    """(pid, errors) of lines "pid, loc, type, wrong, correct, ...," ; -1 lines and lines of another length have no errors."""
    part = F.transform(F.split("value", ",", -1), strip)
    n = F.floor((F.size(part) - 2) / 4).cast("int")
    whole = ((F.size(part) - 2) % 4 == 0) & (F.get(part, F.lit(1)) != "-1") & (n > 0)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(*[F.get(part, 4 * i + k + 1).alias(c) for k, c in enumerate(("loc", "typ", "wrong", "correct"))]))
    return lines.select(part[0].alias("pid"), F.when(whole, each).otherwise(F.array().cast("array<struct<loc:string,typ:string,wrong:string,correct:string>>")).alias("errors"))


def gold_to_texts(rows: DataFrame) -> DataFrame:
    """(id, source, target) of ``rows(id, tokens, edits)``, edits (s, e, words) applied from the right."""
    ordered = F.sort_array(F.transform("edits", lambda e: F.struct(e["s"].alias("s"), e["e"].alias("e"), e["words"].alias("words"))), asc=False)
    put = lambda acc, e: F.concat(F.slice(acc, F.lit(1), e["s"]), e["words"], F.slice(acc, e["e"] + 1, F.greatest(F.size(acc) - e["e"], F.lit(0))))
    return rows.select("id", F.array_join("tokens", "").alias("source"), F.array_join(F.aggregate(ordered, F.col("tokens"), put), "").alias("target"))


def write_lines(rows: DataFrame, path: str, col: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """One text file for each partition, in order; one file only where the rows are few enough for it."""
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    out.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a file of JSON lines; blank lines are skipped, missing fields are null."""
    return spark.read.schema(schema).json(path).where(" or ".join(f"`{c.split()[0]}` is not null" for c in schema.split(", ")))


def _bracketed(opening: str, closing: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, comma = opening, ""
        for batch in batches:
            if lines := batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([held + comma, *(x + "," for x in lines[:-1])], pa.string())], ["value"])
                held, comma = lines[-1], ","  # of the last line so far only the next batch tells whether another one follows
        yield pa.RecordBatch.from_arrays([pa.array([held, closing])], ["value"])

    return run


def write_json_arrays(rows: DataFrame, path: str, order: list[str]) -> None:
    """A folder of JSON arrays, one for each partition, in order: what ``read_pairs_json`` reads; no row passes the driver."""
    names = [c for c in rows.columns]
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))
    out.mapInArrow(_bracketed("[", "]"), "value string").write.mode("overwrite").text(path)


def write_dictionary(rows: DataFrame, path: str) -> None:
    """``rows(key, value)`` as JSON objects, one for each partition: what ``read_dictionary`` reads."""
    name = F.regexp_replace(F.to_json(F.struct(F.col("key").alias("k"))), r'^\{"k":|\}$', "")
    value = F.regexp_replace(F.to_json(F.struct(F.col("value").alias("v"))), r'^\{"v":|\}$', "")
    rows.where("key is not null and value is not null").select(F.concat(name, F.lit(": "), value).alias("value")).mapInArrow(_bracketed("{", "}"), "value string").write.mode("overwrite").text(path)


def write_json_array(rows: DataFrame, path: str, order: list[str], indent: int = 4) -> None:
    """A JSON array in one local file; rows stream to the driver partition by partition."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for k, r in enumerate(rows.orderBy(*order).toLocalIterator(prefetchPartitions=True)):
            body = json.dumps(r.asDict(recursive=True), ensure_ascii=False, indent=indent)
            f.write(("," if k else "") + "\n" + "\n".join(" " * indent + x for x in body.split("\n")))
        f.write("\n]")


def write_pairs_tsv(pairs: DataFrame, path: str) -> None:
    """The wrong side first; tabs and line ends inside a text become blanks."""
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]+", " ")
    pairs.select(F.concat_ws("\t", flat("aug"), flat("src")).alias("value")).write.mode("overwrite").text(path)


def write_shards(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)


def prediction_blocks(rows: DataFrame) -> DataFrame:
    """(id, is_correct, block): the report text of each prediction."""
    block = F.format_string("%s\nsrc: %s\ntgt: %s\npre: %s\n%s\n\n", F.col("id").cast("string"), "source", "target", "pred", "type")
    return rows.select("id", (F.col("target") == F.col("pred")).alias("is_correct"), block.alias("block"))


def write_reports(rows: DataFrame, path: str) -> None:
    """The blocks of right and wrong predictions below ``path``, by is_correct, and their numbers by type below ``path``_counts."""
    blocks = prediction_blocks(rows).withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))
    blocks.select("is_correct", F.substring(F.col("block"), F.lit(1), F.char_length("block") - 1).alias("value")).write.mode("overwrite").partitionBy("is_correct").text(path)
    counts = rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if(~F.col("target").eqNullSafe(F.col("pred"))).alias("wrong"))
    counts.write.mode("overwrite").json(f"{path}_counts")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(id, source, target, pred, type) of report files, their blocks divided by blank lines."""
    part = r"^(\d+)\nsrc: (.*)\ntgt: (.*)\npre: (.*)\n(\w+)$"
    rows = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").rlike(part))
    get = lambda k: F.regexp_extract("value", part, k)
    return rows.select(get(1).cast("long").alias("id"), get(2).alias("source"), get(3).alias("target"), get(4).alias("pred"), get(5).alias("type"))


def merge_token_pairs(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """All files of token pairs in a folder, cleaned on both sides, as one table of (aug, src) lines written to ``path``; returns it as read again."""
    rows = read_token_pairs(spark, folder)
    write_pairs_tsv(rows.select(F.col("source").alias("aug"), F.col("target").alias("src")), path)
    return read_tsv_pairs(spark, path)


def read_token_pairs(spark: SparkSession, path: str, keep_id: bool = False) -> DataFrame:
    """([id,] source, target) of JSON lines whose source is a list of tokens and whose key is ID; cleaned, blank ones dropped."""
    rows = spark.read.schema("ID string, source array<string>, target string").json(path)
    out = rows.select(F.col("ID").alias("id"), remove_illegal(F.array_join("source", "")).alias("source"), remove_illegal(F.col("target")).alias("target"))
    out = out.where("source <> '' and target <> ''")
    return out if keep_id else out.drop("id")


def read_dictionary(spark: SparkSession, path: str, value: str = "long") -> DataFrame:
    """(key, value) of a JSON object in one file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def read_confusion_sets(spark: SparkSession, synonyms: str, word_sounds: str, shapes: str, char_sounds: str) -> dict[str, DataFrame]:
    """The four candidate tables: (gid, words) of the two-level sets, (key, tokens) of the sound buckets."""
    two = lambda p: spark.read.text(p, wholetext=True).select(F.explode(F.from_json("value", "index_val map<string,array<string>>")["index_val"])).select(F.col("key").cast("long").alias("gid"), F.col("value").alias("words"))
    one = lambda p: read_dictionary(spark, p, "array<string>").select("key", F.col("value").alias("tokens"))
    return {"synonyms": two(synonyms), "word_homoPY": one(word_sounds), "simChar": two(shapes), "char_homoPY": one(char_sounds)}


def read_character_meta(spark: SparkSession, path: str) -> DataFrame:
    """(char, shapes, sounds) of tab-separated lines: code point, character, readings (; by language, , inside), decompositions. A character listed twice fails."""
    part = F.split("value", "\t", -1)
    sounds = F.transform(F.split(F.get(part, F.lit(2)), ";", -1), lambda x: F.filter(F.split(x, ","), lambda y: (y != "") & (y != "null")))
    rows = spark.read.text(path).where("value <> ''").select(part[1].alias("char"), F.slice(part, F.lit(4), F.greatest(F.size(part) - 3, F.lit(0))).alias("shapes"), sounds.alias("sounds"))
    once = rows.groupBy("char").agg(F.first("shapes").alias("shapes"), F.first("sounds").alias("sounds"), F.count("*").alias("n"))
    return once.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("listed twice: "), "char")).cast("string")).otherwise(F.col("char")).alias("char"), "shapes", "sounds")


def read_character_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(char, freq); the frequency stays text."""
    part = F.split(strip(F.col("value")), r"\s+")
    return spark.read.text(path).where(F.length(strip(F.col("value"))) > 0).select(part[0].alias("char"), F.get(part, F.lit(1)).alias("freq"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def parse_edits(lines: DataFrame) -> DataFrame:
    """(line, edits) of numbered lines "[[(start, end, 'wrong', ['right words']), ...]]"; edits (s, e, words) by their first correction."""
    one = r"""[(\[](\d+), *(\d+), *(?:'[^']*'|"[^"]*"), *\[(?:'([^']*)'|"([^"]*)")"""
    part = lambda k: F.regexp_extract_all("value", F.lit(one), k)
    words = lambda a, b: F.filter(F.split(F.concat(a, b), r"\s+"), lambda x: x != "")
    each = F.transform(F.arrays_zip(part(1).alias("s"), part(2).alias("e"), part(3).alias("a"), part(4).alias("b")), lambda z: F.struct(z["s"].cast("int").alias("s"), z["e"].cast("int").alias("e"), words(z["a"], z["b"]).alias("words")))
    return lines.select("line", each.alias("edits"))


def read_gold(spark: SparkSession, sentences: str, edits: str, inputs: str) -> DataFrame:
    """(id, source, target): the sentences of a gold file with their edits put in; the three files must be of one length."""
    gold = _renumbered(parse_gold(numbered_lines(spark, sentences)))
    rows = gold.join(parse_edits(numbered_lines(spark, edits)), "line", "full").join(numbered_lines(spark, inputs).select("line", "value"), "line", "full")
    whole = F.when(F.col("tokens").isNull() | F.col("edits").isNull() | F.col("value").isNull(), F.raise_error(F.lit("files of different length")).cast("array<string>")).otherwise(F.col("tokens"))
    return gold_to_texts(rows.select(F.col("line").alias("id"), whole.alias("tokens"), "edits"))


def _renumbered(rows: DataFrame) -> DataFrame:
    """``rows`` with consecutive lines in the order they had."""
    return line_ids(rows.withColumnRenamed("line", "__before"), ["__before"]).drop("__before")


def parse_gold(lines: DataFrame) -> DataFrame:
    """(line, tokens) of the sentence lines "S token token" of numbered lines."""
    return lines.where(F.startswith("value", F.lit("S "))).select("line", F.split(F.substring("value", 3, 1 << 30), " ").alias("tokens"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pid, text) of tab-separated lines that start with pid."""
    part = F.split("value", "\t", -1)
    return spark.read.text(path).where(F.startswith("value", F.lit("pid"))).select(part[0].alias("pid"), F.get(part, F.lit(1)).alias("text"))


def write_vocabulary(vocabulary: DataFrame, path: str) -> bool:
    """Writes ``vocabulary(id, token)`` in order of ids, one token a line; False where ids have gaps."""
    write_lines(vocabulary, path, "token", ["id"])
    r = vocabulary.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    return r.n == 0 or r.low == 0 and r.high == r.n - 1


def write_metrics(scores: DataFrame, path: str) -> None:
    """One row of scores as a JSON object; written again, it replaces the file."""
    scores.coalesce(1).write.mode("overwrite").json(path)


def decode_bytes(c):
    """Bytes as UTF-8 text without what isn't valid; a replacement character that is spelled out stays."""
    kept = F.unhex(F.regexp_replace(F.hex(c), r"\G((?:..)*?)EFBFBD", "$1EFB790"))  # a noncharacter stands for it meanwhile
    return F.translate(F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("�"), F.lit("")), "\ufdd0", "�")
