"""Queries of the training-text operators, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mojiforge.llm.canonical import canonical_forms, same_look_pairs
from mojiforge.llm.chunking import LIMIT, cut_items, pieces_of
from mojiforge.llm.mixing import mix_report, mix_sources
from mojiforge.llm.neardup import near_duplicate_classes, near_duplicate_pairs
from mojiforge.llm.overlap import EVAL, TRAIN, cross_split_pairs
from mojiforge.llm.quality import STATISTICS, not_prose
from mojiforge.llm.sentences import split_sentences
from mojiforge.llm.tokens import count_tokens, decode_ids, encode_by_word_table, encode_texts
from mojiforge.llm.truncation import cut_off, cut_report
from mojiforge.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    return [(r.lang, r.word) for r in table(spark, sf_dir, "common_words").where("lang is not null and word is not null").distinct().collect()]


def _judged(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None) -> DataFrame:
    return not_prose(table(spark, sf_dir, "weixin_corpus").select("row_id", "content"), "content", _words(spark, sf_dir), names)


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("no_prose").select("row_id")


@query
def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every article and whether it is prose; null where there is no text."""
    return _judged(spark, sf_dir, STATISTICS).select("row_id", *[F.col(f"q.{k}") for k in STATISTICS], "no_prose")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicate_pairs(table(spark, sf_dir, "weixin_corpus"), "row_id", "content")
    return pairs.select(pairs.id_a.alias("row_id_a"), pairs.id_b.alias("row_id_b"))


@query
def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article with text, the class of its text, and to how many other classes that is linked."""
    members, links = near_duplicate_classes(table(spark, sf_dir, "weixin_corpus"), "row_id", "content")
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(n, "rep", "left").select(F.col("id").alias("row_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, j = table(spark, sf_dir, "weixin_corpus"), table(spark, sf_dir, "json_data")
    texts = (
        w.select(F.lit("weixin_corpus.content").alias("field"), F.col("row_id").alias("id"), F.col("content").alias("text"))
        .unionByName(j.select(F.lit("json_data.source").alias("field"), "id", F.col("source").alias("text")))
        .unionByName(j.select(F.lit("json_data.target").alias("field"), "id", F.col("target").alias("text")))
    )
    pairs = same_look_pairs(canonical_forms(texts))
    part = F.split("field", "[.]")
    return pairs.select(part[0].alias("table_name"), part[1].alias("field_name"), "id_a", "id_b")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "sentence_sample").select("row_id").distinct()
    rows = table(spark, sf_dir, "weixin_corpus").select("row_id", "content").join(asked, "row_id", "left_semi")
    return split_sentences(rows, "row_id", "content").select(F.col("id").alias("row_id"), F.explode("ends").alias("end_pos"))


@query
def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of sentences of every article."""
    return split_sentences(table(spark, sf_dir, "weixin_corpus"), "row_id", "content").select(F.col("id").alias("row_id"), F.size("ends").alias("sentences"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the cutter had to cut elsewhere, and not only because of the overlap: the stretch by itself is too long."""
    cut = cut_items(table(spark, sf_dir, "weixin_corpus"), "row_id", "content")
    return cut.where((F.col("forced") > 0) & (F.col("longest") > LIMIT)).select(F.col("id").alias("row_id"))


@query
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(table(spark, sf_dir, "weixin_corpus"), "row_id", "content").withColumnRenamed("id", "row_id")


def _split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "json_data")
    side = F.when(F.col("split_name") == "train", TRAIN).when(F.col("split_name").isin("val", "test"), EVAL)
    field = F.explode(F.array(F.struct(F.lit(0).alias("field"), F.col("source").alias("text")), F.struct(F.lit(1).alias("field"), F.col("target").alias("text"))))
    return cross_split_pairs(j.select("id", side.alias("side"), field.alias("f")).select("id", "side", "f.field", "f.text"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _split_pairs(spark, sf_dir)
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).where("id_a < id_b")


@query
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each val and test split and dataset, and how many of them occur in train."""
    j = table(spark, sf_dir, "json_data").where(F.col("split_name").isin("val", "test")).select("id", "split_name", "dataset").distinct()
    hit = _split_pairs(spark, sf_dir).select(F.col("eval_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return j.join(hit, "id", "left").groupBy("split_name", "dataset").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query
def p7_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids by one table of distinct words and joins by position."""
    return encode_by_word_table(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query
def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text put together from its ids again."""
    return decode_ids(encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


ORACLES["p7_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "account"], "text")
    docs = settle(docs)  # counted once, used for the cells and for the sample
    topics = table(spark, sf_dir, "accounts").select("account", F.col("category").alias("topic"))
    return mix_sources(docs.join(topics, "account", "left"), table(spark, sf_dir, "mix_targets"))


@query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, sf_dir)


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens that each source was to have, and has."""
    return mix_report(_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_off(table(spark, sf_dir, "documents"), "doc_id", "source", "text", _words(spark, sf_dir)).select(F.col("id").alias("doc_id"))


@query
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source were cut off."""
    docs = table(spark, sf_dir, "documents")
    return cut_report(docs, "doc_id", "source", cut_off(docs, "doc_id", "source", "text", _words(spark, sf_dir)))
