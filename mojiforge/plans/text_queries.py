"""Cleaning, splitting, sharding, files' formats and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from mojiforge.functions import text as T
from mojiforge.operators import datasets, segment
from mojiforge.operators.dictionaries import line_ids
from mojiforge.plans.catalogue import query, table
from mojiforge.session import shared_folder
from mojiforge.sources.files import parse_solutions, read_corpus_jsonl, read_parallel, read_tsv_pairs, write_lines, write_pairs_tsv

FULL, HALF = T.FULL_WIDTH, T.HALF_WIDTH
q = lambda s: s.replace("'", "''")
WHITE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}\x{1c}-\x{1f}"


def HALF_SQL(x: str) -> str:  # noqa: N802
    return f"translate({x}, '{q(FULL)}', '{q(HALF)}')"


def STRIP_SQL(x: str) -> str:  # noqa: N802
    return f"regexp_replace({x}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def CLEAN_SQL(x: str) -> str:  # noqa: N802
    return f"regexp_replace({STRIP_SQL(x)}, '{q(T.ILLEGAL)}', '', 'g')"


SPACED = r"[A-Za-z0-9\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]"


def ok_sql(x: str, least: int = 10, most: float = 0.1) -> str:
    """The quality gate in SQL."""
    return f"(length({STRIP_SQL(x)}) > 0 AND length({x}) >= {least} AND len(regexp_extract_all({x}, '{SPACED}')) / greatest(length({x}), 1) <= {most})"


@query("half_width", f"SELECT row_id, {HALF_SQL('content')} AS half FROM weixin_corpus")
def half_width(spark, d):
    return table(spark, d, "weixin_corpus").select("row_id", T.half_width(F.col("content")).alias("half"))


@query("uniform_text", f"SELECT account, lower({HALF_SQL('account_name')}) AS name FROM accounts")
def uniform_text(spark, d):
    return table(spark, d, "accounts").select("account", T.uniform(F.col("account_name")).alias("name"))


@query("clean_text", f"SELECT doc_id, {CLEAN_SQL('text')} AS clean FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.remove_illegal(F.col("text")).alias("clean"))


@query("sent_quality_filter", f"SELECT id, dataset FROM json_data WHERE {ok_sql('source')}")
def sent_quality_filter(spark, d):
    return table(spark, d, "json_data").where(T.is_sentence_ok(F.col("source"))).select("id", "dataset")


@query("separator_gate", "SELECT count(*) AS n, count(*) FILTER (WHERE NOT contains(text, 'SEPL|||SEPR') AND NOT contains(text, 'SEPL__SEPR') AND NOT contains(text, 'SEPL---SEPR')) AS free FROM documents")
def separator_gate(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count(F.when(T.free_of_separators(F.col("text")), 1)).alias("free"))


@query("gec_clean", f"SELECT pair_id, src FROM augmented_pairs WHERE {ok_sql('src')}")
def gec_clean(spark, d):
    return datasets.clean_gec(table(spark, d, "augmented_pairs")).select("pair_id", "src")


@query("csc_clean", "SELECT pair_id FROM augmented_pairs WHERE length(src) = length(aug)")
def csc_clean(spark, d):
    return datasets.clean_csc(table(spark, d, "augmented_pairs")).select("pair_id")


@query("pass_rate", f"SELECT shard, count(*) AS total, sum(CASE WHEN {ok_sql('src')} THEN 1 ELSE 0 END)::BIGINT AS passed, sum(CASE WHEN {ok_sql('src')} THEN 1 ELSE 0 END) / count(*) AS rate FROM augmented_pairs GROUP BY shard")
def pass_rate(spark, d):
    return datasets.pass_rate(table(spark, d, "augmented_pairs"), T.is_sentence_ok(F.col("src")), ["shard"])


@query("blank_filter", f"SELECT doc_id FROM documents WHERE length({STRIP_SQL('text')}) > 0")
def blank_filter(spark, d):
    return table(spark, d, "documents").where(F.length(T.strip(F.col("text"))) > 0).select("doc_id")


@query("han_prefix", "SELECT id FROM json_data WHERE regexp_matches(source, '^[一-龥]+')")
def han_prefix(spark, d):
    return table(spark, d, "json_data").where(F.col("source").rlike("^[一-龥]+")).select("id")


@query("short_source_rule", "SELECT id, CASE WHEN length(source) < 3 AND length(source) > 0 THEN source ELSE target END AS target, substr('始' || source, 1, 126) AS marked FROM json_data")
def short_source_rule(spark, d):
    s = F.col("source")
    return table(spark, d, "json_data").select("id", F.when((F.char_length(s) < 3) & (F.char_length(s) > 0), s).otherwise(F.col("target")).alias("target"), segment.sentinel(s, "始", 128).alias("marked"))


MARK_SQL = """
marks AS (SELECT *, regexp_extract_all({c}, '[！？。~…….!;；]+') AS runs FROM {t}),
picked AS (SELECT *, CASE WHEN len(runs) > 0 THEN list_sort(list_transform(list_distinct(runs), lambda x: {{'n': -len(list_filter(runs, lambda y: y = x)), 'first': list_position(runs, x), 'mark': x}}))[1].mark END AS mark FROM marks)"""


@query("split_dominant_punct", "WITH " + MARK_SQL.format(c="target", t="(SELECT id, target FROM json_data WHERE target IS NOT NULL)") + " SELECT id, unnest(CASE WHEN mark IS NULL THEN [target] ELSE list_transform(string_split(target, mark), lambda x: x || mark) END) AS piece FROM picked")
def split_dominant_punct(spark, d):
    return table(spark, d, "json_data").where("target is not null").select("id", F.explode(T.split_dominant(F.col("target"))).alias("piece"))


@query("segment_corpus")
def segment_corpus(spark, d):
    return table(spark, d, "weixin_corpus").select("row_id", F.posexplode(T.segment(F.col("content"))).alias("n", "sentence"))


@query("segment_full_stops", f"""WITH c AS (SELECT row_id, {CLEAN_SQL(HALF_SQL('content'))} AS x FROM weixin_corpus WHERE content IS NOT NULL)
SELECT row_id, piece FROM (SELECT row_id, unnest(CASE WHEN length(x) > 128 THEN list_transform(string_split(x, '。'), lambda y: y || '。') ELSE [x] END) AS piece FROM c) WHERE {ok_sql('piece')}""")
def segment_full_stops(spark, d):
    """The corpus segmentation without its last step."""
    x = F.col("x")
    clean = table(spark, d, "weixin_corpus").where("content is not null").select("row_id", T.remove_illegal(T.half_width(F.col("content"))).alias("x"))
    stops = F.when(F.char_length(x) > 128, F.transform(F.split(x, "。", -1), lambda y: F.concat(y, F.lit("。")))).otherwise(F.array(x))
    return clean.select("row_id", F.explode(stops).alias("piece")).where(T.is_sentence_ok(F.col("piece")))


SHARD = "(SELECT row_id, content, row_number() OVER (ORDER BY row_id) - 1 AS line, (SELECT count(*) FROM weixin_corpus) AS n FROM weixin_corpus)"


@query("shard_drop_remainder", f"SELECT row_id, content, (line // (n // 7))::BIGINT AS shard FROM {SHARD} WHERE line < (n // 7) * 7")
def shard_drop_remainder(spark, d):
    return datasets.shards(table(spark, d, "weixin_corpus").select("row_id", "content"), ["row_id"], 7, False)


@query("shard_keep_remainder", f"SELECT row_id, content, least(line // (n // 7), 6)::BIGINT AS shard FROM {SHARD}")
def shard_keep_remainder(spark, d):
    return datasets.shards(table(spark, d, "weixin_corpus").select("row_id", "content"), ["row_id"], 7, True)


def _padded(width: str, base: int) -> str:
    return f"SELECT doc_id, text, lpad((row_number() OVER (ORDER BY doc_id) - {1 - base})::VARCHAR, {width}, '0') AS padded FROM documents"


def _numbered(spark, d, base, width):
    rows = line_ids(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", "text", T.padded(F.col("line") + base, width).alias("padded"))


@query("padded_ids_8", _padded("8", 1))
def padded_ids_8(spark, d):
    return _numbered(spark, d, 1, 8)


@query("padded_ids_9", _padded("9", 1))
def padded_ids_9(spark, d):
    return _numbered(spark, d, 1, 9)


@query("padded_ids_n", _padded("(length((SELECT count(*) FROM documents)::VARCHAR) + 1)::INT", 0))
def padded_ids_n(spark, d):
    return _numbered(spark, d, 0, len(str(table(spark, d, "documents").count())) + 1)


@query("content_from_json", "SELECT content FROM weixin_corpus WHERE content <> ''")
def content_from_json(spark, d):
    """The articles written as JSON lines and read again."""
    path = shared_folder(spark)
    table(spark, d, "weixin_corpus").select("content").write.json(path)
    return read_corpus_jsonl(spark, path)


FLAT = "regexp_replace(coalesce({c}, ''), '[\\t\\r\\n]+', ' ', 'g')"


@query("tsv_pairs", f"SELECT string_split(line, chr(9))[1] AS source, string_split(line, chr(9))[2] AS target FROM (SELECT {STRIP_SQL(FLAT.format(c='aug') + ' || chr(9) || ' + FLAT.format(c='src'))} AS line FROM augmented_pairs) WHERE line <> ''")
def tsv_pairs(spark, d):
    """The machine-made pairs written as tab-separated lines and read again."""
    path = shared_folder(spark)
    write_pairs_tsv(table(spark, d, "augmented_pairs"), path)
    return read_tsv_pairs(spark, path)


@query("parallel_lines", f"SELECT line, source, target FROM (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS line, {STRIP_SQL(FLAT.format(c='aug'))} AS source, {STRIP_SQL(FLAT.format(c='src'))} AS target FROM augmented_pairs) WHERE source <> '' AND target <> ''")
def parallel_lines(spark, d):
    """Both sides of the machine-made pairs written to a file of lines each and zipped again."""
    a = table(spark, d, "augmented_pairs")
    paths = []
    for c in ("aug", "src"):
        paths.append(shared_folder(spark))
        write_lines(a.select("pair_id", F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]+", " ").alias(c)), paths[-1], c, ["pair_id"])
    return read_parallel(spark, *paths)


@query("solution_parse", "SELECT pair_id::VARCHAR AS pid, 1::BIGINT AS n, shard::VARCHAR AS loc, CASE WHEN aug IS NULL OR contains(aug, ',') OR contains(src, ',') THEN NULL ELSE aug END AS wrong FROM augmented_pairs WHERE aug IS NOT NULL AND src IS NOT NULL AND NOT contains(aug, ',') AND NOT contains(src, ',') AND length(" + STRIP_SQL("aug") + ") = length(aug)")
def solution_parse(spark, d):
    a = table(spark, d, "augmented_pairs").where("aug is not null and src is not null and not contains(aug, ',') and not contains(src, ',')").where(F.length(T.strip(F.col("aug"))) == F.length("aug"))
    lines = a.select(F.concat_ws(",", F.col("pair_id"), F.col("shard"), F.lit("别字"), F.col("aug"), F.col("src"), F.lit("")).alias("value"))
    found = parse_solutions(lines)
    return found.select("pid", F.size("errors").cast("long").alias("n"), F.col("errors")[0]["loc"].alias("loc"), F.col("errors")[0]["wrong"].alias("wrong"))


@query("dedupe_adjacent_tokens", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1]), ' ') AS text FROM w")
def dedupe_adjacent_tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(T.drop_repeated(F.split("text", " ", -1)), " ").alias("text"))


@query("normalize_text", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, lower(replace(replace(replace(replace(array_to_string(list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1]), ' '), '''''', '"'), '--', '—'), '`', ''''), '''ve', ''' ve')) AS text FROM w""")
def normalize_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("split_char_tokens", "SELECT id, len(regexp_extract_all(source, '[!-~]+|[^ !-~]'))::BIGINT AS n, array_to_string(regexp_extract_all(source, '[!-~]+|[^ !-~]'), '|') AS tokens FROM json_data WHERE source IS NOT NULL")
def split_char_tokens(spark, d):
    t = T.split_tokens(F.col("source"))
    return table(spark, d, "json_data").where("source is not null").select("id", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("tokens"))


@query("chunk_by_10", "WITH w AS (SELECT pair_id, regexp_extract_all(src, '.') AS t FROM augmented_pairs WHERE src IS NOT NULL) SELECT pair_id, i AS chunk, array_to_string(t[i * 10 + 1 : i * 10 + 10], '') AS text FROM (SELECT pair_id, t, unnest(range(greatest(ceil(len(t) / 10)::BIGINT, 1))) AS i FROM w)")
def chunk_by_10(spark, d):
    parts = F.transform(T.chunks(T.chars(F.col("src"))), lambda x: F.array_join(x, ""))
    return table(spark, d, "augmented_pairs").where("src is not null").select("pair_id", F.posexplode(parts).alias("chunk", "text")).select("pair_id", F.col("chunk").cast("long").alias("chunk"), "text")


@query("tagged_line_codec", "SELECT template_id, '$STARTSEPL|||SEPR$KEEP ' || array_to_string(list_transform(regexp_extract_all(left_text, '.'), lambda x: x || 'SEPL|||SEPR$DELETESEPL__SEPR$APPEND_' || x), ' ') AS line, len(regexp_extract_all(left_text, '.'))::BIGINT + 1 AS decoded FROM correction_templates WHERE length(left_text) > 0 AND NOT contains(left_text, ' ')")
def tagged_line_codec(spark, d):
    t = table(spark, d, "correction_templates").where("length(left_text) > 0 and not contains(left_text, ' ')")
    c = T.chars(F.col("left_text"))
    labels = F.concat(F.array(F.array(F.lit("$KEEP"))), F.transform(c, lambda x: F.array(F.lit("$DELETE"), F.concat(F.lit("$APPEND_"), x))))
    line = T.encode_tagged(c, labels)
    return t.select("template_id", line.alias("line")).withColumn("decoded", F.size(T.decode_tagged(F.col("line"))).cast("long"))


@query("char_ids_padded", """WITH v AS (SELECT ch AS token, row_number() OVER (ORDER BY ch) + 9 AS tid FROM (SELECT DISTINCT unnest(chars) AS ch FROM confusion_groups)),
c AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(substr(text, 1, 30), ''), '(?s).')) AS ch, generate_subscripts(regexp_extract_all(coalesce(substr(text, 1, 30), ''), '(?s).'), 1) AS pos FROM documents),
b AS (SELECT doc_id, list(coalesce(tid, 1)::INT ORDER BY pos) AS body FROM c LEFT JOIN v ON ch = token GROUP BY doc_id)
SELECT doc_id, array_to_string(list_concat([2], coalesce(body, []), [3], list_transform(range(30 - len(coalesce(body, []))), lambda x: 0)), ' ') AS ids, len(coalesce(body, []))::BIGINT + 2 AS mask FROM documents LEFT JOIN b USING (doc_id)""")
def char_ids_padded(spark, d):
    return _character_ids(spark, d, 32)


@query("char_ids_whole")
def char_ids_whole(spark, d):
    """The ids of whole documents."""
    return _character_ids(spark, d)


def _character_ids(spark, d, max_len=None):
    v = table(spark, d, "confusion_groups").select(F.explode("chars").alias("token")).distinct()
    v = line_ids(v, ["token"]).select("token", (F.col("line") + 10).cast("int").alias("id"))
    out = segment.character_ids(table(spark, d, "documents"), "doc_id", "text", v, max_len, 1, 2, 3)
    return out.select("doc_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).cast("long").alias("mask"))


@query("basic_tokens")
def basic_tokens(spark, d):
    return segment.tokens_with(segment.basic_tokens, table(spark, d, "documents"), "doc_id", "text")


@query("wordpiece")
def wordpiece(spark, d):
    """Word pieces of the basic tokens, over a vocabulary of the common words and single letters."""
    v = {r.word.lower() for r in table(spark, d, "common_words").collect()} | set("abcdefghijklmnopqrstuvwxyz") | {"##" + c for c in "abcdefghijklmnopqrstuvwxyz"} | {"##s", "##er", "##ing", "##ed"}
    known = frozenset(v)
    return segment.tokens_with(lambda t: [p for w in segment.basic_tokens(t) for p in segment.word_pieces(w, known)], table(spark, d, "documents"), "doc_id", "text")


@query("pinyin_map", "SELECT syllable, CASE WHEN syllable = 'xué' THEN 'xue2' WHEN syllable = 'lǜ' THEN 'lü4' WHEN syllable = 'háng' THEN 'hang2' WHEN syllable = 'mǎ' THEN 'ma3' ELSE 'n' END AS plain, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, 'xué|lǜ|háng|mǎ')) AS syllable FROM weixin_corpus) GROUP BY syllable")
def pinyin_map(spark, d):
    s = table(spark, d, "weixin_corpus").select(F.explode(F.regexp_extract_all("content", F.lit("xué|lǜ|háng|mǎ"), 0)).alias("syllable"))
    return s.groupBy("syllable").agg(F.count("*").alias("n")).withColumn("plain", T.pinyin_digits(F.col("syllable")))


@query("case_transforms", "SELECT c_custkey, upper(c_name) AS upper_name, lower(c_name) AS lower_name, upper(substr(c_name, 1, 1)) || lower(substr(c_name, 2)) AS capital, replace(c_name, '-', ' ') AS split, c_name || 's' AS plural FROM customer")
def case_transforms(spark, d):
    n = F.col("c_name")
    x = lambda label: T.transform_token(n, F.lit(label))
    return table(spark, d, "customer").select("c_custkey", x("$TRANSFORM_CASE_UPPER").alias("upper_name"), x("$TRANSFORM_CASE_LOWER").alias("lower_name"), x("$TRANSFORM_CASE_CAPITAL").alias("capital"), x("$TRANSFORM_SPLIT_HYPHEN").alias("split"), x("$TRANSFORM_AGREEMENT_PLURAL").alias("plural"))


CASED = "w AS (SELECT p_partkey, string_split(p_name, ' ')[1] || 'x' AS s FROM part)"


@query("case_detectors", f"WITH {CASED} SELECT p_partkey, [NULL, '$TRANSFORM_CASE_UPPER', '$TRANSFORM_CASE_CAPITAL', '$TRANSFORM_CASE_CAPITAL_1', '$TRANSFORM_CASE_UPPER_-1', NULL, NULL][p_partkey % 7 + 1] AS label, [NULL, NULL, NULL, NULL, NULL, '$TRANSFORM_AGREEMENT_PLURAL', '$TRANSFORM_AGREEMENT_SINGULAR'][p_partkey % 7 + 1] AS plural FROM w WHERE p_partkey % 7 > 0 AND length(s) > 2")
def case_detectors(spark, d):
    """The transform that makes the second form of the first one, with forms made in six ways."""
    s = F.concat(F.split("p_name", " ", -1)[0], F.lit("x"))
    rows = table(spark, d, "part").select("p_partkey", s.alias("s")).where("p_partkey % 7 > 0 and length(s) > 2")
    n, s = F.char_length("s"), F.col("s")
    made = [s, F.upper(s), T.capitalize(s), F.concat(F.substring("s", 1, 1), T.capitalize(F.substring(s, 2, 1 << 30))), F.concat(F.upper(F.substring(s, F.lit(1), n - 1)), F.substring(s, n, F.lit(1))), F.concat(s, F.lit("s")), s]
    target = F.get(F.array(*made), F.pmod("p_partkey", F.lit(7)).cast("int"))
    source = F.when(F.col("p_partkey") % 7 == 6, F.concat(s, F.lit("s"))).otherwise(s)
    return rows.select("p_partkey", T.case_label(source, target).alias("label"), T.plural_label(source, target).alias("plural"))


@query("trim_strip_sets", "SELECT template_id, ltrim(left_text || right_text, left_text) AS left_strip, rtrim(left_text || right_text, right_text) AS right_strip FROM correction_templates WHERE length(left_text) > 0 AND length(right_text) > 0")
def trim_strip_sets(spark, d):
    return table(spark, d, "correction_templates").where("length(left_text) > 0 and length(right_text) > 0").selectExpr("template_id", "trim(LEADING left_text FROM concat(left_text, right_text)) as left_strip", "trim(TRAILING right_text FROM concat(left_text, right_text)) as right_strip")
