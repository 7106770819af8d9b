"""Dictionaries, scores, labels, templates, augmentation, taggers and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mojiforge.functions import text as T
from mojiforge.operators import align, augment, conversion, datasets, metrics, segment, similarity, tagging, templates
from mojiforge.operators import dictionaries as D
from mojiforge.plans.catalogue import query, table
from mojiforge.plans.text_queries import ok_sql

TRIPLES = """triples AS (SELECT j.id, j.source, j.target, s.inference AS pred, lower(coalesce(j.type, 'none')) AS type, j.dataset
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, source, target) AS rn FROM json_data) WHERE rn = 1) j
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY submitted_at DESC, run_name, inference) AS rn FROM submission) WHERE rn = 1) s ON j.id = s.id
WHERE j.source IS NOT NULL AND j.target IS NOT NULL AND s.inference IS NOT NULL)"""
PAIRS = """pairs AS (SELECT id, source, target FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, source, target) AS rn FROM json_data) WHERE rn = 1 AND source IS NOT NULL AND target IS NOT NULL)"""


def pairs(spark, d):
    """The last delivered pair of each id that has both sides."""
    w = Window.partitionBy("id").orderBy(F.desc("loaded_at"), "source", "target")
    j = table(spark, d, "json_data").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return j.where("source is not null and target is not null").select("id", "source", "target", F.lower(F.coalesce("type", F.lit("none"))).alias("type"), "dataset")


def triples(spark, d):
    """Pairs with the last submitted inference."""
    w = Window.partitionBy("id").orderBy(F.desc("submitted_at"), "run_name", "inference")
    s = table(spark, d, "submission").withColumn("rn", F.row_number().over(w)).where("rn = 1 and inference is not null").select("id", F.col("inference").alias("pred"))
    return pairs(spark, d).join(s, "id").select("id", "source", "target", "pred", "type", "dataset")


SENTENCE = f"""WITH {TRIPLES}, c AS (SELECT count(*) FILTER (WHERE source <> pred) AS pred_num, count(*) FILTER (WHERE source <> target) AS ref_num, count(*) FILTER (WHERE source <> target AND pred = target) AS hit_num FROM triples),
s AS (SELECT *, CASE WHEN pred_num = 0 THEN 0 ELSE hit_num / pred_num END AS "precision", CASE WHEN ref_num = 0 THEN 0 ELSE hit_num / ref_num END AS recall FROM c)
SELECT *, CASE WHEN "precision" + recall = 0 THEN 0 ELSE round(2 * "precision" * recall / ("precision" + recall), 4) END AS f1 FROM s"""


@query("eval_scores", SENTENCE)
def eval_scores(spark, d):
    return metrics.sentence_scores(triples(spark, d))


SAME = "length(source) = length(target) AND length(source) = length(pred)"
CHARS = f"""c AS (SELECT id, unnest(range(length(source))) AS i, source, target, pred FROM triples WHERE {SAME}),
x AS (SELECT id, i AS char_index, source[i + 1] AS s, target[i + 1] AS t, pred[i + 1] AS p FROM c)"""
COUNTS = "count(*) FILTER (WHERE s <> t) AS ref, count(*) FILTER (WHERE s <> p) AS pred, count(*) FILTER (WHERE s <> t AND s <> p) AS detect, count(*) FILTER (WHERE s <> t AND p = t) AS correct"


@query("char_label_counts", f"WITH {TRIPLES}, {CHARS} SELECT id, {COUNTS} FROM x GROUP BY id")
def char_label_counts(spark, d):
    return metrics.character_counts(triples(spark, d).where("source <> ''"), "id")


def _prf(kind: str) -> str:
    return f"round(CASE WHEN pred = 0 THEN 0 ELSE {kind} / pred END, 4) AS {kind}_p, round(CASE WHEN ref = 0 THEN 0 ELSE {kind} / ref END, 4) AS {kind}_r"


def _f(kind: str) -> str:
    return f"CASE WHEN {kind}_p + {kind}_r = 0 THEN 0 ELSE round(2 * {kind}_p * {kind}_r / ({kind}_p + {kind}_r), 4) END AS {kind}_f1"


@query("char_f1", f"WITH {TRIPLES}, {CHARS}, n AS (SELECT {COUNTS} FROM x), r AS (SELECT *, {_prf('detect')}, {_prf('correct')} FROM n) SELECT *, {_f('detect')}, {_f('correct')} FROM r")
def char_f1(spark, d):
    return metrics.character_scores(triples(spark, d), "id")


@query("char_error_log", f"WITH {TRIPLES}, {CHARS} SELECT id, char_index, s AS src_char, t AS trg_char, p AS pred_char, CASE WHEN s <> t AND p = s THEN 'miss' WHEN s = t AND p <> s THEN 'false alarm' ELSE 'wrong fix' END AS type FROM x WHERE (s <> t AND p = s) OR (s = t AND p <> s) OR (s <> t AND p <> t)")
def char_error_log(spark, d):
    return metrics.character_errors(triples(spark, d), "id")


@query("error_counts_by_type", f"WITH {TRIPLES} SELECT type, count(*) AS n, count(*) FILTER (WHERE target <> pred) AS wrong FROM triples GROUP BY type")
def error_counts_by_type(spark, d):
    return triples(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count(F.when(F.col("target") != F.col("pred"), 1)).alias("wrong"))


@query("correct_incorrect_split", f"WITH {TRIPLES} SELECT id, target = pred AS is_correct FROM triples")
def correct_incorrect_split(spark, d):
    return triples(spark, d).select("id", (F.col("target") == F.col("pred")).alias("is_correct"))


@query("prediction_report", f"WITH {TRIPLES} SELECT id, target = pred AS is_correct, id::VARCHAR || chr(10) || 'src: ' || source || chr(10) || 'tgt: ' || target || chr(10) || 'pre: ' || pred || chr(10) || type || chr(10) || chr(10) AS block FROM triples")
def prediction_report(spark, d):
    from mojiforge.sources.files import prediction_blocks

    return prediction_blocks(triples(spark, d))


@query("token_f1")
def token_f1(spark, d):
    return metrics.token_scores(triples(spark, d))


@query("final_f1")
def final_f1(spark, d):
    return metrics.final_scores(triples(spark, d))


# --- dictionaries ---------------------------------------------------------------------------------------------------------------------


def _chars(spark, d):
    return pairs(spark, d).select("id", F.explode(T.chars(F.col("target"))).alias("token"))


@query("corpus_char_dict", f"WITH {PAIRS} SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(target, '(?s).')) AS token FROM pairs) GROUP BY token HAVING count(*) >= 3")
def corpus_char_dict(spark, d):
    return D.frequencies(_chars(spark, d), "token", 3)


@query("corpus_word_dict", "SELECT token, count(*) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token HAVING count(*) >= 2")
def corpus_word_dict(spark, d):
    return D.frequencies(table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("token")), "token", 2)


@query("merged_dict", "SELECT token, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(regexp_extract_all(src, '(?s).')) AS token, 1 AS cnt FROM augmented_pairs UNION ALL SELECT unnest(regexp_extract_all(aug, '(?s).')), 1 FROM augmented_pairs) GROUP BY token")
def merged_dict(spark, d):
    a = table(spark, d, "augmented_pairs")
    return D.merge_counts(*[D.frequencies(a.select(F.explode(T.chars(F.col(c))).alias("token")), "token") for c in ("src", "aug")])


@query("label_vocab")
def label_vocab(spark, d):
    labels = pairs(spark, d).where("source <> target").select(F.explode(align.align_labels(F.col("source"), F.col("target"))).alias("label"))
    return D.label_vocabulary(labels, "label", 1)


@query("synonym_index", "SELECT word, max(gid) AS gid FROM (SELECT gid, unnest(chars) AS word FROM confusion_groups) GROUP BY word")
def synonym_index(spark, d):
    return D.word_index(table(spark, d, "confusion_groups").select("gid", F.col("chars").alias("words")))


CANDIDATES = f"""WITH {PAIRS}, w AS (SELECT DISTINCT unnest(regexp_extract_all(target, '(?s).')) AS word FROM pairs),
i AS (SELECT word, max(gid) AS gid FROM (SELECT gid, unnest(chars) AS word FROM confusion_groups) GROUP BY word)
SELECT w.word, array_to_string(list_sort(chars), ' ') AS candidates FROM w LEFT JOIN i ON w.word = i.word LEFT JOIN confusion_groups g ON i.gid = g.gid"""


@query("confusion_candidates", CANDIDATES)
def confusion_candidates(spark, d):
    groups = table(spark, d, "confusion_groups").select("gid", F.col("chars").alias("words"))
    return D.candidates(_chars(spark, d), "token", groups, same_length=True).withColumn("candidates", F.array_join("candidates", " "))


SOUND_SQL = "lower(substr({c}, 1, 1)) || regexp_replace(lower(substr({c}, 2)), '[aeiouyhw]', '', 'g')"


def _sound(c):
    return F.concat(F.lower(F.substring(c, 1, 1)), F.regexp_replace(F.lower(F.substring(F.col(c), 2, 1 << 30)), "[aeiouyhw]", ""))


@query("phonetic_buckets", f"SELECT {SOUND_SQL.format(c='word')} AS key, array_to_string(list_sort(list_distinct(list(word))), ' ') AS tokens FROM common_words WHERE lang IN ('en', 'de') GROUP BY 1")
def phonetic_buckets(spark, d):
    """Buckets by sound: the first letter and the consonants after it."""
    w = table(spark, d, "common_words").where("lang in ('en', 'de')")
    return D.buckets(w, "word", _sound("word")).withColumn("tokens", F.array_join("tokens", " "))


@query("homophone_candidates", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents WHERE lang IN ('en', 'de')), b AS (SELECT {SOUND_SQL.format(c='word')} AS key, list(word) AS tokens FROM w GROUP BY 1) SELECT word, array_to_string(list_sort(list_filter(tokens, lambda x: length(x) = length(word))), ' ') AS candidates FROM w JOIN b ON {SOUND_SQL.format(c='word')} = key")
def homophone_candidates(spark, d):
    """The words of one length that sound like each word of the English and German documents, itself included."""
    w = table(spark, d, "documents").where("lang in ('en', 'de')").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word")).distinct()
    x = w.withColumn("key", _sound("word")).join(D.buckets(w, "word", _sound("word")), "key")
    return x.select("word", F.array_join(F.filter("tokens", lambda t: F.char_length(t) == F.char_length("word")), " ").alias("candidates"))


FUZZY = """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents), b AS (SELECT regexp_extract(word, '^[a-z]h?[aeiou]') AS key, list_sort(list(word)) AS tokens FROM w WHERE regexp_matches(word, '^[a-z]h?[aeiou]') GROUP BY 1),
p AS (SELECT l.key AS long, s.key AS short, list_concat(s.tokens, l.tokens) AS joined FROM b l JOIN b s ON s.key = replace(l.key, 'h', '') WHERE regexp_matches(l.key, '^[a-z]h')),
n AS (SELECT long AS key, joined FROM p UNION ALL SELECT short, arg_max(joined, long) FROM p GROUP BY short)
SELECT b.key, array_to_string(coalesce(joined, tokens), ' ') AS tokens FROM b LEFT JOIN n USING (key)"""


@query("fuzzy_merge", FUZZY)
def fuzzy_merge(spark, d):
    """Words by the letters up to their first vowel: those with h and without it are merged."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("word")).where(F.col("word").rlike("^[a-z]h?[aeiou]"))
    merged = D.merge_fuzzy(D.buckets(w, "word", F.regexp_extract("word", "^[a-z]h?[aeiou]", 0)))
    return merged.select("key", F.array_join("tokens", " ").alias("tokens"))


@query("bucket_union", "WITH a AS (SELECT lang AS key, list(word) AS x FROM common_words WHERE length(word) <= 2 GROUP BY 1), b AS (SELECT lang AS key, list(word) AS y FROM common_words WHERE length(word) >= 2 GROUP BY 1) SELECT key, array_to_string(list_sort(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))), ' ') AS tokens FROM a FULL JOIN b USING (key)")
def bucket_union(spark, d):
    w = table(spark, d, "common_words")
    part = lambda c: D.buckets(w.where(c), "word", F.col("lang"))
    return D.merge_sets(part("length(word) <= 2"), part("length(word) >= 2")).withColumn("tokens", F.array_join("tokens", " "))


@query("unk_default_ids", f"WITH {PAIRS}, v AS (SELECT word AS token, max(gid) AS gid FROM (SELECT gid, unnest(chars) AS word FROM confusion_groups) GROUP BY 1), t AS (SELECT id, unnest(regexp_extract_all(target, '(?s).')) AS token FROM pairs) SELECT id, sum(coalesce(gid, 0))::BIGINT AS ids, count(*) AS n FROM t LEFT JOIN v USING (token) GROUP BY id")
def unk_default_ids(spark, d):
    v = D.word_index(table(spark, d, "confusion_groups").select("gid", F.col("chars").alias("words")))
    return D.with_default(_chars(spark, d), "token", v, "word", "gid", F.lit(0)).groupBy("id").agg(F.sum("gid").alias("ids"), F.count("*").alias("n"))


@query("ambiguous_class_expand", "SELECT word, array_to_string(list_sort(any_value(chars)), ' ') AS members FROM (SELECT chars, unnest(chars) AS word FROM confusion_groups) GROUP BY word HAVING count(*) = 1")
def ambiguous_class_expand(spark, d):
    g = table(spark, d, "confusion_groups").select("gid", F.col("chars").alias("words"))
    return D.unambiguous_class(g.select(F.explode("words").alias("word")).distinct(), g).withColumn("members", F.array_join("members", " "))


VARIANTS = {"做": "作", "在": "再", "得": "的", "地": "的", "这": "這", "书": "書", "车": "車", "门": "門"}
VARIANT_SQL = f"'{''.join(VARIANTS)}', '{''.join(VARIANTS.values())}'"


@query("simplify_lists", f"WITH {PAIRS} SELECT translate(substr(target, 1, 1), {VARIANT_SQL}) AS key, array_to_string(list_sort(list(DISTINCT translate(substr(target, 2, 4), {VARIANT_SQL}))), '|') AS tokens FROM pairs WHERE target <> '' GROUP BY 1")
def simplify_lists(spark, d):
    """The second to fifth characters of texts by their first, with variants of one character put together; keys that become equal are joined."""
    p = pairs(spark, d).where("target <> ''").withColumn("rest", F.substring("target", 2, 4))
    b = D.buckets(p, "rest", F.substring("target", 1, 1))
    return conversion.convert_lists(b, VARIANTS, distinct=True).select("key", F.array_join("tokens", "|").alias("tokens"))


# --- coverage, leakage, sets ----------------------------------------------------------------------------------------------------------


@query("label_cover_rate", "SELECT count(*) AS total, count(*) FILTER (WHERE account IN (SELECT account FROM accounts)) AS covered, count(*) FILTER (WHERE account IN (SELECT account FROM accounts)) / count(*) AS ratio FROM documents")
def label_cover_rate(spark, d):
    return datasets.label_coverage(table(spark, d, "documents"), table(spark, d, "accounts"), "account")


@query("uncovered_labels", "SELECT id, run_name FROM submission s WHERE NOT EXISTS (SELECT 1 FROM json_data j WHERE j.id = s.id)")
def uncovered_labels(spark, d):
    return datasets.uncovered(table(spark, d, "submission").select("id", "run_name"), table(spark, d, "json_data"), "id")


@query("filter_uncovered", "SELECT gid FROM confusion_groups WHERE NOT list_has_any(chars, ['在', '做', '的'])")
def filter_uncovered(spark, d):
    bad = spark.createDataFrame([("在",), ("做",), ("的",)], "ch string")
    return datasets.without_labels(table(spark, d, "confusion_groups"), "gid", "chars", bad, "ch").select("gid")


RATIO = "(2.0 * list_sum(list_transform(list_distinct(regexp_extract_all({a}, '(?s).')), lambda x: least(length({a}) - length(replace({a}, x, '')), length({b}) - length(replace({b}, x, ''))))) / (length({a}) + length({b})))"


LEAKAGE = """q AS (SELECT DISTINCT id AS a_id, source AS a FROM json_data WHERE split_name IN ('val', 'test') AND id % 100 = 0 AND source IS NOT NULL),
t AS (SELECT DISTINCT id AS b_id, source AS b FROM json_data WHERE split_name = 'train' AND id IS NOT NULL AND source IS NOT NULL)"""


@query("leakage_top10", f"WITH {LEAKAGE} SELECT a_id, b_id, round(r, 6) AS ratio FROM (SELECT a_id, b_id, {RATIO.format(a='a', b='b')} AS r FROM q, t) ORDER BY round(r, 6) DESC, a_id, b_id LIMIT 10")
def leakage_top10(spark, d):
    """The most similar sources of val or test records (the query set: those with an id divisible by 100) and of all train records."""
    j = table(spark, d, "json_data").where("source is not null and id is not null")
    a = j.where("split_name in ('val', 'test') and id % 100 = 0").select(F.col("id").alias("a_id"), F.col("source").alias("a")).distinct()
    b = j.where("split_name = 'train'").select(F.col("id").alias("b_id"), F.col("source").alias("b")).distinct()
    return datasets.most_similar(a, b)


@query("pair_similarity", f"WITH {PAIRS} SELECT id, round({RATIO.format(a='source', b='target')}, 6) AS ratio FROM pairs WHERE source <> ''")
def pair_similarity(spark, d):
    return pairs(spark, d).where("source <> ''").select("id", F.round(T.multiset_ratio(F.col("source"), F.col("target")), 6).alias("ratio"))


@query("union_datasets", "SELECT 'json' AS origin, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT source AS text FROM json_data UNION ALL SELECT target FROM json_data UNION ALL SELECT src FROM augmented_pairs)")
def union_datasets(spark, d):
    j = table(spark, d, "json_data")
    u = j.select(F.col("source").alias("text")).unionByName(j.select(F.col("target").alias("text"))).unionByName(table(spark, d, "augmented_pairs").select(F.col("src").alias("text")), allowMissingColumns=True)
    return u.agg(F.lit("json").alias("origin"), F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@query("exact_head", "SELECT row_id, account FROM weixin_corpus ORDER BY row_id LIMIT 50")
def exact_head(spark, d):
    """The first rows of a parallel corpus: a limit is the feature."""
    return table(spark, d, "weixin_corpus").orderBy("row_id").limit(50).select("row_id", "account")


@query("dev_split", "SELECT pair_id, row_number() OVER (ORDER BY md5('7' || pair_id::VARCHAR)) <= greatest((SELECT count(*) FROM augmented_pairs) // 100, 1) AS is_dev FROM augmented_pairs")
def dev_split(spark, d):
    return datasets.dev_split(table(spark, d, "augmented_pairs").select("pair_id"), "pair_id", 0.01, "7")


# --- alignment ------------------------------------------------------------------------------------------------------------------------


@query("edit_opcodes")
def edit_opcodes(spark, d):
    return pairs(spark, d).select("id", F.explode(align.opcodes(F.col("source"), F.col("target"))).alias("op")).select("id", "op.*")


@query("align_labels")
def align_labels(spark, d):
    return pairs(spark, d).select("id", F.posexplode(align.align_labels(F.col("source"), F.col("target"))).alias("pos", "label"))


@query("apply_levels", f"WITH {PAIRS} SELECT id, target AS made FROM pairs WHERE source <> '' AND target <> '' AND NOT regexp_matches(source || target, '[\\sA-Za-z-]')")
def apply_levels(spark, d):
    """The targets put together again from the sources and their labels, of texts without words of letters."""
    p = pairs(spark, d).where("source <> '' and target <> ''").where(~F.concat("source", "target").rlike(r"[\sA-Za-z-]"))
    return p.select("id", align.corrected_by_levels(F.col("source"), align.align_label_lists(F.col("source"), F.col("target"))).alias("made"))


@query("apply_levels_all")
def apply_levels_all(spark, d):
    """The same of all pairs; labels are of words, so white space inside an inserted or replaced part is lost, which SQL can't say."""
    p = pairs(spark, d).where("source <> '' and target <> ''")
    return p.select("id", align.corrected_by_levels(F.col("source"), align.align_label_lists(F.col("source"), F.col("target"))).alias("made"))


@query("legacy_labels")
def legacy_labels(spark, d):
    return pairs(spark, d).select("id", F.array_join(align.legacy_labels(F.col("source"), F.col("target")), " ").alias("labels"))


@query("training_example")
def training_example(spark, d):
    """Input ids, mask and tags of every pair by vocabularies of the corpus: labels and characters that occur three times."""
    p = pairs(spark, d)
    found = D.frequencies(p.select(F.explode(align.align_labels(F.col("source"), F.col("target"))).alias("label")), "label", 3).where("token <> '$KEEP'")
    special = spark.createDataFrame([(0, "$KEEP"), (1, "[REPLACE_UNK]"), (2, "[APPEND_UNK]")], "label_id long, label string")
    labels = D.line_ids(found.select(F.col("token").alias("label")), ["label"]).select((F.col("line") + 3).alias("label_id"), "label").unionByName(special)
    chars = D.line_ids(D.frequencies(_chars(spark, d), "token", 3).select("token"), ["token"]).select("token", (F.col("line") + 4).cast("int").alias("id"))
    return datasets.training_examples(p, "id", labels, chars)


@query("labels_to_edits", "SELECT gid, unnest(range(len(chars))) AS start, 1::BIGINT AS width FROM confusion_groups")
def labels_to_edits(spark, d):
    labels = F.concat(F.array(F.array(F.lit("$KEEP"))), F.transform("chars", lambda c: F.array(F.concat(F.lit("$REPLACE_"), c))))
    e = table(spark, d, "confusion_groups").select("gid", F.explode(align.labels_to_edits(labels)).alias("e"))
    return e.select("gid", F.col("e.start").cast("long").alias("start"), (F.col("e.end") - F.col("e.start")).cast("long").alias("width"))


@query("edits_to_labels", "SELECT gid, array_to_string(list_transform(range(len(chars) + 1), lambda j: CASE WHEN j >= 2 AND j % 2 = 0 THEN '$DELETE+$APPEND_' || (j // 2) ELSE '$KEEP' END), ' ') AS labels FROM confusion_groups")
def edits_to_labels(spark, d):
    """Every second token is deleted and followed by another; all label lists as one line."""
    ops = lambda i: F.array(F.lit("$DELETE"), F.concat(F.lit("$APPEND_"), i.cast("string")))
    found = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size("chars") / 2).cast("int"), F.lit(1))), lambda i: F.struct((2 * i - 1).cast("int").alias("start"), (2 * i).cast("int").alias("end"), ops(i).alias("ops")))
    labels = align.edits_to_labels(F.size("chars"), found)
    return table(spark, d, "confusion_groups").select("gid", F.array_join(F.transform(labels, lambda x: F.array_join(x, "+")), " ").alias("labels"))


@query("apply_tags", f"WITH {PAIRS} SELECT id, array_to_string(list_transform(regexp_extract_all(source, '(?s).'), lambda c, i: CASE WHEN i % 5 = 0 THEN '' WHEN i % 5 = 1 THEN 'X' WHEN i % 5 = 2 THEN c || 'Y' WHEN i % 5 = 3 THEN c ELSE '' END), '') AS made FROM pairs WHERE source <> ''")
def apply_tags(spark, d):
    c = T.chars(F.col("source"))
    labels = F.transform(c, lambda _, i: F.get(F.array(F.lit("$REPLACE_X"), F.lit("$APPEND_Y"), F.lit("$KEEP"), F.lit("[REPLACE_UNK]"), F.lit("$DELETE")), F.pmod(i, F.lit(5))))
    return pairs(spark, d).where("source <> ''").select("id", T.apply_tags(c, labels).alias("made"))


# --- templates ------------------------------------------------------------------------------------------------------------------------


@query("template_patterns", "SELECT DISTINCT left_text, right_text, action_code FROM (SELECT left_text, right_text, action_code FROM correction_templates UNION ALL SELECT right_text, left_text, action_code FROM correction_templates WHERE action_code = '3') WHERE left_text IS NOT NULL AND right_text IS NOT NULL AND action_code IS NOT NULL")
def template_patterns(spark, d):
    return templates.patterns_of(table(spark, d, "correction_templates"))


@query("template_all")
def template_all(spark, d):
    return templates.correct(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "correction_templates"))


@query("template_counts")
def template_counts(spark, d):
    return templates.fix_counts(templates.correct(table(spark, d, "augmented_pairs"), "pair_id", "aug", table(spark, d, "correction_templates")))


# --- augmentation ---------------------------------------------------------------------------------------------------------------------


def _sets(spark, d, words: bool = False) -> augment.Sets:
    """Candidates of each character: its last group; with ``words``, of each template side: the other sides it stands with."""
    g = table(spark, d, "confusion_groups").select("gid", F.col("chars").alias("words"))
    last = D.word_index(g).join(g, "gid").limit(augment.MAX_ENTRIES + 1).collect()
    lists = {r.word: list(r.words) for r in last}
    if not words:
        return augment.Sets(shape=lists, char_sound=lists)
    t = table(spark, d, "correction_templates").where("length(left_text) > 1 and length(right_text) > 1")
    sides = t.select(F.col("left_text").alias("a"), F.col("right_text").alias("b")).unionByName(t.select(F.col("right_text").alias("a"), F.col("left_text").alias("b")))
    by = {r.key: list(r.tokens) for r in D.buckets(sides, "b", F.col("a")).limit(augment.MAX_ENTRIES + 1).collect()}
    return augment.Sets(shape=lists, char_sound=lists, synonym=by, word_sound=by)


@query("augment_gec")
def augment_gec(spark, d):
    """Both grains: half of the texts are edited by words."""
    sets = _sets(spark, d, words=True)
    return augment.augment(pairs(spark, d), "id", "target", sets, augment.GEC, frozenset(sets.synonym))


DRAW = "('0x' || substr(md5('123|' || id || '|' || chunk || '|{n}'), 1, 8))::BIGINT"
AUGMENTED = f"""WITH {PAIRS}, i AS (SELECT word, max(gid) AS gid FROM (SELECT gid, unnest(chars) AS word FROM confusion_groups) GROUP BY word), s AS (SELECT word, chars FROM i JOIN confusion_groups USING (gid)),
t AS (SELECT id, target AS src, regexp_extract_all(target, '(?s).') AS ch FROM pairs WHERE {ok_sql('target')}),
c AS (SELECT id, src, chunk, ch[chunk * 10 + 1 : chunk * 10 + 10] AS x FROM (SELECT *, unnest(range(ceil(len(ch) / 10)::BIGINT)) AS chunk FROM t)),
p AS (SELECT *, list_filter(range(1, len(x) + 1), lambda k: x[k] >= '一' AND x[k] <= '龥') AS places FROM c),
w AS (SELECT *, CASE WHEN len(places) > 0 THEN places[({DRAW.format(n=0)} % len(places))::BIGINT + 1] END AS spot FROM p),
n AS (SELECT w.*, CASE WHEN chars IS NOT NULL THEN chars[({DRAW.format(n=2)} % len(chars))::BIGINT + 1] END AS fresh FROM w LEFT JOIN s ON s.word = w.x[w.spot])
SELECT id, src, string_agg(array_to_string(list_transform(x, lambda y, k: CASE WHEN k = spot AND fresh IS NOT NULL THEN fresh ELSE y END), ''), '' ORDER BY chunk) AS aug FROM n GROUP BY id, src"""


@query("augment_csc", AUGMENTED)
def augment_csc(spark, d):
    """One replacement of the same length in every chunk of ten characters."""
    return augment.augment(pairs(spark, d), "id", "target", _sets(spark, d), augment.Profile(0.0, "replace", True))


# --- taggers --------------------------------------------------------------------------------------------------------------------------

LOGITS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), m AS (SELECT *, list_transform(x, lambda v: exp(v - list_max(x))) AS ex FROM e), p AS (SELECT *, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM m)"


def _logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


@query("softmax_topk", f"WITH {LOGITS}, r AS (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS label FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, label) AS rank FROM r) SELECT vec_id, rank, label::BIGINT AS label, round(v, 6) AS p FROM k WHERE rank <= 3")
def softmax_topk(spark, d):
    t = _logits(spark, d).select("vec_id", F.posexplode(tagging.top_labels(tagging.softmax(F.col("x")), 3)).alias("rank", "t"))
    return t.select("vec_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("t.label").cast("long").alias("label"), F.round("t.p", 6).alias("p"))


@query("ensemble_vote", f"WITH {LOGITS} SELECT vec_id, round(list_sum(list_transform(p, lambda v, i: v * i * 0.6 + p[len(p) + 1 - i] * i * 0.4)), 5) AS score FROM p")
def ensemble_vote(spark, d):
    p = tagging.softmax(F.col("x"))
    m = tagging.weighted_mean([p, F.reverse(p)], [0.6, 0.4])
    return _logits(spark, d).select("vec_id", F.round(F.aggregate(F.transform(m, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b), 5).alias("score"))


@query("keep_bias", f"WITH {LOGITS} SELECT vec_id, round(p[1] + 0.25, 6) AS kept, round(p[2], 6) AS next FROM p")
def keep_bias(spark, d):
    p = tagging.keep_bias(tagging.softmax(F.col("x")), 0.25)
    return _logits(spark, d).select("vec_id", F.round(F.get(p, F.lit(0)), 6).alias("kept"), F.round(F.get(p, F.lit(1)), 6).alias("next"))


@query("argmax_tag", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS tag FROM embeddings")
def argmax_tag(spark, d):
    return _logits(spark, d).select("vec_id", tagging.argmax(F.col("x")).cast("long").alias("tag"))


@query("label_smoothing_loss", f"WITH {LOGITS} SELECT round(avg(-0.9 * ln(p[label + 1]) - 0.1 * list_avg(list_transform(p, lambda v: ln(v)))), 5) AS loss FROM p")
def label_smoothing_loss(spark, d):
    return _logits(spark, d).agg(F.round(F.avg(metrics.smoothed_loss(F.col("x"), F.col("label"))), 5).alias("loss"))


def _once(x: str) -> str:
    return f"CASE WHEN contains({x}, '再') THEN regexp_replace({x}, '再', '在') WHEN contains({x}, '的的') THEN regexp_replace({x}, '的的', '的') WHEN contains({x}, '在在') THEN regexp_replace({x}, '在在', '在') ELSE {x} END"


ROUNDS = f"WITH a AS (SELECT concat_ws('|', run_name, id::VARCHAR, strftime(submitted_at, '%Y-%m-%d %H:%M:%S.%f')) AS key, inference AS x FROM submission), b AS (SELECT *, {_once('x')} AS y FROM a), c AS (SELECT *, {_once('y')} AS z FROM b), e AS (SELECT *, {_once('z')} AS corrected FROM c)"


@query("iterative_correct", ROUNDS + " SELECT key, corrected, coalesce((x <> y)::INT + (y <> z)::INT + (z <> corrected)::INT, 0) AS n_rounds FROM e")
def iterative_correct(spark, d):
    tagger = tagging.rule_tagger([("再", "在"), ("的的", "的"), ("在在", "在")])
    return tagging.correct_until_stable(table(spark, d, "submission").withColumn("key", F.concat_ws("|", "run_name", "id", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))), "key", "inference", tagger, 3)


# --- similarity -----------------------------------------------------------------------------------------------------------------------


@query("edit_distance", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_name < b.n_name")
def edit_distance(spark, d):
    return similarity.unordered_pairs(table(spark, d, "nation"), "n_name").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))


@query("char_pair_similarity")
def char_pair_similarity(spark, d):
    """Similarity of confusable characters by the groups they share, through their code points' spelling."""
    g = table(spark, d, "confusion_groups").select("gid", F.explode("chars").alias("char"))
    meta = g.groupBy("char").agg(F.array(F.hex(F.encode("char", "UTF-8"))).alias("shapes"), F.array(F.array_sort(F.collect_list(F.col("gid").cast("string")))).alias("sounds"))
    p = g.select("gid", F.col("char").alias("a")).join(g.select("gid", F.col("char").alias("b")), "gid").where("a < b").select("a", "b").distinct()
    return similarity.character_similarity(p, meta)


@query("trad_simp", "SELECT id, translate(replace(replace(replace(replace(source, '图书管理员', '圖書管理員'), '书管理员', '書管理員'), '图书', '圖書'), '书馆', '書舘'), '館見並长', '馆见并長') AS converted FROM (SELECT DISTINCT id, source FROM json_data WHERE source IS NOT NULL)")
def trad_simp(spark, d):
    """Overlapping phrases: the fewest segments win (图 and 书管理员 over 图书, 管, 理 and 员), of equals the longer first one (图书 and 馆 over 图 and 书馆)."""
    entries = [("館", "馆"), ("見", "见"), ("並", "并"), ("图书", "圖書"), ("书管理员", "書管理員"), ("图", "图"), ("书馆", "書舘"), ("长", "長"), ("图书", "一")]
    entries.append(("图书管理员", "圖書管理員"))
    t = spark.createDataFrame(entries, "source string, target string")
    return conversion.convert(table(spark, d, "json_data").where("source is not null").select("id", "source").distinct(), "id", "source", t)


# --- the rest of the inventory --------------------------------------------------------------------------------------------------------

READINGS = "readings AS (SELECT DISTINCT unnest(chars) AS char, 'g' || gid AS sound FROM confusion_groups)"


def _readings(spark, d):
    """Groups of confusable characters stand in for readings."""
    return table(spark, d, "confusion_groups").select(F.explode("chars").alias("char"), F.concat(F.lit("g"), F.col("gid").cast("string")).alias("sound")).distinct()


@query("homophones_by_char", f"WITH {READINGS} SELECT a.char, array_to_string(list_sort(list_distinct(list(b.char))), ' ') AS others FROM readings a JOIN readings b ON a.sound = b.sound AND a.char <> b.char GROUP BY a.char")
def homophones_by_char(spark, d):
    r = _readings(spark, d)
    return D.homophones(r, "char", r).withColumn("others", F.array_join("others", " "))


@query("sound_keys", f"WITH {READINGS}, one AS (SELECT char, min(sound) AS sound FROM readings GROUP BY char), w AS (SELECT DISTINCT left_text AS word FROM correction_templates WHERE length(left_text) > 0), e AS (SELECT word, i, sound FROM (SELECT word, unnest(range(length(word))) AS i FROM w) LEFT JOIN one ON char = word[i + 1]) SELECT word, CASE WHEN count(*) = count(sound) THEN string_agg(sound, '_' ORDER BY i) END AS key FROM e GROUP BY word")
def sound_keys(spark, d):
    return D.sound_keys(table(spark, d, "correction_templates"), "left_text", _readings(spark, d), False)


@query("epoch_order", "SELECT pair_id, shard, row_number() OVER (PARTITION BY shard ORDER BY h, pair_id) - 1 AS pos FROM (SELECT pair_id, h, ('0x' || substr(h, 1, 8))::BIGINT % 8 AS shard FROM (SELECT pair_id, md5('9|' || pair_id::VARCHAR) AS h FROM augmented_pairs))")
def epoch_order(spark, d):
    return datasets.epoch_order(table(spark, d, "augmented_pairs").select("pair_id"), "pair_id", 7, 2, 8)


@query("steps_per_epoch", "SELECT ceil(ceil(count(*) / 72) / 7)::BIGINT AS steps FROM augmented_pairs")
def steps_per_epoch(spark, d):
    n = table(spark, d, "augmented_pairs").count()
    return spark.createDataFrame([(datasets.steps(n, 72, 7),)], "steps long")


@query("masked_loss", f"WITH {LOGITS} SELECT round(avg(-0.9 * ln(p[label + 1]) - 0.1 * list_avg(list_transform(p, lambda v: ln(v)))), 5) AS loss FROM p WHERE vec_id % 4 <> 0")
def masked_loss(spark, d):
    gold = F.when(F.col("vec_id") % 4 == 0, metrics.IGNORED).otherwise(F.col("label"))
    rows = _logits(spark, d).withColumn("gold", gold)
    return metrics.mean_loss(rows, F.col("x"), F.col("gold")).select(F.round("loss", 5).alias("loss"))


@query("special_ids", "SELECT gid, array_to_string(list_concat([101], list_transform(range(len(chars)), lambda x: x), [102]), ' ') AS ids, len(chars)::BIGINT + 2 AS types FROM confusion_groups")
def special_ids(spark, d):
    a = F.transform("chars", lambda c, i: i)
    ids = segment.with_special(a, None, 101, 102)
    return table(spark, d, "confusion_groups").select("gid", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"), F.size(segment.token_types(a)).cast("long").alias("types"))


@query("solution_labels", "SELECT template_id::VARCHAR AS pid, '1' AS loc, CASE WHEN left_text = right_text THEN '$DELETE' ELSE '$REPLACE_' || right_text END AS label FROM correction_templates WHERE left_text IS NOT NULL AND right_text IS NOT NULL")
def solution_labels(spark, d):
    t = table(spark, d, "correction_templates").where("left_text is not null and right_text is not null")
    kind = F.when(F.col("left_text") == F.col("right_text"), "冗余").otherwise("别字")
    e = F.struct(F.lit("1").alias("loc"), kind.alias("typ"), F.col("left_text").alias("wrong"), F.col("right_text").alias("correct"))
    return datasets.solution_labels(t.select(F.col("template_id").cast("string").alias("pid"), F.array(e).alias("errors")))
