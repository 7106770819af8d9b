"""Column functions on text.  Each keeps nulls null and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
# What the corpus cleaning keeps, and the marks it drops from a text's beginning.
KEPT = r"a-zA-Z0-9一-龥+—！，。？、~@#￥%……&*（）.!/<>“”,$^(\"'"
LEADING = r"+—！，。？、~@#￥%……&*.!/,$^"
SENTENCE_MARKS = "[！？。~…….!;；]+"
TOKEN_SEPARATORS = ("SEPL|||SEPR", "SEPL__SEPR", "SEPL---SEPR")
ILLEGAL = rf"\s+|[^{KEPT}]+|^[{LEADING}]+"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def half_width(c: Column) -> Column:
    """Full-width ASCII and the ideographic space to half width."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def uniform(c: Column) -> Column:
    return F.lower(half_width(c))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_illegal(c: Column) -> Column:
    """Drops white space, characters outside the kept set, and a leading run of marks."""
    return F.regexp_replace(strip(c), ILLEGAL, "")


def letter_digit_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)[A-Za-z0-9\s]"))


def is_sentence_ok(c: Column, min_len: int = 10, most: float = 0.1) -> Column:
    """Long enough and not mostly letters, digits and white space; blank is not ok, null is null."""
    n = F.char_length(c)
    return (F.length(strip(c)) > 0) & (n >= min_len) & (letter_digit_count(c) / F.greatest(n, F.lit(1)) <= most)


def free_of_separators(c: Column) -> Column:
    """Whether none of the tagged-line separators occurs (a blank is allowed)."""
    out = F.lit(True)
    for s in TOKEN_SEPARATORS:
        out = out & ~F.contains(c, F.lit(s))
    return out


def chars(c: Column) -> Column:
    """The code points as an array; empty for an empty text."""
    return F.when(F.char_length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def dominant_mark(c: Column) -> Column:
    """The most frequent run of sentence marks, of equals the first; null where there is none."""
    count = lambda runs: F.array_max(F.transform(F.array_distinct(runs), lambda x, i: F.struct(F.size(F.filter(runs, lambda y: y == x)).alias("n"), (-i).alias("first"), x.alias("mark"))))["mark"]
    return let(F.regexp_extract_all(c, F.lit(SENTENCE_MARKS), 0), count)


def split_dominant(c: Column, min_len: int | None = None) -> Column:
    """Pieces between the dominant mark, each with the mark again (the empty tail too); the whole text where there is none.

    With ``min_len`` pieces that aren't ok without the mark are dropped.
    """
    def cut(mark: Column) -> Column:
        pieces = F.split(c, quoted(mark), -1)
        if min_len is not None:
            pieces = F.filter(pieces, lambda x: is_sentence_ok(x, min_len))
        return F.when(mark.isNull(), F.array(c)).otherwise(F.transform(pieces, lambda x: F.concat(x, mark)))

    return F.when(c.isNotNull(), let(dominant_mark(c), cut))


def segment(c: Column, max_len: int = 128, min_len: int = 10) -> Column:
    """A raw text's sentences: half width, cleaned, cut at full stops where too long, filtered, cut again at the dominant mark."""
    cut = lambda clean: F.when(F.char_length(clean) > max_len, F.transform(F.split(clean, "。", -1), lambda x: F.concat(x, F.lit("。")))).otherwise(F.array(clean))
    stops = let(remove_illegal(half_width(c)), cut)
    good = F.filter(stops, lambda x: is_sentence_ok(x, min_len))
    return F.flatten(F.transform(good, lambda x: F.when(F.char_length(x) > max_len, split_dominant(x, min_len)).otherwise(F.array(x))))


def split_tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits and marks together, any other character alone; spaces separate."""
    return F.regexp_extract_all(c, F.lit(r"[!-~]+|[^ !-~]"), 0)


def words_of(c: Column) -> Column:
    """The runs of a text between white space; a text of white space only is one, an empty or null one none."""
    runs = F.filter(F.split(c, r"(?U)\s+", -1), lambda x: x != "")
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.array().cast("array<string>")).when(F.size(runs) == 0, F.array(c)).otherwise(runs)


def drop_repeated(tokens: Column) -> Column:
    """Without tokens equal to the one before."""
    return let(tokens, lambda t: F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1))))


def normalize(c: Column) -> Column:
    """Repeated words dropped, typewriter quotes and dashes replaced, lower case."""
    s = F.array_join(drop_repeated(F.split(c, " ", -1)), " ")
    for a, b in (("''", '"'), ("--", "—"), ("`", "'"), ("'ve", "' ve")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.lower(s)


def chunks(tokens: Column, size: int = 10) -> Column:
    """Consecutive groups of ``size`` tokens; a short list is one group."""
    number = lambda t: F.greatest(F.ceil(F.size(t) / size), F.lit(1)).cast("int")
    return let(tokens, lambda t: F.transform(F.sequence(F.lit(0), number(t) - 1), lambda i: F.slice(t, i * size + 1, F.lit(size))))


def padded(number: Column, width: int | Column) -> Column:
    text = number.cast("string")
    zeros = F.repeat(F.lit("0"), F.greatest((F.lit(width) if isinstance(width, int) else width) - F.length(text), F.lit(0)).cast("int"))
    return F.concat(zeros, text)


def capitalize(c: Column) -> Column:
    """First letter upper, the rest lower, of the whole text."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def case_label(source: Column, target: Column) -> Column:
    """The case transform that makes ``target`` of ``source``, or null."""
    rest = F.concat(F.substring(source, 1, 1), capitalize(F.substring(source, 2, 1 << 30)))
    n = F.char_length(source)
    most = F.concat(F.upper(F.substring(source, F.lit(1), n - 1)), F.substring(source, n, F.lit(1)))
    tag = lambda x: F.lit(f"$TRANSFORM_CASE_{x}")
    return F.when(
        F.lower(source) == F.lower(target),
        F.when(F.lower(source) == target, tag("LOWER")).when(capitalize(source) == target, tag("CAPITAL")).when(F.upper(source) == target, tag("UPPER")).when(rest == target, tag("CAPITAL_1")).when(most == target, tag("UPPER_-1")),
    )


def plural_label(source: Column, target: Column) -> Column:
    return F.when(F.endswith(source, F.lit("s")) & (source == F.concat(target, F.lit("s"))), F.lit("$TRANSFORM_AGREEMENT_SINGULAR")).when(target == F.concat(source, F.lit("s")), F.lit("$TRANSFORM_AGREEMENT_PLURAL"))


def transform_token(token: Column, label: Column) -> Column:
    """Applies a case, split or agreement transform; other labels leave the token, an unknown transform fails."""
    n = F.char_length(token)
    return (
        F.when(label == "$TRANSFORM_CASE_LOWER", F.lower(token))
        .when(label == "$TRANSFORM_CASE_UPPER", F.upper(token))
        .when(label == "$TRANSFORM_CASE_CAPITAL", capitalize(token))
        .when(label == "$TRANSFORM_CASE_CAPITAL_1", F.concat(F.substring(token, 1, 1), capitalize(F.substring(token, 2, 1 << 30))))
        .when(label == "$TRANSFORM_CASE_UPPER_-1", F.concat(F.upper(F.substring(token, F.lit(1), n - 1)), F.substring(token, n, F.lit(1))))
        .when(label == "$TRANSFORM_SPLIT_HYPHEN", F.replace(token, F.lit("-"), F.lit(" ")))
        .when(label == "$TRANSFORM_AGREEMENT_PLURAL", F.concat(token, F.lit("s")))
        .when(label == "$TRANSFORM_AGREEMENT_SINGULAR", F.substring(token, F.lit(1), n - 1))
        .when(F.startswith(label, F.lit("$TRANSFORM")) & ~F.startswith(label, F.lit("$TRANSFORM_VERB_")), F.raise_error(F.concat(F.lit("unknown transform "), label)).cast("string"))
        .otherwise(token)
    )


def apply_tags(tokens: Column, labels: Column) -> Column:
    """The corrected text of a tagger's output: keep, delete, replace, append; any other label drops its token."""
    suffix = lambda x: F.regexp_extract(x, "[^_]*$", 0)
    piece = lambda t, x: (
        F.when(F.contains(x, F.lit("KEEP")), t).when(F.contains(x, F.lit("DELETE")), F.lit("")).when(x.startswith("$REPLACE_"), suffix(x)).when(x.startswith("$APPEND_"), F.concat(t, suffix(x))).otherwise(F.lit(""))
    )
    return F.array_join(F.zip_with(tokens, labels, piece), "")


def encode_tagged(tokens: Column, labels: Column) -> Column:
    """Tokens (a leading $START added) and their label lists as one line."""
    with_start = F.concat(F.array(F.lit("$START")), tokens)
    return F.array_join(F.zip_with(with_start, labels, lambda t, x: F.concat(t, F.lit("SEPL|||SEPR"), F.array_join(x, "SEPL__SEPR"))), " ")


def decode_tagged(line: Column) -> Column:
    """The line's (token, labels) structs again."""
    parts = F.transform(F.split(line, " ", -1), lambda x: F.split(x, r"\QSEPL|||SEPR\E", -1))
    return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("token"), F.split(F.get(p, F.lit(1)), "SEPL__SEPR", -1).alias("labels")))


def multiset_ratio(a: Column, b: Column) -> Column:
    """Twice the common characters, counted with repetition, over all characters; 1 for two empty texts."""
    def shared(distinct: Column) -> Column:
        times = lambda side, x: F.char_length(side) - F.char_length(F.replace(side, x, F.lit("")))
        return F.aggregate(distinct, F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))

    common = let(F.array_distinct(chars(a)), shared)
    n = F.char_length(a) + F.char_length(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * common / n)


# Tone-marked vowels and their letter and tone.
TONES = {"ā": "a1", "á": "a2", "ǎ": "a3", "à": "a4", "ō": "o1", "ó": "o2", "ǒ": "o3", "ò": "o4", "ē": "e1", "é": "e2", "ě": "e3", "è": "e4", "ī": "i1", "í": "i2", "ǐ": "i3", "ì": "i4", "ū": "u1", "ú": "u2", "ǔ": "u3", "ù": "u4", "ǖ": "ü1", "ǘ": "ü2", "ǚ": "ü3", "ǜ": "ü4", "ń": "n2", "ň": "n3", "ǹ": "n4", "ḿ": "m2"}


def pinyin_digits(c: Column) -> Column:
    """A syllable with a tone mark to plain letters and the tone's digit at the end."""
    marked = "".join(TONES)
    mark = F.regexp_extract(c, f"[{marked}]", 0)
    tone = F.translate(mark, marked, "".join(x[1] for x in TONES.values()))
    return F.concat(F.translate(c, marked, "".join(x[0] for x in TONES.values())), tone)
