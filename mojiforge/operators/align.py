"""Alignment of text pairs: opcodes, edit labels and their application.

The sequence matching is sequential by nature, so these run as Arrow-batched
UDFs; everything else about labels is column functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPCODE = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"
EDITS = "struct<detect:array<int>,correct:array<struct<at:int,text:string>>>"
MARK = "   "  # joins a target slice for comparison


def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def case_of(a: str, b: str) -> str | None:
    if a.lower() != b.lower():
        return None
    for name, made in (("LOWER", a.lower()), ("CAPITAL", a.capitalize()), ("UPPER", a.upper()), ("CAPITAL_1", a[:1] + a[1:].capitalize()), ("UPPER_-1", a[:-1].upper() + a[-1:])):
        if made == b:
            return f"$TRANSFORM_CASE_{name}"
    return None


def transform_of(a: str, b: str, verbs: dict[str, str] | None = None) -> str | None:
    """The label that makes ``b`` of token ``a`` without replacing it, or None.  ``verbs``: "w1_w2" to "T1_T2"."""
    words = b.split()
    if len(words) > 1 and a.split("-") == words:
        return "$TRANSFORM_SPLIT_HYPHEN"
    if a == b:
        return "$KEEP"
    if label := case_of(a, b):
        return label
    if verbs and (form := verbs.get(f"{a}_{b}")):
        return f"$TRANSFORM_VERB_{form}"
    if a.endswith("s") and a[:-1] == b:
        return "$TRANSFORM_AGREEMENT_SINGULAR"
    if b.endswith("s") and a == b[:-1]:
        return "$TRANSFORM_AGREEMENT_PLURAL"
    return None


def _cost(token: str, words: list[str], verbs) -> int:
    joined = MARK.join(words)
    return 0 if transform_of(token, joined, verbs) else distance(token, joined)


def assign(tokens: list[str], words: list[str], verbs=None) -> list[list[str]]:
    """The slice of ``words`` for each token, so that the slices cover all in order at the least cost; of equals the leftmost cuts."""
    best: list[int | None] = [0] + [None] * len(words)
    steps = []
    for t in tokens:
        new: list[int | None] = [None] * len(best)
        came = [0] * len(best)
        for j, so_far in enumerate(best):
            if so_far is not None:
                for k in range(j, len(best)):
                    c = so_far + _cost(t, words[j:k], verbs)
                    if new[k] is None or c < new[k]:
                        new[k], came[k] = c, j
        steps.append(came)
        best = new
    out, k = [], len(words)
    for came in reversed(steps):
        out.append(words[came[k] : k])
        k = came[k]
    return out[::-1]


def slice_labels(token: str, words: list[str], verbs=None) -> tuple[list[str], list[str]]:
    """(labels for the place before the token, labels for the token) that make ``words`` of it."""
    if not words:
        return [], ["$DELETE"]
    for n in range(2, len(words) + 1):
        if label := transform_of(token, " ".join(words[:n]), verbs):
            return [], [label, *(f"$APPEND_{w}" for w in words[n:])]
    known = [transform_of(token, w, verbs) for w in words]
    costs = [0 if k else distance(token, w) for k, w in zip(known, words)]
    at = costs.index(min(costs))
    own = known[at] if known[at] not in (None, "$TRANSFORM_CASE_CAPITAL") else f"$REPLACE_{words[at]}"
    return [f"$APPEND_{w}" for w in words[:at]], [own, *(f"$APPEND_{w}" for w in words[at + 1 :])]


def label_lists(source: list[str], target: list[str], verbs=None) -> list[list[str]]:
    """All labels of each place, the one before the first token included; a place without any has $KEEP."""
    places: list[list[str]] = [[] for _ in range(len(source) + 1)]

    def put(place: int, labels: list[str]) -> None:
        if 0 <= place < len(places):
            places[place] += labels

    words_of = lambda part: [w for w in " ".join(part).split()] or ([" ".join(part)] if part and " ".join(part) else [])
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, source, target).get_opcodes():
        if tag == "delete":
            for i in range(i1, i2):
                put(i + 1, ["$DELETE"])
        elif tag == "insert":
            put(i1, [f"$APPEND_{w}" for w in words_of(target[j1:j2])])
        elif tag == "replace":
            mine, theirs = words_of(source[i1:i2]), words_of(target[j1:j2])
            if len(mine) > 1 and len(theirs) == 1 and (join := next((name for glue, name in (("", "SPACE"), ("-", "HYPHEN")) if glue.join(mine) == theirs[0]), None)):
                for i in range(len(mine) - 1):
                    put(i1 + i + 1, [f"$MERGE_{join}"])
            elif len(mine) == len(theirs) == 2 and mine == theirs[::-1]:
                put(i1 + 1, ["$MERGE_SWAP"])
            else:
                for n, (t, part) in enumerate(zip(mine, assign(mine, theirs, verbs))):
                    before, own = slice_labels(t, part, verbs)
                    put(i1 + n, before)
                    put(i1 + n + 1, own)
    return [x or ["$KEEP"] for x in places]


def merged(tokens: list[str]) -> list[str]:
    """Carries out $MERGE_ labels that stand between tokens."""
    out: list[str] = []
    k = 0
    while k < len(tokens):
        t = tokens[k]
        if t in ("$MERGE_SPACE", "$MERGE_HYPHEN") and out and k + 1 < len(tokens):
            out[-1] += ("" if t == "$MERGE_SPACE" else "-") + tokens[k + 1]
            k += 1
        elif t == "$MERGE_SWAP" and out and k + 1 < len(tokens):
            out.append(out.pop())
            out.insert(-1, tokens[k + 1])
            k += 1
        elif not t.startswith("$MERGE_"):
            out.append(t)
        k += 1
    return out


def apply_levels(tokens: list[str], labels: list[list[str]]) -> list[str]:
    """Carries out all labels of every place, the first ones of all places first; merges come last."""
    slots: list[list[str]] = [[] if k == 0 else [t] for k, t in enumerate(["$START", *tokens])]
    for k, ops in enumerate(labels):
        merges = []
        for op in ops:
            kind, _, word = op.partition("_")
            if op == "$DELETE":
                slots[k] = slots[k][:-1] if slots[k] else []
            elif kind == "$APPEND":
                slots[k].append(word)
            elif kind == "$REPLACE" and slots[k]:
                slots[k][-1] = word
            elif kind == "$TRANSFORM" and slots[k]:
                slots[k][-1] = transformed(slots[k][-1], op)
            elif kind == "$MERGE":
                merges.append(op)
        slots[k] += merges
    return merged([t for slot in slots for t in slot])


def transformed(token: str, label: str, forms: dict[str, str] | None = None) -> str:
    """``forms``: "w1_T1_T2" to w2."""
    kind = label.removeprefix("$TRANSFORM_")
    simple = {
        "CASE_LOWER": str.lower, "CASE_UPPER": str.upper, "CASE_CAPITAL": str.capitalize, "CASE_CAPITAL_1": lambda t: t[:1] + t[1:].capitalize(),
        "CASE_UPPER_-1": lambda t: t[:-1].upper() + t[-1:], "SPLIT_HYPHEN": lambda t: t.replace("-", " "), "AGREEMENT_PLURAL": lambda t: t + "s", "AGREEMENT_SINGULAR": lambda t: t[:-1],
    }
    if kind in simple:
        return simple[kind](token)
    if kind.startswith("VERB_"):
        return (forms or {}).get(f"{token}_{kind.removeprefix('VERB_')}", token)
    raise ValueError(f"unknown transform {label}")


def apply_spans(tokens: list[str], edits: list[tuple[int, int, str]]) -> list[str]:
    """Applies (start, end, label) edits in order of place: empty label deletes, an empty span inserts, others transform, replace or merge."""
    out, shift = list(tokens), 0
    for start, end, label in edits:
        at = start + shift
        token = out[at] if 0 <= at < len(out) else ""
        if label == "" or label == "$DELETE":
            if 0 <= at < len(out):
                del out[at]
                shift -= 1
        elif start == end:
            out.insert(at, label.removeprefix("$APPEND_"))
            shift += 1
        elif label.startswith("$TRANSFORM_"):
            out[at] = transformed(token, label)
        elif end - start == 1:
            out[at] = label.removeprefix("$REPLACE_")
        elif label.startswith("$MERGE_"):
            out.insert(at + 1, label)
            shift += 1
    return merged(out)


def character_labels(source: str, target: str) -> list[str]:
    """One label for each character and the place before the first, by replaced spans of equal length only.

    An insertion appends its first character to the one before; of a doubled
    character the later copy is deleted.
    """
    out = ["$KEEP"] * len(source)
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, source, target).get_opcodes():
        if tag == "replace" and i2 - i1 == j2 - j1:
            out[i1:i2] = [f"$REPLACE_{c}" for c in target[j1:j2]]
        elif tag == "insert" and i1:
            out[i1 - 1] = f"$APPEND_{target[j1]}"
        elif tag == "delete":
            n = i2 - i1
            later = source[i1:i2] == source[i2 : i2 + n]
            for i in range(i1 + n * later, i2 + n * later):
                out[i] = "$DELETE"
    return out


def edit_keys(source: str, target: str) -> tuple[list[int], list[tuple[int, str]]]:
    """Detection and correction keys; both empty where a replaced span changes its length."""
    detect, correct = [], []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, source, target).get_opcodes():
        if tag == "replace":
            if i2 - i1 != j2 - j1:
                return [], []
            detect += range(i1, i2)
            correct += zip(range(i1, i2), target[j1:j2])
        elif tag != "equal":
            detect.append(i1)
            correct.append((i1, "D" * (i2 - i1) if tag == "delete" else target[j1:j2]))
    return detect, correct


def _pairwise(f, kind: str):
    @F.pandas_udf(kind)
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype=object)

    return run


def opcodes(source: Column, target: Column) -> Column:
    fields = ("tag", "i1", "i2", "j1", "j2")
    return _pairwise(lambda a, b: [dict(zip(fields, x)) for x in SequenceMatcher(None, a, b).get_opcodes()], OPCODE)(source, target)


def align_labels(source: Column, target: Column) -> Column:
    """The first label of each place, over the characters of two texts."""
    return _pairwise(lambda a, b: [x[0] for x in label_lists(list(a), list(b))], "array<string>")(source, target)


def align_label_lists(source: Column, target: Column) -> Column:
    return _pairwise(lambda a, b: label_lists(list(a), list(b)), "array<array<string>>")(source, target)


def legacy_labels(source: Column, target: Column) -> Column:
    return _pairwise(character_labels, "array<string>")(source, target)


def corrected_by_levels(source: Column, labels: Column) -> Column:
    return _pairwise(lambda a, b: "".join(apply_levels(list(a), [list(x) for x in b])), "string")(source, labels)


def _edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in pairs:
        keys = [([], []) if x is None or y is None else edit_keys(x, y) for x, y in zip(a, b)]
        yield pd.DataFrame({"detect": [d for d, _ in keys], "correct": [[{"at": i, "text": t} for i, t in c] for _, c in keys]})


def edits(source: Column, target: Column) -> Column:
    """The edit keys of a pair; none for a null side."""
    return F.pandas_udf(_edits, EDITS)(source, target)


def labels_to_edits(labels: Column) -> Column:
    """(start, end, labels) of the places that aren't kept."""
    placed = F.transform(labels, lambda x, i: F.struct((i - 1).cast("int").alias("start"), i.cast("int").alias("end"), x.alias("ops")))
    return F.filter(placed, lambda e: e["ops"] != F.array(F.lit("$KEEP")))


def edits_to_labels(n_tokens: Column, found: Column) -> Column:
    """The label lists of n_tokens + 1 places, $KEEP where no edit is."""
    here = lambda i: F.flatten(F.transform(F.filter(found, lambda e: (e["start"] == i - 1) & (e["end"] == i)), lambda e: e["ops"]))
    return F.transform(F.sequence(F.lit(0), n_tokens), lambda i: F.when(F.size(here(i)) > 0, here(i)).otherwise(F.array(F.lit("$KEEP"))))
