"""License scan: Aho-Corasick over notice phrases and identifier tags, and a shunting-yard
evaluator of licence expressions (operator 2).

A text is folded to its words (A-Z lower-cased; runs of characters other than a-z, 0-9 and
non-ASCII ones), joined by single spaces, and one automaton finds all places of all phrases.
Where the tag ``SPDX-License-Identifier`` occurs, the expression after it is read from the text
itself (up to the first token that no longer belongs to it, the next tag or the end of the line,
however long that is), turned into postfix order by the shunting-yard method (``WITH`` binds closer than
``AND``, ``AND`` closer than ``OR``) and evaluated against a set of allowed identifiers.

Edge cases: a null or empty text has no words, no labels and score 0; overlapping places all
count; a malformed expression yields its identifiers as labels but no verdict (null); a tag counts for the score only with a well-formed one; repeated
rows are scanned one by one; other columns are never read.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.llm.scratch import bound_batches

#: Notice phrase -> label (fixed values of the query's contract).
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: More notice phrases -> (label, weight of the evidence).
MORE_PHRASES = {
    "gnu lesser general public license": ("lgpl", 0.95),
    "gnu affero general public license": ("agpl", 0.95),
    "mozilla public license": ("mpl", 0.95),
    "bsd license": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "isc license": ("isc", 0.9),
    "cc0": ("cc0", 0.8),
    "creative commons attribution": ("cc-by", 0.9),
    "cc by nc": ("cc-by-nc", 0.95),
    "cc by sa": ("cc-by-sa", 0.95),
    "cc by nd": ("cc-by-nd", 0.95),
    "public domain": ("public-domain", 0.5),
    "all rights reserved": ("all-rights-reserved", 0.7),
}
BASE_WEIGHT, TAG_WEIGHT = 0.9, 1.0
TAG = "spdx license identifier"
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*", re.I)
_LINE_END = re.compile(r"[\r\n]|SPDX-License-Identifier:", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:_-]+")
#: Identifiers that a training corpus may take by default.
ALLOWED = frozenset(["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense", "cc-by-4.0"])
_BINDS = {"or": 1, "and": 2, "with": 3}
#: Bytes -> a-z, 0-9, non-ASCII kept, A-Z lower-cased, all others a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES.items():
        a.add_word(f" {phrase} ", (phrase, label, BASE_WEIGHT, True))
    for phrase, (label, weight) in MORE_PHRASES.items():
        a.add_word(f" {phrase} ", (phrase, label, weight, False))
    a.add_word(f" {TAG} ", (TAG, None, TAG_WEIGHT, False))
    a.make_automaton()
    return a


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, lower-cased; None if it is malformed."""
    return parsed(expression, 0, len(expression))[0]


def parsed(text: str, start: int, stop: int) -> tuple[list[str] | None, list[str], int]:
    """The expression from ``start`` on in postfix order (None if it is malformed), its
    identifiers, and where it ends: before the first token that doesn't belong to it."""
    out: list[str] = []
    names: list[str] = []
    end = start
    stack: list[str] = []
    operand = False  # whether the last token completes an operand
    for found in _TOKEN.finditer(text, start, stop):
        token = found[0]
        low = token.lower()
        if low in _BINDS:
            if not operand:
                return None, names, end
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == ")":
            if not operand:
                return None, names, end
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None, names, end
            stack.pop()
        elif operand:  # two operands side by side: what follows is no part of the expression
            break
        elif token == "(":
            stack.append("(")
        else:
            out.append(low)
            names.append(low)
            operand = True
        end = found.end()
    if not operand or "(" in stack:
        return None, names, end
    return out + stack[::-1], names, end


def evaluate(order: list[str], allowed: frozenset[str] = ALLOWED) -> bool:
    """Whether a reader who accepts the allowed identifiers may use the text.

    ``or`` offers a choice, ``and`` asks for both; ``with`` adds an exception to the licence on
    its left, which only widens what that licence allows."""
    stack: list[bool] = []
    for token in order:
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left and right if token == "and" else left or right)
        else:
            stack.append(token.rstrip("+") in allowed)
    return stack[0]


def scan(text: str, find: ahocorasick.Automaton, allowed: frozenset[str] = ALLOWED) -> tuple:
    words = text.encode().translate(_FOLD).split()
    folded = f" {b' '.join(words).decode()} "
    places, base, labels, missing = [], set(), set(), 1.0
    expressions, permitted, tagged = [], None, False
    seen = at = 0  # words that began before the place ``at``
    for end, (phrase, label, weight, is_base) in find.iter(folded):
        if is_base:
            seen, at = seen + folded.count(" ", at, end), end
            places.append(seen - phrase.count(" ") - 1)
            base.add(label)
        if label is None:
            tagged = True
        else:
            labels.add(label)
            missing *= 1 - weight
    if tagged:
        for found in _TAG.finditer(text):
            line_end = _LINE_END.search(text, found.end())
            order, names, end = parsed(text, found.end(), line_end.start() if line_end else len(text))
            expressions.append(text[found.end():end])
            labels.update(names)
            if order is not None:
                missing *= 1 - TAG_WEIGHT
                verdict = evaluate(order, allowed)
                permitted = verdict if permitted is None else permitted and verdict
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1 - missing, "; ".join(x for x in expressions if x) or None, permitted)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, expressions string, permitted boolean")


def license_scan(docs: DataFrame, allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """One row per row of docs (see SCHEMA); no shuffle."""
    bound_batches(docs.sparkSession)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        find = automaton()
        for b in batches:
            rows = [scan(x.as_py() or "", find, allowed) for x in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
