"""Licence scans: Aho-Corasick over the words of whole texts, and a shunting-yard parser for
``SPDX-License-Identifier`` expressions.

The words of a text, lower-cased (A-Z), are joined by single spaces; an automaton of all phrases
runs over that, so a phrase is found wherever its words stand consecutively, whatever stands
between them. After the identifier tag the rest of the line is parsed as an and/or/with expression.

Defined results: very long texts are scanned whole, in time that grows with their length; of phrases
that begin at one word the longest counts; a null or empty text has no words, no places and no labels, score 0; an expression
that can't be parsed adds the label ``unparsed``; repeated rows are scanned each on its own; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.wordscan import Words, byte_class, text_chunks

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method's own and their labels.
NOTICES = {
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "public domain": "public-domain",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "isc license": "isc",
    "boost software license": "bsl",
    "all rights reserved": "all-rights-reserved",
    "academic free license": "afl",
    "apache software license": "apache",
    "artistic license": "artistic",
    "blue oak model license": "blueoak",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "business source license": "busl",
    "cecill": "cecill",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "european union public licence": "eupl",
    "free documentation license": "gfdl",
    "gnu general public licence": "gpl",
    "mit no attribution": "mit",
    "microsoft public license": "ms-pl",
    "new bsd license": "bsd",
    "open database license": "odbl",
    "open font license": "ofl",
    "open government licence": "ogl",
    "open software license": "osl",
    "proprietary and confidential": "proprietary",
    "python software foundation license": "psf",
    "server side public license": "sspl",
    "simplified bsd license": "bsd",
    "the software is provided as is without warranty of any kind": "mit",
    "unlicense": "unlicense",
    "zlib license": "zlib",
}
TAG = "spdx license identifier"
#: How freely a text under a licence may be used, by the start of its identifier; the longest start counts.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "0bsd": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "all-rights-reserved": 0.0, "unparsed": 0.0,
    "afl": 1.0, "artistic": 1.0, "blueoak": 1.0, "psf": 1.0, "ofl": 0.9, "ogl": 0.9, "ms-pl": 0.8, "cddl": 0.7, "cpl": 0.7, "eupl": 0.5, "cecill": 0.5, "osl": 0.5, "odbl": 0.5, "gfdl": 0.4, "busl": 0.1, "sspl": 0.1, "proprietary": 0.0,
}
UNKNOWN_FREEDOM = 0.5

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
CLASSES = byte_class(SEPARATORS)
LOWER = np.arange(256, dtype="uint8")
LOWER[65:91] += 32

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_notices long, expressions string"
OPERATORS = {"or": 1, "and": 2, "with": 3}


def freedom(label: str) -> float:
    starts = [k for k in FREEDOM if label == k or label.startswith(k + "-") or label.startswith(k + ".")]
    return FREEDOM[max(starts, key=len)] if starts else UNKNOWN_FREEDOM


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard; raises ValueError if it isn't an expression."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    tokens = re.findall(r"\(|\)|[A-Za-z0-9.+:-]+", expression)
    for token in tokens:
        low = token.lower()
        if low in OPERATORS:
            if operand_next:
                raise ValueError(expression)
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise ValueError(expression)
            stack.append(token)
        elif token == ")":
            if operand_next or "(" not in stack:
                raise ValueError(expression)
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if not operand_next:
                break  # prose after the expression
            out.append(low)
            operand_next = False
    if operand_next or "(" in stack:
        raise ValueError(expression)
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """The identifiers, and the freedom of the whole: the best of a choice, the least of a
    conjunction; an exception leaves its licence's."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in OPERATORS:
            stack.append(({token.rstrip(".")}, freedom(token.rstrip("."))))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, a))
        else:
            stack.append((left | right, max(a, b) if token == "or" else min(a, b)))
    return stack[0]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _scan(data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
    # a line feed between the texts keeps the words of neighbours apart
    inner = offsets[1:-1]
    data = np.insert(data, inner, 10) if len(inner) else data
    offsets = offsets + np.minimum(np.arange(len(offsets)), len(offsets) - 2)
    ends = np.append(offsets[1:-1] - 1, offsets[-1]) if len(inner) else offsets[1:]
    low = LOWER[data]
    words = Words(low, offsets, CLASSES)
    inside = CLASSES[low]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    norm = np.where(inside, low, np.uint8(32))[keep]
    line = " " + norm.tobytes().decode("latin-1") + " "
    size = words.end - words.start + 1
    place = np.cumsum(size) - size + 1
    first = words.first
    places: dict[int, list[tuple[int, int, str]]] = {}
    for end, phrase in automaton().iter(line):
        w = int(np.searchsorted(place, end - len(phrase)))
        doc = int(np.searchsorted(first, w, side="right")) - 1
        last = w + phrase.count(" ")
        if last < first[doc + 1]:
            places.setdefault(doc, []).append((w, last, phrase))
    n = len(offsets) - 1
    out = {"n_words": words.counts().tolist(), "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "n_notices": [0] * n, "expressions": [""] * n}
    for doc, found in places.items():
        base = [(w - int(first[doc]), BASE_PHRASES[p]) for w, _, p in found if p in BASE_PHRASES]
        labels, worst, expressions, reach = {b for _, b in base}, 1.0, [], -1
        # by start, the longest first: a notice within a longer one, which then stands before it, counts as the longer
        for w, last, p in sorted(found, key=lambda x: (x[0], -x[1])):
            if p in NOTICES:
                if last > reach:
                    labels.add(NOTICES[p])
                    out["n_notices"][doc] += 1
                    reach = last
            elif p == TAG:
                rest = data[words.end[last] : ends[doc]].tobytes().decode("utf-8", "replace").split("\n")[0].lstrip(": \t").strip()
                try:
                    names, value = evaluate(to_postfix(rest))
                    expressions.append(rest)
                except ValueError:
                    names, value = {"unparsed"}, 0.0
                labels |= names
                worst = min(worst, value)
        tagged = any(p == TAG for _, _, p in found)
        plain = labels if not tagged else {BASE_PHRASES[p] for _, _, p in found if p in BASE_PHRASES} | {NOTICES[p] for _, _, p in found if p in NOTICES}
        out["n_base"][doc] = len(base)
        if base:
            out["first_word"][doc], out["last_word"][doc] = min(base)[0], max(base)[0]
        out["base_labels"][doc] = ",".join(sorted({b for _, b in base}))
        out["labels"][doc] = ",".join(sorted(labels))
        out["score"][doc] = min([worst, *(freedom(x) for x in plain)]) if labels else 0.0
        out["expressions"][doc] = "; ".join(expressions)
    return out


def scanned(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row for each document."""

    def run(batches):
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "n_notices": pa.int64()}
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(1)):
                out = {"doc_id": b.column(0).slice(lo, hi - lo), **_scan(data, offsets)}
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_pydict({k: out[k] if k == "doc_id" else pa.array(out[k], types.get(k, pa.float64() if k == "score" else pa.string())) for k in names})

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
