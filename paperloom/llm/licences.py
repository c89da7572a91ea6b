"""Licence scan: Aho-Corasick over a text's words for notices and tags, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.runtime import bounded_batches, spread, table

# The base phrases and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Notice phrases of this scan and the labels that they add.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the mit": "mit",
    "released under the mit": "mit",
    "licensed under the apache": "apache",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

#: Families of licence identifiers by prefix, the longest first, and whether they are permissive.
FAMILIES = (("cc-by-nc", False), ("cc-by-nd", False), ("cc-by-sa", False), ("apache", True), ("cc-by", True), ("lgpl", False), ("agpl", False), ("cc0", True), ("gpl", False), ("bsd", True), ("isc", True), ("mit", True), ("mpl", False), ("epl", False), ("unlicense", True))

TAG = "spdx license identifier"
_TAG_RAW = re.compile(r"spdx-license-identifier\s*:\s*((?:(?!spdx-license-identifier\s*:)[^\r\n])*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:_-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}
#: Bytes of a text that stand in words: lower-cased ASCII letters, digits, and all bytes above ASCII; the rest become blanks.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Licence(NamedTuple):
    """The value of a licence expression: the labels in it, and whether its licensee can choose permissive terms alone."""

    labels: frozenset
    permissive: bool


def licence(name: str) -> Licence:
    """A single identifier: its family if it is known, else the identifier itself."""
    low = name.lower().rstrip("+")
    for family, permissive in FAMILIES:
        if low == family or low.startswith(family + "-") or low.startswith(family) and low[len(family) : len(family) + 1].isdigit():
            return Licence(frozenset([family]), permissive)
    return Licence(frozenset([low]), False)


def evaluate(expression: str) -> Licence | None:
    """The value of an expression of identifiers, parentheses, and, or, with (the tightest); None if it is malformed.

    ``or`` is permissive if either side is, ``and`` if both are; ``with`` adds an exception, which is no label, and keeps the left side.
    """
    out: list = []
    ops: list[str] = []

    def reduce() -> bool:
        op = ops.pop()
        if op == "(" or len(out) < 2:
            return False
        right, left = out.pop(), out.pop()
        if op == "with":
            out.append(left)
        else:
            both = left.permissive or right.permissive if op == "or" else left.permissive and right.permissive
            out.append(Licence(left.labels | right.labels, both))
        return True

    operand = True  # what may come next
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _BINDS:
            if operand:
                return None
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[low]:
                if not reduce():
                    return None
            ops.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            ops.append(token)
        elif token == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                if not reduce():
                    return None
            if not ops:
                return None
            ops.pop()
        else:
            if not operand:
                return None
            out.append(licence(token))
            operand = False
    while ops:
        if not reduce():
            return None
    return out[0] if len(out) == 1 and not operand else None


def well_formed(text: str) -> str:
    """The longest well-formed expression that the text begins with; it is read up to the first token that can't go on with it."""
    operand, depth, end = True, 0, 0
    for m in _TOKEN.finditer(text):
        binds, closes = m[0].lower() in _BINDS, m[0] == ")"
        if operand == (binds or closes) or closes and not depth:
            break
        depth += (m[0] == "(") - closes
        operand = binds or m[0] == "("
        if not operand and not depth:
            end = m.end()
    return text[:end]


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    line = b" %b " % b" ".join(words)
    line = line.decode("utf-8", "surrogatepass")
    hits = [(end - len(phrase) - 1, phrase) for end, phrase in _automaton().iter(line)]
    base = sorted(at for at, phrase in hits if phrase in BASE)
    first = last = None
    if base:
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        first, last = (int(np.searchsorted(blanks, at)) for at in (base[0], base[-1]))
    base_labels = {BASE[phrase] for _, phrase in hits if phrase in BASE}
    labels = base_labels | {NOTICES[phrase] for _, phrase in hits if phrase in NOTICES}
    expressions = []
    if any(phrase == TAG for _, phrase in hits):
        expressions = [well_formed(m[1]) for m in _TAG_RAW.finditer(text)]
    values = [v for v in map(evaluate, expressions) if v]
    for v in values:
        labels |= v.labels
    notices = {phrase for _, phrase in hits if phrase != TAG}
    score = 1.0 if values else 1.0 - 0.5 ** len(notices)
    return len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, bool(values) and all(v.permissive for v in values)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``scan`` finds in each row's whole text, beside the row's id.

    Words are runs of lower-cased ASCII letters, digits and characters above ASCII. ``n_base`` counts the
    places where a base phrase's words stand in a row, overlapping ones too. ``score`` is 1 where a tag
    with a well-formed expression stands, else it halves the doubt with every different phrase. ``permissive``
    says whether all tagged expressions can be met by permissive terms. Null and empty texts have no words,
    null places, empty labels and score 0. Repeated rows and null ids pass through; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t.as_py()) for t in b.column(1)]
            columns = zip(*found, strict=True) if found else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True))], names=[id_col, *(x.split()[0] for x in SCHEMA.split(", "))])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scanned, f"`{id_col}` {id_type}, {SCHEMA}")


def op8_licence_scan(spark, sf_dir):
    """``licence_scan`` over all ``documents``."""
    return licence_scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
