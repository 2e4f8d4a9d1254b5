"""License scan: one Aho-Corasick pass over the words of a text, and a shunting-yard parser for tagged licence expressions.

Base phrases are found wherever their words stand consecutively. Beyond them the scan knows notice phrases of common
licences and the expressions after an identifier tag, such as `SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase to label, the base of the scan. Fixed values.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice phrases of well-known licences to labels of their own. Fixed values.
NOTICE_PHRASES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
}
TAG = "spdx license identifier"

#: Lower-case identifiers of an expression to labels. Fixed values; those of a family and references count too, and others as in _accepted.
IDENTIFIERS = {"mit": "mit", "apache-2.0": "apache", "isc": "isc", "cc0-1.0": "cc0", "unlicense": "unlicense"}
FAMILIES = ("agpl", "lgpl", "gpl", "bsd", "mpl", "epl", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by", "apache")
#: Identifiers without a number that are labels of their own.
PLAIN = frozenset(("zlib", "0bsd", "wtfpl", "postgresql", "openssl", "ncsa", "x11", "hpnd", "beerware", "curl", "ftl", "ijg", "libpng", "ms-pl", "ms-rl", "ruby", "sleepycat", "tcl", "vim", "w3c", "naist-2003", "fsfap", "json", "none", "noassertion"))

#: Licences whose works may be used freely, for the score of an expression.
OPEN = frozenset(("mit", "apache", "bsd", "isc", "cc0", "unlicense", "public-domain", "cc-by", "zlib", "0bsd", "mit-0", "bsl-1.0", "wtfpl", "postgresql", "ncsa", "x11", "hpnd", "curl", "ftl", "libpng", "artistic-2.0", "python-2.0", "psf-2.0", "ofl-1.1", "blueoak-1.0.0", "upl-1.0"))

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+():\x20\t-]*)", re.IGNORECASE | re.ASCII)
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str | None:
    """The label of a known licence identifier; None for any other word."""
    name = identifier.strip(".-").rstrip("+")
    if name.startswith(("licenseref-", "documentref-")) or name in PLAIN:
        return name
    return IDENTIFIERS.get(name) or next((f for f in FAMILIES if name == f or name.startswith(f"{f}-")), None)


def _accepted(token: str, before: str | None, after: str | None) -> str | None:
    """The label of an operand, given the tokens around it; None if it is prose.

    Known identifiers always count, and exceptions after WITH. Other words count if the grammar around them holds and they look like identifiers: with
    a digit or a hyphen, or next to an operator or bracket in capitals or alone behind the tag. What follows them must be an operator, a closing bracket or the end.
    """
    name = token.lower().strip(".-:")
    if not name:
        return None
    known = label_of(name) if before is None or before.lower() != "with" else name if "exception" in name else None
    if known:
        return known
    if after is not None and after != ")" and after.lower() not in _STRENGTH:
        return None
    alone = before is None and after is None
    formal = any(t is not None and (t in "()" or t.isupper() and t.lower() in _STRENGTH) for t in (before, after))
    shaped = bool(re.search(r"[0-9]|[a-z]-[a-z]", name)) and bool(re.search("[a-z]", name))
    return name.rstrip("+") if shaped or formal or alone else None


@dataclass(frozen=True)
class Expression:
    """A parsed expression: the labels it names and the share of them that is open (OR takes the best branch, AND the worst)."""

    labels: frozenset
    openness: float


def parse_expression(text: str) -> Expression | None:
    """Shunting-yard over `a AND (b OR c WITH d)`: WITH binds closest, then AND, then OR; operators in any case.

    Reads the longest well-formed head of the text, as a tag may be followed by prose: it ends before the first word that is no operand by
    _accepted. Exceptions, and identifiers that are not known, are labels of their own. None if there is no identifier.
    """
    tokens = _TOKEN.findall(text)
    # cut where two operands meet or a bracket closes too much, as prose begins there
    depth, head, operand = 0, [], False
    for i, t in enumerate(tokens):
        low, after = t.lower(), tokens[i + 1] if i + 1 < len(tokens) else None
        if t == "(":
            if operand:
                break
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif low in _STRENGTH:
            if not operand:
                break
            operand = False
            head.append((low, None))
            continue
        else:
            label = None if operand else _accepted(t, tokens[i - 1] if i else None, after)
            if label is None:
                break
            operand = True
            head.append((low, label))
            continue
        head.append((t, None))
    while head and (head[-1][0] in _STRENGTH or head[-1][0] == "("):
        depth -= head[-1][0] == "("
        head.pop()
    head += [(")", None)] * max(0, depth)

    values: list[Expression] = []
    ops: list[str] = []

    def apply() -> None:
        op, b, a = ops.pop(), values.pop(), values.pop()
        if op == "with":
            values.append(Expression(a.labels | b.labels, a.openness))
        elif op == "and":
            values.append(Expression(a.labels | b.labels, min(a.openness, b.openness)))
        else:
            values.append(Expression(a.labels | b.labels, max(a.openness, b.openness)))

    for t, label in head:
        if label is not None:
            values.append(Expression(frozenset([label]), float(label in OPEN)))
        elif t == "(":
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                apply()
            if ops:
                ops.pop()
        else:
            while ops and ops[-1] != "(" and _STRENGTH[ops[-1]] >= _STRENGTH[t]:
                apply()
            ops.append(t)
    while ops:
        if ops[-1] == "(":
            ops.pop()
        else:
            apply()
    return values[0] if values and values[0].labels else None


class Scanner:
    """The automaton over ' '-joined words; made once a task."""

    def __init__(self, base: dict[str, str], notices: dict[str, str]) -> None:
        try:
            import ahocorasick
        except ImportError as e:
            raise ImportError("the licence scan needs the package pyahocorasick on all executors") from e

        self.auto = ahocorasick.Automaton()
        for phrase in {*base, *notices, TAG}:
            self.auto.add_word(f" {phrase} ", phrase)
        self.auto.make_automaton()
        self.base, self.notices = base, notices

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        """(words, base places, first and last word of them, base labels, all labels, score)."""
        low = text.translate(_LOWER)
        words = _WORD.findall(low)
        line = f" {' '.join(words)} "
        places, base, more, tagged = [], set(), set(), False
        for end, phrase in self.auto.iter(line):
            if phrase in self.base:
                places.append(end - len(phrase) - 1)
                base.add(self.base[phrase])
            if phrase in self.notices:
                more.add(self.notices[phrase])
            tagged = tagged or phrase == TAG
        # spaces before the first and the last place, each counted once
        places.sort()
        starts = [line.count(" ", 0, p) for p in (places[0], places[-1])] if places else []
        openness = [float(x in OPEN) for x in more | base]
        if tagged:
            for m in _TAGGED.finditer(text):
                e = parse_expression(m[1])
                if e:
                    more |= e.labels
                    openness.append(e.openness)
        score = min(openness) if openness else 0.0
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of `docs`: words, places of base phrases, and the labels of base phrases, notices and expressions.

    `score` is 1 if every licence found allows free use (of an OR its best branch), 0 if one does not or none is found.
    Null and empty texts have no words and empty labels. Overlapping places all count. Repeated rows are each answered.
    """
    base, notices = base or BASE_PHRASES, NOTICE_PHRASES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = [scanner.scan(t.as_py() or "" if t.is_valid else "") for t in batch.column(1)]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)
