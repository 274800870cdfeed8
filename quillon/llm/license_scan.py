"""Licence scans: exact phrases by word place, and short notices within a few edits.

Notices are searched by the pigeonhole rule: a notice that occurs with at most
``errors`` edits holds one of ``errors + 1`` pieces unchanged. The pieces are
found by one Aho-Corasick pass over the text; around each hit, and there only,
the ``regex`` library matches the whole notice within the error bound and gives
the span. Each document is scanned whole and by itself, in one map stage.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices with their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "reserved",
}
#: A-Z to a-z; all of ASCII that is neither letter nor digit to a blank; bytes from 0x80 on stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Notices:
    """``errors`` edits for each ``per`` characters of a notice, from 1 up to ``most``."""

    notices: dict[str, str] = field(default_factory=lambda: dict(NOTICES))
    per: int = 12
    most: int = 4

    def compiled(self) -> tuple[ahocorasick.Automaton, list]:
        seeds, patterns = ahocorasick.Automaton(), []
        for n, (text, label) in enumerate(self.notices.items()):
            errors = max(1, min(self.most, len(text) // self.per))
            patterns.append((regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(text)}){{e<={errors}}}(?!\S)"), text, label, errors))
            step = len(text) / (errors + 1)
            for k in range(errors + 1):
                a, b = round(k * step), round((k + 1) * step)
                seeds.add_word(text[a:b], (*seeds.get(text[a:b], ()), (n, a, b - a)))
        seeds.make_automaton()
        return seeds, patterns


def normal(text: str | None) -> str:
    """Words with A-Z lower-cased, each between single blanks, with one at either end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    return b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass") if words else ""


def base_places(flat: str, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start in words, label) of each place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        at, last, words = flat.find(f" {phrase} "), 0, 0
        while at >= 0:
            words, last = words + flat.count(" ", last, at), at
            found.append((words, label))
            at = flat.find(f" {phrase} ", at + 1)
    return found


def matches(pattern: regex.Pattern, flat: str, a: int, b: int, least: int) -> Iterator[regex.Match]:
    """The best match within ``a`` to ``b``, and those of the parts before and after it; none is shorter than ``least``."""
    parts = [(a, b)]
    while parts:
        a, b = parts.pop()
        m = pattern.search(flat, a, b) if b - a >= least else None
        if m and m.end() > m.start():
            yield m
            parts += (a, m.start()), (m.end(), b)


def fuzzy_places(flat: str, seeds: ahocorasick.Automaton, patterns: list) -> list[tuple[int, int, str, float]]:
    """(start, end, label, score) in ``flat``; score: 1 less the share of the notice that was edited."""
    spans: dict[int, list[list[int]]] = {}
    for end, hits in seeds.iter(flat):
        for n, at, size in hits:
            _, text, _, errors = patterns[n]
            a = end + 1 - size - at - errors - 1
            b = a + len(text) + 3 * errors + 2
            own = spans.setdefault(n, [])
            if own and a <= own[-1][1]:
                own[-1][1] = max(own[-1][1], b)
                own[-1][0] = min(own[-1][0], a)
            else:
                own.append([a, b])
    found = set()
    for n, own in spans.items():
        pattern, text, label, errors = patterns[n]
        for a, b in own:
            for m in matches(pattern, flat, max(0, a), min(len(flat), b), len(text) - errors):
                found.add((m.start(), m.end(), label, 1 - sum(m.fuzzy_counts) / len(text)))
    kept: list[tuple[int, int, str, float]] = []
    for x in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x)):  # of notices that overlap, as the versions of one licence do, the best
        at = bisect(kept, x)
        if (at == 0 or kept[at - 1][1] <= x[0]) and (at == len(kept) or x[1] <= kept[at][0]):
            kept.insert(at, x)
    return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices: Notices | None = None) -> DataFrame:
    """One row per row of ``docs``: base places, labels, score and ``spans``.

    ``spans`` lists the notices found as (start, end, label, score), in
    characters of the text reduced to lower-case words between single blanks.
    ``score`` is 1 where a base phrase stands, else that of the best notice,
    else 0. Null texts count as empty; null ids and repeated rows pass through;
    other columns aren't read.
    """
    phrases = PHRASES if phrases is None else phrases
    notices = notices or Notices()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,stop:long,label:string,score:double>>"
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, patterns = notices.compiled()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                flat = normal(t.as_py())
                base = base_places(flat, phrases)
                fuzzy = fuzzy_places(flat, seeds, patterns)
                at = [x for x, _ in base]
                own = {x for _, x in base}
                rows.append((
                    max(0, flat.count(" ") - 1), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[2] for x in fuzzy})),
                    1.0 if base else max((x[3] for x in fuzzy), default=0.0), [dict(zip(("start", "stop", "label", "score"), x, strict=True)) for x in sorted(fuzzy)],
                ))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, types, strict=True)]], names=[id_col, *names])

    return docs.select(id_col, text).mapInArrow(run, schema)
