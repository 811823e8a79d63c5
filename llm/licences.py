"""License scan: normalised text compared to licence templates by Dice coefficient over word bigrams.

Units of comparison are the whole text, each of its lines, and stretches of it: for templates of ``LONG`` pairs
or more all stretches of words, for shorter ones all runs of whole lines.  So a notice is found that is wrapped
or stands within other text; only a short one has to have its lines to itself.  Normalising lower-cases A-Z and takes
words, the runs of letters, digits and characters beyond ASCII.  A unit's set holds its distinct word pairs
(its word, if it has one only).  Two sets of a and b pairs can reach a coefficient of t only if
``a * t / (2 - t) <= b <= a * (2 - t) / t``, so a template is compared only with units of fitting size.
Stretches are tried only in texts that hold ``t / (2 - t)`` of a template's pairs, which any match has.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.textops import Words, mix, pieces, raw, windows
from llm.toxicity import SOLID

THRESHOLD = 0.8
# templates with so many pairs are looked for at any word of a text
LONG = 20
# bounds are this much wider than computed
ROUND = 1e-6
# short notices, the templates of ``scan_sql``; whole texts and notices are in ``licence_texts``
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so.",
    "all-rights-reserved": "All rights reserved.",
}


@functools.cache
def whole_texts() -> dict[str, str]:
    """Standard licence texts and notices by name."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pair hashes of each unit: the hashes, the unit of each, and the number in each unit."""
    w = Words(data, offsets, lower=True, solid=SOLID)
    h = w.hashes()
    first, unit = w.window_starts(2)
    single = np.flatnonzero(w.counts == 1)
    pair = np.concatenate([windows(h, first, 2), mix(h[w.at[:-1][single]])])
    unit = np.concatenate([unit, single])
    order = np.lexsort((pair, unit))
    pair, unit = pair[order], unit[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1])
    pair, unit = pair[new], unit[new]
    return pair, unit, np.bincount(unit, minlength=len(offsets) - 1)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.names = sorted(templates)
        texts = [templates[n].encode() for n in self.names]
        offsets = np.cumsum([0, *map(len, texts)])
        pair, unit, self.sizes = _sets(np.frombuffer(b"".join(texts), np.uint8), offsets)
        self.pairs = [pair[unit == i] for i in range(len(texts))]
        self.any = np.unique(pair)
        self.holds = np.stack([np.isin(self.any, p) for p in self.pairs], axis=1) if texts else np.zeros((0, 0), bool)
        self.threshold = threshold

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest coefficient of each unit and its template (-1 below the threshold; the first name among equals)."""
        pair, unit, size = _sets(data, offsets)
        top, which = np.zeros(len(size)), np.full(len(size), -1)
        shared = np.isin(pair, self.any)
        pair, unit = pair[shared], unit[shared]
        t = self.threshold
        for i, (own, n) in enumerate(zip(self.pairs, self.sizes)):
            fits = (size[unit] >= n * t / (2 - t)) & (size[unit] <= n * (2 - t) / t)
            hits = np.bincount(unit[fits][np.isin(pair[fits], own)], minlength=len(size))
            dice = 2 * hits / np.maximum(size + n, 1)
            better = (dice >= t) & (dice > top)
            top[better], which[better] = dice[better], i
        return top, which

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Texts and templates, of whose pairs the text holds as many as any match needs."""
        pair, unit, _ = _sets(data, offsets)
        at = np.searchsorted(self.any, pair)
        known = np.flatnonzero(at < len(self.any))
        known = known[self.any[at[known]] == pair[known]]
        if not len(known):
            return []
        at, unit = at[known], unit[known]
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        hits = np.add.reduceat(self.holds[at], first, axis=0, dtype=np.int64)
        i, k = np.nonzero((hits > 0) & (hits >= self.sizes * self.threshold / (2 - self.threshold) - ROUND))
        return list(zip(unit[first[i]].tolist(), k.tolist()))

    def stretch(self, data: np.ndarray, templates: list[int], least: float) -> tuple[float, int, int] | None:
        """The best stretch of one text with more than ``least``: coefficient, template and line of its first word.

        Equal ones go to the largest template, then the first line, then the first name.
        """
        w = Words(data, np.array([0, len(data)]), lower=True, solid=SOLID)
        if len(w.starts) < 2:
            return None
        pair = windows(w.hashes(), np.arange(len(w.starts) - 1), 2)
        line = np.searchsorted(np.flatnonzero(data == 10), w.starts)
        order = np.argsort(pair, kind="stable")
        before = np.full(len(pair), -1)
        same = pair[order[1:]] == pair[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        heads = np.r_[True, line[1:] != line[:-1]][:-1]  # pairs that start and end a line
        tails = np.r_[line[1:] != line[:-1], True][1:]
        t, found = self.threshold, None
        for k in templates:
            n = int(self.sizes[k])
            need, most = n * t / (2 - t) - ROUND, n * (2 - t) / t + ROUND
            own = np.isin(pair, self.pairs[k])
            # the ends of a best stretch of words are pairs of the template
            starts, ends = (own, own) if n >= LONG else (heads, tails)
            left = np.cumsum(own[::-1])[::-1]
            for s in np.flatnonzero(starts):
                if left[s] < need:
                    break
                span = int(most) + 1
                while True:  # longer where pairs repeat
                    new = before[s : s + span] < s
                    size = np.cumsum(new)
                    if size[-1] > most or s + span >= len(pair):
                        break
                    span *= 2
                hits = np.cumsum(new & own[s : s + span])
                if hits[-1] < need:
                    continue
                dice = np.where(ends[s : s + span] & (size <= most), 2 * hits / (size + n), 0.0)
                top = float(dice.max())
                if top >= t and top > least:
                    here = (-top, -n, int(line[s]), k)
                    found = here if found is None else min(found, here)
        return found and (-found[0], found[3], found[2])


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """``keep`` of every document with ``licence``, ``dice`` and ``line`` of its best match.

    ``line`` counts lines from 0, is that of a stretch's first word, and is -1 where the whole text matches better than
    any part.  Equal coefficients go to the whole text, then lines before stretches (of these the one with the
    largest template), then the first line, then the first name.  Without a match (null and empty texts too) all
    three are null.  Repeated rows are scanned alike.  Without ``templates`` these are ``TEMPLATES`` and ``whole_texts``.
    """
    templates = TEMPLATES | whole_texts() if templates is None else templates
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in pieces(batches, "__text"):
            data, offsets = raw(b.column("__text"))
            n = len(offsets) - 1
            top, which = scanner.best(data, offsets)
            line = np.where(which >= 0, -1, -2)
            cuts = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
            dice, name = scanner.best(data, cuts)
            at = np.flatnonzero(name >= 0)
            owner = np.searchsorted(offsets, cuts[at], "right") - 1
            for i, u in zip(owner, at):  # lines in order: a later one must be better
                if dice[u] > top[i]:
                    top[i], which[i] = dice[u], name[u]
                    line[i] = u - np.searchsorted(cuts, offsets[i])
            parts: dict[int, list[int]] = {}
            for i, k in scanner.candidates(data, offsets):
                if top[i] < 1:
                    parts.setdefault(i, []).append(k)
            for i, found in parts.items():
                if part := scanner.stretch(data[offsets[i] : offsets[i + 1]], found, top[i]):
                    top[i], which[i], line[i] = part
            none = which < 0
            columns = [
                pa.array([scanner.names[k] if k >= 0 else None for k in which], pa.string()),
                pa.array(top, mask=none),
                pa.array(line.astype(np.int32), mask=none),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *columns], names=[*names, "licence", "dice", "line"])

    return src.mapInArrow(run, f"{kinds}licence string, dice double, line int")


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same question for DuckDB on ``documents``."""
    templates = TEMPLATES if templates is None else templates
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '([a-z0-9]|[^\\x00-\\x7F])+')"
    pairs = "CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return f"""
WITH t AS (SELECT name, {pairs} AS p FROM (SELECT name, {words.format('body')} AS w FROM (VALUES {rows}) v(name, body))),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents),
units AS (
  SELECT doc_id, -1 AS line, text AS body FROM lines
  UNION ALL SELECT doc_id, CAST(i - 1 AS INTEGER), l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines)
),
sets AS (SELECT doc_id, line, {pairs} AS p FROM (SELECT doc_id, line, {words.format('body')} AS w FROM units) WHERE len(w) > 0),
d AS (
  SELECT doc_id, line, name, 2.0 * len(list_intersect(sets.p, t.p)) / (len(sets.p) + len(t.p)) AS dice
  FROM sets JOIN t ON len(sets.p) BETWEEN len(t.p) * {threshold} / (2 - {threshold}) AND len(t.p) * (2 - {threshold}) / {threshold}
),
best AS (
  SELECT doc_id, name, dice, line, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, name) AS r
  FROM d WHERE dice >= {threshold}
)
SELECT documents.doc_id, name AS licence, CAST(dice AS DOUBLE) AS dice, CAST(line AS INTEGER) AS line
FROM documents LEFT JOIN best ON best.doc_id = documents.doc_id AND r = 1
"""
