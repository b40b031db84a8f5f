"""License texts in documents, found by patience alignment with templates.

A match may miss as many template words as ``least`` allows, so of one word more than that, the rarest in the document,
it has at least one. Windows open from each of these: one as long as the template, one that is a quarter longer on both
sides (the shorter one tells copies that follow each other apart), and one from the first to the last of the rare template
words in order around it, wherever inserted text has moved them; between two of them up to a template's length may be
inserted. Windows are aligned with the template: words that occur once in both are anchors, their longest increasing subsequence is kept,
and the gaps between anchors are aligned in the same way, after equal words at their ends. The coverage is the share of
template words that are matched. A match is reported from ``least`` on; of overlapping matches the one with more matched
words stays, then the higher coverage, the earlier start and the first name.

Null or empty texts have no matches. Repeated license lines are windows of their own, so each is found. Words are runs of
letters and digits, in lower case; other characters between them don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.tokens import texts_of

# Short public license notices by SPDX-like name.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                  "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                  "option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
WORD = re.compile(r"[^\W_]+")
LEAST = 0.75


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    ends: list[int] = []
    tails: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        if k == len(ends):
            ends.append(i)
            tails.append(v)
        else:
            ends[k], tails[k] = i, v
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once = [{w: i for i, w in enumerate(x[lo:hi], lo) if n[w] == 1} for x, lo, hi in ((a, a0, a1), (b, b0, b1))
                for n in [Counter(x[lo:hi])]]
        common = sorted((i, once[1][w]) for w, i in once[0].items() if w in once[1])
        chain = [common[i] for i in increasing([j for _, j in common])]
        out += chain
        if chain:
            ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(x + 1, p, y + 1, q) for (x, y), (p, q) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _templates(texts: dict[str, str]) -> list[tuple[str, list[str], Counter]]:
    out = []
    for name, text in texts.items():
        words = [w.lower() for w in WORD.findall(text)]
        out.append((name, words, Counter(words)))
    return out


def _reach(hits: list[tuple[int, int]], at: int, step: int, size: int, lost: int) -> tuple[int, int]:
    """The last of the hits (place, template place) before (step -1) or after ``hits[at]`` that are in order with it."""
    p, q = hits[at]
    at += step
    while 0 <= at < len(hits):
        far, on = abs(hits[at][0] - p), (hits[at][1] - q) * step
        if far > 2 * size:
            break
        if far and 0 < on <= far + lost and far <= on + size:
            p, q = hits[at]
        at += step
    return p, q


def windows(places: dict[str, list[int]], own: list[str], counts: Counter, lost: int) -> Iterator[tuple[int, int]]:
    """Word ranges that a copy of the template with at most ``lost`` words missing may lie in; ``places`` has the document's words."""
    by = sorted(range(len(own)), key=lambda q: len(places.get(own[q], ())))
    rare = [q for q in by[:lost + 1] if own[q] in places]
    if not rare:
        return
    follow = {q for q in by if counts[own[q]] <= 2 and own[q] in places} | set(rare)
    hits = sorted((p, q) for q in follow for p in places[own[q]])
    slack, seen, first = max(3, len(own) // 4), set(), set(rare)
    for at, (p, q) in enumerate(hits):
        if q not in first:
            continue
        (a, x), (b, y) = _reach(hits, at, -1, len(own), lost), _reach(hits, at, 1, len(own), lost)
        start = p - q
        for window in ((start, start + len(own)), (start - slack, start + len(own) + slack), (a - x - slack, b + len(own) - y + slack)):
            if window not in seen:
                seen.add(window)
                yield window


def matches(text: str, templates: list[tuple[str, list[str], Counter]], least: float = LEAST) -> list[tuple[int, int, str, int, float]]:
    """(start, end, name, matched words, coverage) of the licenses in a text, in order."""
    spots = list(WORD.finditer(text))
    words = [m[0].lower() for m in spots]
    known = set().union(*(counts for _, _, counts in templates))
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in known:
            places.setdefault(w, []).append(i)
    found = []
    for name, own, counts in templates:
        need = ceil(least * len(own))
        for first, last in windows(places, own, counts, len(own) - need):
            first = max(0, first)
            cut = words[first:last]
            if sum(w in counts for w in cut) < need:
                continue
            pairs = align(cut, own)
            if len(pairs) >= need:
                a, b = spots[first + pairs[0][0]].start(), spots[first + pairs[-1][0]].end()
                found.append((a, b, name, len(pairs), len(pairs) / len(own)))
    chosen: list[tuple[int, int, str, int, float]] = []
    taken: list[tuple[int, int]] = []  # kept spans by start; they don't overlap
    for m in sorted(set(found), key=lambda m: (-m[3], -m[4], m[0], m[2])):
        k = bisect_left(taken, (m[0], m[1]))
        if (k == 0 or taken[k - 1][1] <= m[0]) and (k == len(taken) or m[1] <= taken[k][0]):
            taken.insert(k, (m[0], m[1]))
            chosen.append(m)
    return sorted(chosen)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
         least: float = LEAST) -> DataFrame:
    """One row per license found: key, license, start, end (code points), matched, coverage."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    known = _templates(TEMPLATES if templates is None else templates)
    kind = source.schema["key"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, texts in texts_of(batch):
            found = [(k, *m) for k, t in enumerate(texts) for m in matches(t, known, least)]
            owner, start, end, name, matched, coverage = zip(*found, strict=True) if found else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("key")[i:j].take(pa.array(owner, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(matched, pa.int64()), pa.array(coverage, pa.float64())],
                names=["key", "license", "start", "end", "matched", "coverage"])

    def run(batches):
        for batch in batches:
            yield from rows(batch)

    schema = f"key {kind}, license string, start long, end long, matched long, coverage double"
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
