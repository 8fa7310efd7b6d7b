"""License scans: MinHash bands retrieve templates, exact shingle containment verifies them.

A text is cut into windows of WINDOW words that begin every STEP words. BANDS bands of one row each: band i has the least value of
hash i over the window's 2-word shingles. Templates are cut the same way, in chunks of at most CHUNK = WINDOW - STEP words, so
some window holds a whole chunk that stands in a text. Such a window has at most WINDOW - 1 shingles, so with a chunk of m words
the Jaccard index is at least (m - 1) / (WINDOW - 1), and a band agrees with that probability: for m = 5 and 64 bands all fail with
probability 1e-9, for m = 3 with 1e-4. A window that agrees with a chunk in any band is a candidate for its template.

Verification is exact: around a candidate window, the place p is looked for where the words p ... p + m - 1, m being the
template's length, contain most of the template's distinct shingles (the first such place); it is a match if that is at least ``least`` of them. Overlapping
matches of one template count once, the best of them, then the first.

Edge cases: null and empty texts, and texts of one word, have no match. Rows without an id are left out; rows that repeat an id
are scanned each for itself, and equal matches of theirs are repeated. A text may match several templates in one place. Texts are
scanned whole. Other columns are not read. An empty table gives an empty result; templates of fewer than 2 words never match.
The templates are a few lines, whatever the data's size; they are broadcast, and refused above TEMPLATE_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import lean, mix64, shingle_hashes, word_hashes

WINDOW, STEP, BANDS, LEAST = 16, 4, 64, 0.8
CHUNK = WINDOW - STEP
TEMPLATE_BYTES = 4_000_000

TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_A = mix64(np.arange(1, 513, dtype=np.uint64))
_MULT, _ADD = (_A[:256] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_A[256:] >> np.uint64(32)).astype(np.uint32)


def band_minima(h: np.ndarray, bands: int) -> np.ndarray:
    """(bands, windows) least values over windows of WINDOW - 1 shingles every STEP, padded at the end."""
    steps = WINDOW // STEP
    n = max(1, -(-(len(h) - (WINDOW - 1)) // STEP) + 1)
    x = np.full((n + steps - 1) * STEP, h[-1], np.uint32)  # padding with a shingle that is there changes no window's set
    x[: len(h)] = h
    last = np.arange(n) * STEP + WINDOW - 1  # the shingle that would need a word beyond the window
    out = np.empty((bands, n), np.uint32)
    for i in range(bands):
        v = x * _MULT[i] + _ADD[i]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        block = v.reshape(-1, STEP).min(1)
        tail = np.minimum(np.minimum(v[last - 3], v[last - 2]), v[last - 1])
        m = block[:n].copy()
        for s in range(1, steps - 1):
            np.minimum(m, block[s : n + s], out=m)
        out[i] = np.minimum(m, tail)
    return out


def _shingles(words: np.ndarray) -> np.ndarray:
    return shingle_hashes(words, 2) if len(words) > 1 else words[:0]


class Library:
    """The templates' bands and shingles."""

    def __init__(self, templates: dict[str, str], bands: int):
        self.bands, self.names = bands, sorted(templates)
        self.words = [word_hashes(templates[n]) for n in self.names]
        self.shingles = [np.unique(_shingles(w)) for w in self.words]
        found: list[tuple[int, int, int]] = []
        for t, w in enumerate(self.words):
            for s in range(0, max(1, len(w) - 1), CHUNK // 2):
                chunk = w[s : s + CHUNK]
                if len(chunk) > 1:
                    h = (_shingles(chunk) >> np.uint64(32)).astype(np.uint32)
                    found += [(i, int(v), t) for i, v in enumerate(band_minima(h, bands)[:, 0])]
        self.by_band = []
        for i in range(bands):
            mine = sorted({(v, t) for j, v, t in found if j == i})
            self.by_band.append((np.array([v for v, _ in mine], np.uint32), np.array([t for _, t in mine], np.int64)))
        self.low = np.zeros((bands, 1 << 16), bool)  # by the lower half of a band's value: whether any template has it
        for row, (values, _) in zip(self.low, self.by_band):
            row[values & np.uint32(0xFFFF)] = True

    def candidates(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(template, window) pairs that agree in a band, ascending."""
        if not len(h):
            return []
        minima = band_minima((h >> np.uint64(32)).astype(np.uint32), self.bands)
        out = set()
        for (values, owners), low, m in zip(self.by_band, self.low, minima):
            hit = np.flatnonzero(low[m & np.uint32(0xFFFF)])
            lo, hi = np.searchsorted(values, m[hit]), np.searchsorted(values, m[hit], "right")
            for i in np.flatnonzero(lo < hi).tolist():
                out.update((int(t), int(hit[i])) for t in owners[lo[i] : hi[i]])
        return sorted(out)

    def best_places(self, t: int, h: np.ndarray, lo: int, hi: int, least: float) -> list[tuple[int, float]]:
        """Places of the shingles h[lo:hi] that contain enough of template t: (place, containment), not overlapping, best first."""
        own, m = self.shingles[t], len(self.words[t])
        k = np.searchsorted(own, h[lo:hi])
        k = np.where((k < len(own)) & (own[np.minimum(k, len(own) - 1)] == h[lo:hi]), k, -1)
        inside = np.flatnonzero(k >= 0)
        out = []
        if len(inside) < least * len(own):
            return []
        for p in sorted({max(0, int(i) - d) for i in inside for d in range(m - 1)}):
            c = len(set(k[p : p + m - 1].tolist()) - {-1}) / len(own)
            if c >= least:
                out.append((lo + p, c))
        return out


def scan(library: Library, texts: list[str], least: float) -> list[tuple[int, str, int, int, float]]:
    """(index of the text, template, first word, end, containment) of all matches. The windows run over the joined texts: one that has words of two still holds whole chunks."""
    words = [word_hashes(t) for t in texts]
    edge = np.cumsum([0, *map(len, words)])
    spans: dict[tuple[int, int], list[list[int]]] = {}
    for t, w in library.candidates(_shingles(np.concatenate([np.zeros(0, np.uint64), *words]))):
        m = len(library.words[t])
        first, last = w * STEP, w * STEP + WINDOW
        for i in range(int(np.searchsorted(edge, first, "right")) - 1, int(np.searchsorted(edge, min(last, edge[-1])))):
            lo, hi = max(0, first - int(edge[i]) - m), min(len(words[i]) - 1, last - int(edge[i]) + m)
            own = spans.setdefault((i, t), [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
            else:
                own.append([lo, hi])
    out = []
    for (i, t), own in spans.items():
        m, h = len(library.words[t]), _shingles(words[i])
        places = [x for lo, hi in own for x in library.best_places(t, h, lo, hi, least)]
        taken: list[int] = []
        for p, c in sorted(set(places), key=lambda x: (-x[1], x[0])):
            if all(abs(p - q) >= m for q in taken):
                taken.append(p)
                out.append((i, library.names[t], p, min(p + m, len(words[i])), c))
    return sorted(out)


def _parts(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about most characters, with the index of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _scan(library, least: float):
    names = ["doc_id", "template", "start_word", "end_word", "containment"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[first + i], *x) for first, texts in _parts(b.column(1).to_pylist()) for i, *x in scan(library.value, texts, least)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names)

    return run


def matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, bands: int = BANDS) -> DataFrame:
    """(doc_id, template, start_word, end_word, containment) of each match; words are numbered from 0."""
    templates = TEMPLATES if templates is None else templates
    if sum(len(x.encode()) for x in templates.values()) > TEMPLATE_BYTES:
        raise ValueError("too many templates to broadcast: scan with parts of them and unite the results")
    library = docs.sparkSession.sparkContext.broadcast(Library(templates, bands))
    texts = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t")).where("d is not null and t is not null")
    return texts.mapInArrow(lean(_scan(library, least)), "doc_id bigint, template string, start_word bigint, end_word bigint, containment double")
