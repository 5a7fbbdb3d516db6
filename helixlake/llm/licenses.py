"""License scans by winnowed fingerprints and banded alignment (operator 5).

Template words are hashed in runs of GRAM, or fewer where the replaced words that the least
coverage allows could leave no run of GRAM whole. Of each WINDOW neighbouring runs the smallest
is a fingerprint (winnowing), so every match of GRAM + WINDOW - 1 words shares one; where the
least coverage doesn't grant such a match, all runs are fingerprints. The fingerprints of the
templates are the inverted index, in which all runs of a text are looked up. From each hit, a
banded alignment with the template gives matched words, coverage and span.

Templates are a table (name, text) of a fixed, checked size, which is sent to all tasks;
larger sets are taken in blocks of MAX_TEMPLATES. Every text is scanned whole.

Edge cases: null and empty texts match nothing; a template shorter than GRAM is one run of
its own length; equal templates each report; several matches in a text each report, those of one template
without overlap; of equally good alignments the shorter span, then the earlier one, is told; rows are
treated one by one, also where doc_ids are null or repeated; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import kernel as K
from helixlake.llm.shared import id_text, row_key, table

GRAM, WINDOW, BAND, LEAST_COVERAGE, MAX_TEMPLATES = 3, 3, 12, 0.8, 500
#: Public license notices and opening clauses.
TEMPLATES = {
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the winnowed fingerprints: the rightmost smallest of each window."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


def runs(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Fingerprints of the runs of size words; one run if there are fewer words."""
    if not len(h):
        return np.zeros(0, K.U64)
    n = min(size, len(h))
    return K.gram_hash(h, np.arange(len(h) - n + 1), n)


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment of template with text near diagonal shift.

    Longest common subsequence within the band; cell (i, d) is template word i against text word
    i + shift + d, and holds the most matches up to there and, in its low half, the latest first one.
    Ties prefer the shorter span, then the earlier one.
    """
    best = np.zeros(2 * band + 1, np.int64)
    for i in range(len(template)):
        at = i + shift + np.arange(-band, band + 1)
        same = (at >= 0) & (at < len(text))
        if len(text):
            same &= text[np.clip(at, 0, len(text) - 1)] == template[i]
        hit = np.where(same, np.where(best > 0, best, at) + (1 << 32), best)
        best = np.maximum.accumulate(np.maximum(hit, np.append(best[1:], 0)))
    matched, first = best >> 32, best & 0xFFFFFFFF
    if not matched[-1]:
        return 0, -1, 0
    # a cell above its left neighbour ends with a match
    last = np.flatnonzero((matched == matched[-1]) & (np.diff(best, prepend=0) > 0))
    end = len(template) - 1 + shift - band + last + 1
    k = int(np.argmin(end - first[last]))
    return int(matched[-1]), int(first[last][k]), int(end[k])


def passages(text: np.ndarray, template: np.ndarray, hits: list[tuple[int, int]], need: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(matched, first, end) of the matches in text[lo:hi] that don't overlap, in order; hits: (text place, template place) of shared runs, ascending."""
    out: list[tuple[int, int, int]] = []
    tried: set[int] = set()

    def best(shift: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        near = text[max(lo, shift - BAND) : max(0, min(hi, shift + len(template) + BAND))]
        if np.isin(template, near).sum() < need:
            return None
        m, a, b = align(text[lo:hi], template, shift - lo)
        return (m, a + lo, b + lo) if m >= need else None

    for j, (t, p) in enumerate(hits):
        if t < lo or t >= hi or t - p in tried:
            continue
        tried.add(t - p)
        found = best(t - p, lo, hi)
        if not found:
            continue
        _, a, b = found
        # words that stand between may be a second notice's: two whole matches are better than one wide one
        for x in sorted({max(u - q, a + 1) for u, q in hits[j : bisect_left(hits, (b,))] if u > a and u - q < b}) if b - a > len(template) else ():
            left, right = best(t - p, lo, x), best(x, x, hi)
            if left and right:
                found = left
                break
        _, a, b = found
        if a > t:  # a better match follows; what stands before it is searched by itself
            out += passages(text, template, hits[j : bisect_left(hits, (a,))], need, lo, a)
        out.append(found)
        lo = b
        tried.clear()
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]], least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, matched (words), coverage, first_word, end_word of every match of docs(doc_id, text)."""
    out = None
    for at in range(0, max(1, len(templates)), MAX_TEMPLATES):
        part = _scan_block(docs, templates[at : at + MAX_TEMPLATES], least)
        out = part if out is None else out.union(part)
    return out


def _scan_block(docs: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    words = [K.Texts(pa.RecordBatch.from_pydict({"text": [text]})).words(K.NOT_ALNUM, K.FOLDED).h for _, text in templates]
    needs = [int(np.ceil(least * len(w) - 1e-9)) for w in words]
    # of m words with m - need replaced, so many neighbours are whole somewhere
    whole = [max(1, len(w) // (len(w) - need + 1)) for w, need in zip(words, needs)]
    sizes = [min(GRAM, n) for n in whole]
    posts = [(int(r[p]), k, int(p), sizes[k]) for k, w in enumerate(words) for r in [runs(w, sizes[k])] for p in (winnow(r) if whole[k] >= GRAM + WINDOW - 1 else range(len(r)))]
    by_size = {n: sorted((h, k, p) for h, k, p, m in posts if m == n) for n in {x[3] for x in posts}}
    index = {n: (np.array([x[0] for x in rows], K.U64), [x[1:] for x in rows]) for n, rows in by_size.items()}
    names = [n for n, _ in templates]
    kinds = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches):
        for t in K.slices(batches):
            w = t.words(K.NOT_ALNUM, K.FOLDED)
            near: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for n, (keys, places) in index.items():
                at, h = w.grams(n)
                lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
                for j in np.flatnonzero(hi > lo).tolist():
                    doc = int(w.doc[at[j]])
                    for k, p in places[lo[j] : hi[j]]:
                        near.setdefault((doc, k), []).append((int(at[j]) - int(w.first[doc]), p))
            rows = []
            ids = t.ids()
            for (doc, k), hits in sorted(near.items()):
                text = w.h[w.first[doc] : w.first[doc + 1]]
                rows += [(ids[doc].as_py(), names[k], m, m / len(words[k]), a, b) for m, a, b in passages(text, words[k], sorted(hits), needs[k], 0, len(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return id_text(docs).mapInArrow(run, "doc_id long, license string, matched long, coverage double, first_word long, end_word long")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: how many license passages it has and the matches (license, matched, coverage, span)."""
    return license_rows(table(spark, sf_dir, "documents"))


def license_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches and matches for each row of docs(doc_id, text); doc_ids may be null or repeated."""
    key, unique = row_key(docs)
    rows = docs.select(key.alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    matched = scan(rows.select(F.col("row_key").alias("doc_id"), "text"), sorted(TEMPLATES.items())).withColumnRenamed("doc_id", "row_key")
    # rows alike in id and text share a key: their matches are told once
    each = (matched if unique else matched.distinct()).groupBy("row_key").agg(F.count("*").alias("n_matches"), F.array_sort(F.collect_list(F.struct("first_word", "end_word", "license", "matched", "coverage"))).alias("matches"))
    return rows.select("row_key", "doc_id").join(each, "row_key", "left").select("doc_id", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.to_json("matches").alias("matches"))
