"""Licence scan: TF-IDF cosine to templates, then inheritance along directories.

Each line of a text is a sparse vector of its words' counts times their inverse
document frequency; so is each template. A word's frequency is that of lines, counted
over all texts; words of no template weigh as much as one that no line has. A line whose
cosine to a template reaches LEAST states that licence, and a document's own
licence is its best line's. A document of which the stating line is at least
FILE_SHARE of the words is a licence file, which holds for its directory.

A document without an own licence inherits from the nearest directory above it
that has one: its directories are listed once each with all directories above,
and joined with the licensed ones by path.

Defined results: null and empty texts state nothing but do inherit; documents with a null
path have no directory and inherit nothing; equal scores go to the first licence by
name, for directories then to the first path; repeated rows are one each in the result; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.llm.common import written
from huddle.llm.shingles import row_slices, words
from huddle.llm.tokens import text_buffer

LEAST = 0.6
FILE_SHARE = 0.2

# Short notices in common use, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

_GAPS = np.zeros(256, bool)
_GAPS[:48] = _GAPS[58:65] = _GAPS[91:97] = _GAPS[123:128] = True


def _lines(raw: np.ndarray, off: np.ndarray):
    """Word hashes, the line of each word, and the row of each line."""
    h, _, start = words(raw, off, _GAPS)
    new = np.zeros(len(raw) + 1, bool)
    new[off] = True
    new[1:] |= np.append(raw == 10, False)[:-1] if len(raw) else False
    first = np.flatnonzero(new[:-1])
    line = np.searchsorted(first, start, "right") - 1
    return h, line, np.searchsorted(off, first, "right") - 1, len(first)


class Index:
    """Template vectors over the vocabulary of their words."""

    def __init__(self, templates=TEMPLATES):
        texts = [t.encode() for _, t in templates]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        h, row, _ = words(raw, off, _GAPS)
        self.vocab, at = np.unique(h, return_inverse=True)
        self.count = np.zeros((len(texts), len(self.vocab)))
        np.add.at(self.count, (row, at), 1)
        self.names = [n for n, _ in templates]

    def find(self, h):
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return at, self.vocab[at] == h

    def weigh(self, lines: float, having: np.ndarray):
        self.idf = np.log((lines + 1) / (having + 1)) + 1e-3
        self.rare = np.log(lines + 1) + 1e-3
        w = self.count * self.idf
        self.weight = w / np.sqrt((w ** 2).sum(1))[:, None]
        return self


def _frequencies(batches, index):
    """Over a task's texts: for each word of a template the lines that have it, and (-1) all lines."""
    having, total = np.zeros(len(index.vocab), np.int64), 0
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        for a, b in row_slices(off):
            h, line, _, n = _lines(raw[off[a]:off[b]], off[a:b + 1] - off[a])
            at, known = index.find(h)
            pair = np.unique(line[known] * len(index.vocab) + at[known])
            having += np.bincount(pair % len(index.vocab), minlength=len(index.vocab))
            total += n
    yield pa.RecordBatch.from_pydict({"word": np.arange(-1, len(index.vocab)), "n": np.concatenate([[total], having])})


def _own(batches, index):
    """Per row: its best line's licence and cosine, and the line's share of the words."""
    ix = index.value
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        for a, b in row_slices(off):
            h, line, row, n = _lines(raw[off[a]:off[b]], off[a:b + 1] - off[a])
            at, known = ix.find(h)
            # only lines with two words of a template can come near one
            some = np.flatnonzero(np.bincount(line[known], minlength=n) >= 2)
            place = np.full(n, -1)
            place[some] = np.arange(len(some))
            p = place[line]
            tf = np.zeros((len(some), len(ix.vocab)))
            np.add.at(tf, (p[known & (p >= 0)], at[known & (p >= 0)]), 1)
            # other words: squared counts by word
            other = np.flatnonzero(~known & (p >= 0))
            _, inverse = np.unique(np.stack([p[other].astype(np.uint64), h[other]]), axis=1, return_inverse=True)
            count = np.bincount(inverse.ravel()) if len(other) else np.zeros(0)
            first = np.zeros(len(count), np.int64)
            first[inverse.ravel()] = p[other]
            rest = np.bincount(first, (count * ix.rare) ** 2, minlength=len(some)) if len(other) else np.zeros(len(some))
            w = tf * ix.idf
            cos = (w @ ix.weight.T) / np.sqrt((w ** 2).sum(1) + rest)[:, None] if len(some) else np.zeros((0, len(ix.names)))
            size = np.bincount(line, minlength=n)
            total = np.bincount(row, size, minlength=b - a) if n else np.zeros(b - a)
            name, score, share = [None] * (b - a), np.zeros(b - a), np.zeros(b - a)
            for k in np.flatnonzero((cos >= LEAST).any(1)):
                i, best = int(row[some[k]]), int(cos[k].argmax())
                if cos[k, best] > score[i]:
                    name[i], score[i], share[i] = ix.names[best], cos[k, best], size[some[k]] / total[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("path").slice(a, b - a), pa.array(name, pa.string()),
                 pa.array(score), pa.array(share)], names=["doc_id", "path", "own", "score", "share"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, basis (own, inherited, none), score, directory it comes from.

    ``docs``: doc_id, path (with / between directories), text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text")
    index = Index()
    counted = rows.select("text").mapInArrow(lambda it: _frequencies(it, index), "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n")).toArrow().to_pandas().set_index("word")["n"]           # as many rows as templates have words
    having = np.array([counted.get(k, 0) for k in range(len(index.vocab))], float)
    sent = spark.sparkContext.broadcast(index.weigh(float(counted.get(-1, 0)), having))
    own = written(rows.mapInArrow(lambda it: _own(it, sent), "doc_id long, path string, own string, score double, share double")
                  .withColumn("dir", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", ""))), "own")
    # what holds for a directory: its licence files' best statement
    files = own.filter((F.col("share") >= FILE_SHARE) & F.col("dir").isNotNull())
    held = files.groupBy("dir").agg(F.min(F.struct(-F.col("score"), "own", "path")).alias("best")).select(
        F.col("dir").alias("above"), F.col("best.own").alias("inherited"), F.col("best.path").alias("from_path"))
    # every directory once, with all that are above it
    parts = F.split("dir", "/")
    above = own.filter("dir is not null").select("dir").distinct().withColumn(
        "depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn(
        "above", F.concat_ws("/", F.slice(parts, F.lit(1), F.col("depth"))))
    nearest = Window.partitionBy("dir").orderBy(F.desc("depth"))
    given = above.join(held, "above").withColumn("n", F.row_number().over(nearest)).filter("n = 1").select(
        "dir", "inherited", F.col("above").alias("from_dir"))
    out = own.join(given, "dir", "left")
    return out.select(
        "doc_id", "path", F.coalesce("own", "inherited").alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("basis"),
        "score", F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))
