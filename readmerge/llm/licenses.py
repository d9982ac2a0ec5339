"""Licence scan by a positional index of rare tokens.

Templates are word sequences: names of licences and sentences of full licence texts.  Inverse document frequencies of all
template words come from all documents.  A template is indexed under its highest-IDF words only: as many of the rarest
places as are needed so that no alignment can lack them all and still reach the template's share of matching weight, and
``SPARE`` more of the weight to tell alignments apart.  These places make the posting lists: word -> (template, position).

A file's words are looked up in the postings once, whatever the number of templates.  Each posting proposes an alignment
(place in the file less position in the template); postings of the same file, template and alignment are intersected by
summing their weights, and an alignment that lacks more of them than the template allows is dropped.  What is left is
verified word by word, and the template's mandatory key phrases must stand in place.  Names must match completely, so the
scan finds every place of them.

``score`` is the largest share of a template's IDF weight that stands in the file, over verified alignments (0: none).
Results of a text depend on the text and the IDF table only, not on rows beside it.

Defined cases: null and empty texts have no words; an alignment may begin before the text or end behind it (a cut notice)
if enough of it stands there; overlapping places all count; repeated rows each get a result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .decontaminate import found

# Phrases and labels that the result must have.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Names of licences, each to be matched completely.
NAMES = [
    ("agpl", "affero general public license"), ("lgpl", "lesser general public license"), ("lgpl", "library general public license"),
    ("mpl", "mozilla public license"), ("epl", "eclipse public license"), ("bsd", "bsd license"), ("isc", "isc license"), ("zlib", "zlib license"),
    ("bsl", "boost software license"), ("cc-by", "cc by 4 0"), ("cc-by", "cc by 3 0"), ("cc-by-sa", "cc by sa"), ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"), ("cc0", "cc0 1 0"), ("cc", "creative commons attribution"), ("proprietary", "all rights reserved"),
]
# Public licence texts, sentence by sentence, with the phrase that must stand in place.
TEXTS = [
    ("mit", "permission is hereby granted", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions"""),
    ("mit", "permission is hereby granted", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files"""),
    ("mit", "permission notice shall be included", """The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software"""),
    ("bsd", "source and binary forms", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met"""),
    ("bsd", "redistributions of source code", """Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer"""),
    ("bsd", "redistributions in binary form", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution"""),
    ("isc", "permission to use copy modify", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies"""),
    ("apache", "apache license", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at"""),
    ("apache", "distributed under the license", """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"""),
    ("gpl", "general public license", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation"""),
    ("gpl", "general public license", """You should have received a copy of the GNU General Public License along with this program"""),
    ("lgpl", "lesser general public license", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation"""),
    ("agpl", "affero general public license", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation"""),
    ("mpl", "mozilla public license", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at"""),
    ("unlicense", "released into the public domain", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means"""),
    ("public-domain", "public domain", "released into the public domain"),
    ("zlib", "provided as is without any express", """This software is provided 'as-is', without any express or implied warranty. In no event will the
        authors be held liable for any damages arising from the use of this software"""),
    ("bsl", "covered by this license", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license"""),
    ("cc", "creative commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
#: Least share of a sentence's IDF weight that has to match.
LEAST = 0.8
#: Weight indexed beyond what a match may lack.
SPARE = 0.2
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t: str | None) -> list[str]:
    """Words of one text, as the kernel makes them."""
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    must: tuple[int, ...]  # positions that have to match
    least: float
    base: bool


def templates() -> list[Template]:
    def whole(label, phrase, base):
        ws = words_of(phrase)
        return Template(label, tuple(ws), tuple(range(len(ws))), 1.0, base)

    out = [whole(v, k, True) for k, v in BASE.items()] + [whole(label, name, False) for label, name in NAMES]
    for label, phrase, sentence in TEXTS:
        ws, ps = words_of(sentence), words_of(phrase)
        at = next(i for i in range(len(ws)) if ws[i : i + len(ps)] == ps)
        out.append(Template(label, tuple(ws), tuple(range(at, at + len(ps))), LEAST, False))
    return out


class Index:
    """Postings of the templates' rarest words, and flat arrays to verify alignments.

    ``vocabulary``: sorted hashes of all template words; ``df``: documents that have each; ``n``: documents.
    """

    def __init__(self, parts: list[Template], names: list[str], df: dict[int, int], n: int):
        hashes = word_hash(names)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        place = {names[j]: i for i, j in enumerate(order)}
        idf = np.array([math.log((n + 1) / (df.get(i, 0) + 1)) + 0.1 for i in range(len(names))])
        self.size = np.array([len(t.words) for t in parts])
        self.off = np.cumsum(self.size) - self.size
        self.ids = np.array([place[w] for t in parts for w in t.words])
        self.weight = idf[self.ids] / np.repeat(np.add.reduceat(idf[self.ids], self.off), self.size)
        self.must = np.concatenate([np.isin(np.arange(len(t.words)), t.must) for t in parts])
        self.least = np.array([t.least for t in parts])
        self.label = np.array([t.label for t in parts], object)
        self.base = np.array([t.base for t in parts])
        post, self.need = [], np.zeros(len(parts))
        for k in range(len(parts)):
            w = self.weight[self.off[k] : self.off[k] + self.size[k]]
            rarest = np.argsort(-w, kind="stable")
            total = np.cumsum(w[rarest])
            lack = 1 - self.least[k]
            used = rarest[: int(np.searchsorted(total, lack + (SPARE if lack > 0 else 0), "right")) + 1]
            self.need[k] = w[used].sum() - lack - 1e-9
            post += [(self.ids[self.off[k] + i], k, i) for i in used]
        post = np.array(sorted(post))
        self.first = np.searchsorted(post[:, 0], np.arange(len(names) + 1))
        self.template, self.position = post[:, 1], post[:, 2]

    def scan(self, w: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Verified alignments of a slice: text, start word in the slice, template, coverage."""
        none = np.zeros(0, np.int64)
        v = found(self.vocabulary, w.hash)
        place = np.flatnonzero(v >= 0)
        count = np.where(v[place] >= 0, self.first[v[place] + 1] - self.first[v[place]], 0)
        place, count = place[count > 0], count[count > 0]
        if not len(place):
            return none, none, none, np.zeros(0)
        doc = w.doc
        p = tx.expand(self.first[v[place]], count)
        start = np.repeat(place, count) - self.position[p]
        # postings of one file, template and alignment meet; a start before the file is below its first word
        key = np.stack([np.repeat(doc[place], count), self.template[p], start], 1)
        weight = self.weight[self.off[key[:, 1]] + self.position[p]]
        order = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
        key, weight = key[order], weight[order]
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        agreed = np.add.reduceat(weight, head)
        key = key[head[agreed >= self.need[key[head, 1]]]]
        own, which, start = key.T
        # word by word
        size = self.size[which]
        row = np.repeat(np.arange(len(key)), size)
        at = tx.expand(start, size)
        slot = tx.expand(self.off[which], size)
        inside = (at >= w.off[own[row]]) & (at < w.off[own[row] + 1])
        same = inside & (v[np.where(inside, at, 0)] == self.ids[slot])
        coverage = np.bincount(row, self.weight[slot] * same, len(key))
        broken = np.bincount(row, self.must[slot] & ~same, len(key))
        good = (broken == 0) & (coverage >= self.least[which] - 1e-9)
        own, which, start, coverage = own[good], which[good], start[good], np.minimum(coverage[good], 1.0)
        order = np.lexsort((which, start, own))
        return own[order], start[order], which[order], coverage[order]


def word_hash(ws: list[str]) -> np.ndarray:
    """Hashes of words as the text kernel makes them."""
    buf, off = tx.buffer_of(pa.array(ws, pa.large_string()))
    return tx.words(buf, off).hash


def _frequencies(vocabulary: np.ndarray):
    """Rows (word, df) of each batch: in how many documents each template word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            buf, off = tx.buffer_of(batch.column("text"))
            n += len(batch)
            for lo, hi in tx.slices(off):
                w = tx.words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                v = found(vocabulary, w.hash)
                at = v >= 0
                pair = np.unique(w.doc[at] * len(vocabulary) + v[at])
                df[:-1] += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], ["word", "df"])

    return run


def build_index(docs: DataFrame, text: str = "text") -> Index:
    """The index, with document frequencies counted over all documents."""
    parts = templates()
    names = sorted({w for t in parts for w in t.words})
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_frequencies(np.sort(word_hash(names))), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    df = {r[0]: r[1] for r in counts.collect()}  # one number for each template word
    return Index(parts, names, df, df.get(len(names), 0))


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, hits (array of label, start, base, coverage in order of start) and score of every row."""
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    shape = f"key {kind}, n_words long, hits array<struct<label:string,start:long,base:boolean,coverage:double>>, score double"
    return src.mapInArrow(_kernel(build_index(docs, text)), shape).withColumnRenamed("key", key)


def _kernel(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tx.buffer_of(batch.column("text"))
            for lo, hi in tx.slices(off):
                w = tx.words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                own, start, which, coverage = index.scan(w)
                score = np.zeros(hi - lo)
                np.maximum.at(score, own, coverage)
                fields = [pa.array(index.label[which], pa.string()), pa.array(start - w.off[own], pa.int64()), pa.array(index.base[which]), pa.array(coverage)]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(hi - lo + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["label", "start", "base", "coverage"]))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(np.diff(w.off), pa.int64()), lists, pa.array(score)], ["key", "n_words", "hits", "score"])

    return run


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("hits", lambda h: h["base"])
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["start"])
    open_hits = F.filter("hits", lambda h: h["label"] != "proprietary")  # a licence often begins with "all rights reserved"
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.when(F.size(open_hits) > 0, open_hits).otherwise(F.col("hits"))).alias("labels"), "score",
    )


def brute_force(docs: list[tuple]) -> list[tuple]:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: every template at every place, for tests."""
    parts = templates()
    split = [words_of(t) for _, t in docs]
    df: dict[str, int] = {}
    for ws in split:
        for x in set(ws):
            df[x] = df.get(x, 0) + 1
    idf = lambda x: math.log((len(docs) + 1) / (df.get(x, 0) + 1)) + 0.1
    out = []
    for (d, _), ws in zip(docs, split, strict=True):
        base, labels, score, own = [], set(), 0.0, set(ws)
        for t in parts:
            weights = [idf(x) for x in t.words]
            total = sum(weights)
            if sum(y for x, y in zip(t.words, weights, strict=True) if x in own) < t.least * total - 1e-6:
                continue
            for s in range(1 - len(t.words), len(ws)):
                same = [0 <= s + i < len(ws) and ws[s + i] == x for i, x in enumerate(t.words)]
                coverage = sum(y for a, y in zip(same, weights, strict=True) if a) / total
                if all(same[i] for i in t.must) and coverage >= t.least - 1e-9:
                    labels.add(t.label)
                    score = max(score, min(coverage, 1.0))
                    if t.base:
                        base.append((s, t.label))
        if len(labels) > 1:
            labels.discard("proprietary")
        at = [s for s, _ in base]
        out.append((d, len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in base})), ",".join(sorted(labels)), score))
    return out
