"""Operator 11: licence scan by a positional rare-token index.

A template is a run of words with mandatory key phrases.  Spark counts in how many documents each
licence word stands; the index keeps, for each template, the places of its rarest words only.  A file
looks up its rarest licence words there: every posting says at which word the template would start,
and equal starts are the intersection by relative position.  The words at a start are then compared
with the template's, and where enough agree, the key phrases are verified.

No loss by the index: a start at which `need` of a template's n words agree holds one of any
n - need + 1 of them, and that many of the rarest are indexed.  So the result is that of comparing every
template at every word (tested).  Contract phrases are templates of which all words must agree.

Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII, named by 64-bit hashes: a
false match of a word is expected once in 2^64 / (words of the corpus times words of the templates).

Odd input: a null text is empty and has no words; repeated rows keep a row each; a notice cut by the
end of a text matches as long as enough of it is there; ties of rarity go by the word; an empty table
has no rows; a text is handled whole in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .textblocks import LOWER, Block, Places, blocks, token_hashes


@dataclass(frozen=True)
class Template:
    """A label, its notice, phrases that must stand within it, and the share of words that must agree."""

    label: str
    notice: str
    keys: tuple[str, ...] = ()
    share: float = 0.8
    base: bool = False


# The contract's phrases, and the usual notices of public licences with what tells each
# from its relatives.
BASE = [
    Template("mit", "under the mit license", ("under the mit license",), 1.0, True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), 1.0, True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), 1.0, True),
]
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "version 2 0")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3", "any later version")),
    Template("gpl-2-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2", "any later version")),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    Template("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ("gnu lesser general public license", "version 2 1")),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("cc0", "released under the creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
]
TEMPLATES = BASE + NOTICES
SLACK = 2  # words around a notice in which a key phrase may stand
PAIRS = 1 << 20  # words compared at a time

SCHEMA = "doc_id long, n_words long, matches array<struct<label string, start long, words int, share double, base boolean>>"

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


@dataclass
class Words:
    """Words of a block: 64-bit name of each, and n_docs+1 offsets into them."""

    name: np.ndarray
    bounds: np.ndarray


def words_of(block: Block) -> Words:
    data, offsets = block.data, block.offsets
    low = LOWER[data]
    solid = IS_WORD[low]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = offsets[:-1] < offsets[1:]
        a, b = offsets[:-1][full], offsets[1:][full] - 1
        first[a] = solid[a]
        last[b] = solid[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(token_hashes(low, starts, ends), np.searchsorted(starts, offsets))


class Lexicon:
    """Numbers of the words of the templates."""

    def __init__(self, templates: list[Template]):
        self.words = sorted({w for t in templates for text in (t.notice, *t.keys) for w in text.split()})
        data = np.frombuffer("".join(self.words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in self.words]).astype(np.int64)
        names = token_hashes(data, np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(names)
        self.number = np.empty(len(order) + 1, np.int32)
        self.number[: len(order)] = order
        self.places = Places(names[order])
        self.of = {w: i for i, w in enumerate(self.words)}

    def numbers(self, names: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one of no template."""
        at, known = self.places.find(names)
        return np.where(known, self.number[at], -1).astype(np.int32)

    def sequence(self, text: str) -> np.ndarray:
        return np.array([self.of[w] for w in text.split()], np.int32)


def document_counts(docs: DataFrame, templates: list[Template]) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each word of the templates."""
    size = len(Lexicon(templates).words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, n = Lexicon(templates), np.zeros(size + 1, np.int64)
        for batch in batches:
            n[size] += batch.num_rows
            for block in blocks(batch.column(1)):
                words = words_of(block)
                number = lexicon.numbers(words.name).astype(np.int64)
                doc = np.repeat(np.arange(len(block)), np.diff(words.bounds))
                pairs = np.unique((doc * size + number)[number >= 0])
                n[:size] += np.bincount(pairs % size, minlength=size)
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(size + 1, dtype=np.int32)), "n": n})

    rows = docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(size + 1, np.int64)
    for r in rows:
        n[r.word] = r.n
    return int(n[size]), n[:size]


class Index:
    """Postings of the templates' rarest words: number of a word to (template, place)."""

    def __init__(self, templates: list[Template], n_docs: int, found: np.ndarray):
        self.templates, self.lexicon = templates, Lexicon(templates)
        self.idf = np.log((1.0 + n_docs) / (1.0 + found)) + 1e-9
        self.notices = [self.lexicon.sequence(t.notice) for t in templates]
        self.keys = [[self.lexicon.sequence(k) for k in t.keys] for t in templates]
        self.need = [max(1, int(np.ceil(t.share * len(s) - 1e-9))) for t, s in zip(templates, self.notices)]
        postings = defaultdict(list)
        for k, (words, need) in enumerate(zip(self.notices, self.need)):
            rarest = sorted(range(len(words)), key=lambda j: (-self.idf[words[j]], words[j], j))[: len(words) - need + 1]
            for j in rarest:
                postings[int(words[j])].append((k, j))
        size = len(self.lexicon.words)
        self.first = np.concatenate([[0], np.cumsum([len(postings[w]) for w in range(size)])]).astype(np.int64)
        flat = [p for w in range(size) for p in postings[w]]
        self.template = np.array([k for k, _ in flat], np.int64)
        self.place = np.array([j for _, j in flat], np.int64)

    def starts(self, number: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each template, the different (start, document) that the rare words of a block propose; a
        start may lie before its document."""
        at = np.flatnonzero(number >= 0)
        a, b = self.first[number[at]], self.first[number[at] + 1]
        at, a, count = at[b > a], a[b > a], (b - a)[b > a]
        posting = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        doc = np.repeat(np.searchsorted(bounds, at, "right") - 1, count)
        start, template = np.repeat(at, count) - self.place[posting], self.template[posting]
        order = np.lexsort((start, doc, template))
        start, doc, template = start[order], doc[order], template[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(start) != 0) | (np.diff(doc) != 0) | (np.diff(template) != 0)
        start, doc, template = start[new], doc[new], template[new]
        cut = np.searchsorted(template, np.arange(len(self.templates) + 1))
        return [(start[i:j], doc[i:j]) for i, j in zip(cut[:-1], cut[1:])]

    def matches(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, documents, starts within them, shares by weight) of all verified starts."""
        number = self.lexicon.numbers(words.name)
        for k, (starts, docs) in enumerate(self.starts(number, words.bounds)):
            notice, need = self.notices[k], self.need[k]
            weight = self.idf[notice] / self.idf[notice].sum()
            step = max(1, PAIRS // len(notice))
            for i in range(0, len(starts), step):
                s, doc = starts[i : i + step], docs[i : i + step]
                lo, hi = words.bounds[doc], words.bounds[doc + 1]
                agree = self._at(number, s, 0, len(notice), lo, hi) == notice
                good = agree.sum(axis=1) >= need
                s, doc, lo, hi, agree = s[good], doc[good], lo[good], hi[good], agree[good]
                around = self._at(number, s, -SLACK, len(notice) + 2 * SLACK, lo, hi)
                sound = np.ones(len(s), bool)
                for key in self.keys[k]:
                    views = np.lib.stride_tricks.sliding_window_view(around, len(key), axis=1)
                    sound &= (views == key).all(axis=2).any(axis=1)
                share = np.ones(len(s)) if need == len(notice) else np.minimum((agree * weight).sum(axis=1), 1.0)
                yield k, doc[sound], (s - lo)[sound], share[sound]

    @staticmethod
    def _at(number: np.ndarray, start: np.ndarray, shift: int, size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Words at start + shift and on, -2 outside the document."""
        at = start[:, None] + np.arange(shift, shift + size)
        own = (at >= lo[:, None]) & (at < hi[:, None])
        return np.where(own, number[np.clip(at, 0, len(number) - 1)], -2)


def find_licences(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, matches): every place of every template in each text, ordered by start, template.
    `share` is the part of the notice's weight (rarity) that agrees."""
    n_docs, found = document_counts(docs, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, n_docs, found)
        labels = pa.array([t.label for t in templates])
        length = np.array([len(s) for s in index.notices], np.int32)
        base = np.array([t.base for t in templates])
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = words_of(block)
                hits = [(np.full(len(d), k), d, s, w) for k, d, s, w in index.matches(words)]
                k, doc, start, share = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
                order = np.lexsort((k, start, doc))
                k, doc, start, share = k[order].astype(np.int64), doc[order], start[order], share[order]
                rows = pa.StructArray.from_arrays(
                    [labels.take(pa.array(k)), pa.array(start, pa.int64()), pa.array(length[k]), pa.array(share.astype(np.float64)), pa.array(base[k])],
                    ["label", "start", "words", "share", "base"],
                )
                ends = np.searchsorted(doc, np.arange(len(block) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(block.row, len(block)), "n_words": np.diff(words.bounds), "matches": pa.ListArray.from_arrays(pa.array(ends), rows)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, SCHEMA)


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """One row a document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).
    The score is the greatest share of a match, 1 where a base phrase stands, 0 without any."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    return find_licences(docs, templates).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
