"""License scan with a positional index of rare words (operator 5).

Templates (short passages of known licences) are indexed by word and position.
The words' document frequencies are counted over all documents; every indexed
word of a file is looked up at each of its places, every posting votes for a
relative position (place in the file minus place in the template), and templates
with two words there are compared word by word. So many words of a template are
indexed that it cannot reach the least score with fewer than two of them. A label
needs the template's mandatory phrase, its words consecutive, near that place. The
score is the share of the template's weight (inverse document frequencies) found.

Defined results: a null or empty text has no words and no labels, score 0; a
null id keeps its row; repeated rows are scanned each; an empty table gives an
empty result; other columns are ignored. Whole texts are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .shared import ship, slices

# Phrases and labels of the base rule.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, mandatory phrase, and a passage of the licence or its notice.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license",
     "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license you may obtain a copy of the license at"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license",
     "this library is free software you can redistribute it and or modify it under the terms of the gnu "
     "lesser general public license as published by the free software foundation"),
    ("agpl", "affero general public license",
     "licensed under the gnu affero general public license version 3"),
    ("mpl", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute",
     "permission to use copy modify and or distribute this software for any purpose with or without fee "
     "is hereby granted"),
    ("unlicense", "released into the public domain",
     "this is free and unencumbered software released into the public domain"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc0", "cc0 1 0", "released under cc0 1 0 universal public domain dedication"),
)

RARE = 6            # words of a template that are indexed at least: its rarest, or over half of them
SLACK = 2           # words by which a relative position may be off
MIN_SCORE = 0.75


def _split(text: str) -> list[str]:
    return text.split(" ")


VOCABULARY = tuple(sorted({w for _, p, t in TEMPLATES for w in _split(p) + _split(t)}
                          | {w for p in PHRASES for w in _split(p)}))


def _vocabulary_ids() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the vocabulary in ascending order and the word each belongs to."""
    h = np.array([B.word_hash(w) for w in VOCABULARY], np.uint64)
    order = np.argsort(h)
    return h[order], order


def _licence_words(w: B.Words, known: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Vocabulary index of every word, -1 for others."""
    at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
    return np.where(known[at] == w.hash, word[at], -1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, word = _vocabulary_ids()
    df, n = np.zeros(len(VOCABULARY), np.int64), 0
    for b, data, off in slices(batches):
        w = B.find_words(B.LOWER[data], off, B.ALNUM)
        v = _licence_words(w, known, word)
        pair = np.unique(w.doc[v >= 0] * len(VOCABULARY) + v[v >= 0])
        df += np.bincount(pair % len(VOCABULARY), minlength=len(VOCABULARY))
        n += b.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(VOCABULARY)).astype(np.int32)),
                                      pa.array(np.concatenate([[n], df]))], ["word", "n"])


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """Idf of every vocabulary word over all documents (bounded by the vocabulary)."""
    ship(docs.sparkSession)
    rows = (docs.select("text").mapInArrow(_counts, "word int, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    n = {r.word: r.n for r in rows}
    total = n.get(-1, 0)
    return {w: float(np.log1p(total / (1.0 + n.get(i, 0)))) for i, w in enumerate(VOCABULARY)}


class RareWordIndex:
    """Postings (word, position) of the rarest words of each template."""

    def __init__(self, idf: dict[str, float]):
        self.idf = [idf[w] for w in VOCABULARY]
        number = {w: i for i, w in enumerate(VOCABULARY)}
        self.templates, self.postings = [], []
        for label, phrase, text in TEMPLATES:
            words = [number[w] for w in _split(text)]
            self.templates.append((label, [number[w] for w in _split(phrase)], words))
            rare = self._rare(words)
            self.postings.append([(w, p, rare.index(w)) for p, w in enumerate(words) if w in rare])

    def _rare(self, words: list[int]) -> list[int]:
        """The rarest words, so many that all but one of them weigh more than a
        file may lack."""
        order = sorted(set(words), key=lambda w: (-self.idf[w], w))
        weight = [self.idf[w] * words.count(w) for w in order]
        n = min(RARE, len(order) // 2 + 1)
        while n < len(order) and sum(weight[:n]) - max(weight[:n]) <= (1 - MIN_SCORE + 1e-9) * sum(weight):
            n += 1
        return order[:n]

    def scan(self, v: np.ndarray, w: B.Words) -> list[tuple[int, str, float]]:
        """(text, label, score) of the templates found in the texts of a slice;
        ``v`` has the vocabulary index of every word."""
        hit = np.flatnonzero(v >= 0)
        hit = hit[np.argsort(v[hit], kind="stable")]
        cut = np.searchsorted(v[hit], np.arange(len(VOCABULARY) + 1))
        out = []
        for (label, phrase, words), postings in zip(self.templates, self.postings):
            starts = _consecutive(v, w, phrase, hit[cut[phrase[0]]:cut[phrase[0] + 1]])
            if not len(starts):
                continue
            gap = len(words) + 2 * SLACK + 1            # keeps the places of neighbouring texts apart
            keys, bits = [], []
            for x, p, bit in postings:
                at = hit[cut[x]:cut[x + 1]]
                keys.append(at - p + w.doc[at] * gap)
                bits.append(np.full(len(at), np.uint64(1) << np.uint64(bit)))
            doc, shift = self._voted(np.concatenate(keys), np.concatenate(bits), min(2, len(set(words))), w, gap)
            low, high = w.first[doc], w.first[doc + 1]
            # The mandatory phrase stands within the template's stretch of the file.
            at = np.searchsorted(starts, np.maximum(shift - SLACK, low))
            first = np.append(starts, len(v))[at]
            near = (first <= shift + len(words) + SLACK) & (first < high)
            doc, shift, low, high = doc[near], shift[near], low[near], high[near]
            total, found = sum(self.idf[x] for x in words), np.zeros(len(doc))
            for p, x in enumerate(words):
                there = np.zeros(len(doc), bool)
                for s in range(-SLACK, SLACK + 1):
                    place = shift + p + s
                    there |= (place >= low) & (place < high) & (v[np.clip(place, 0, len(v) - 1)] == x)
                found += np.where(there, self.idf[x], 0.0)
            score = np.minimum(1.0, found / total) if total else np.zeros(len(doc))
            out += [(d, label, x) for d, x in zip(doc.tolist(), score.tolist()) if x >= MIN_SCORE]
        return out

    @staticmethod
    def _voted(key, bit, least, w, gap) -> tuple[np.ndarray, np.ndarray]:
        """(text, relative position) of the places voted for by at least ``least``
        (1 or 2) different words that are off by at most the slack."""
        order = np.argsort(key, kind="stable")
        key, bit = key[order], bit[order]
        new = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        if not len(new):
            return (np.zeros(0, np.int64),) * 2
        place, voted = key[new], np.bitwise_or.reduceat(bit, new)
        near = voted.copy()
        for s in range(1, SLACK + 1):       # different places: one off by s is at most s further on
            for k in range(1, s + 1):
                both = np.flatnonzero(place[k:] - place[:-k] == s)
                near[both] |= voted[both + k]
                near[both + k] |= voted[both]
        if least > 1:
            place = place[(near & (near - np.uint64(1))) != 0]
        # Places of text d begin at most a template's length before its first word.
        texts = np.arange(len(w.first) - 1)
        doc = np.searchsorted(w.first[:-1] + texts * gap - (gap - 2 * SLACK - 1), place, side="right") - 1
        return doc, place - doc * gap


def _consecutive(v: np.ndarray, w: B.Words, phrase: list[int], at: np.ndarray) -> np.ndarray:
    """Those of the places where the words of a phrase follow each other inside a text."""
    m = len(phrase)
    at = at[at <= len(v) - m]
    for i in range(1, m):
        at = at[v[at + i] == phrase[i]]
    return at[w.doc[at] == w.doc[at + m - 1]] if len(at) else at


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(RareWordIndex(inverse_frequencies(docs)))  # a few hundred words

    def run(batches):
        ix = index.value
        known, word = _vocabulary_ids()
        number = {x: i for i, x in enumerate(VOCABULARY)}
        phrases = [([number[x] for x in _split(p)], label) for p, label in PHRASES.items()]
        for b, data, off in slices(batches):
            w = B.find_words(B.LOWER[data], off, B.ALNUM)
            v = _licence_words(w, known, word)
            n = b.num_rows
            n_base, low, high = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            base = [set() for _ in range(n)]
            for p, label in phrases:
                at = _consecutive(v, w, p, np.flatnonzero(v == p[0]))
                for a in at.tolist():
                    d = int(w.doc[a])
                    s = a - int(w.first[d])
                    n_base[d] += 1
                    low[d] = s if low[d] < 0 else min(low[d], s)
                    high[d] = max(high[d], s)
                    base[d].add(label)
            labels, score = [set(x) for x in base], np.zeros(n)
            for d, label, x in ix.scan(v, w):
                labels[d].add(label)
                score[d] = max(score[d], x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(w.counts), pa.array(n_base),
                 pa.array(low, mask=n_base == 0), pa.array(high, mask=n_base == 0),
                 pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]),
                 pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
