"""Odd rows that every operator must take, and brute-force helpers."""

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Null and empty texts, a null id, repeated rows and ids, a long text."""
    long = " ".join(f"word{i % 977} of a very long text" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Née à Zürich, 12 mai"), (6, "same text here as below ok"),
            (6, "same text here as below ok"), (7, "same text here as below ok"), (None, "a row without an id at all"),
            (8, long), (9, long + " end"), (6, "another text with the same id")]


def frame(spark, rows):
    """documents with columns whose names clash with those used inside."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    for c in ("score", "kept", "piece", "length", "offset", "sequence_id", "value", "part", "cls", "key", "start",
              "spans", "labels", "ids", "quality", "u", "v", "row", "digest", "bin", "features"):
        df = df.withColumn(c, F.lit("x"))
    return df


def twins(n=2048):
    """Two texts of one word whose polynomial hashes modulo 2^64 are equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def shingles(t):
    w = words(t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def linked_groups(texts):
    """id -> smallest id reachable by links, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y >= x:
                break
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed=1, n=220):
    """Texts with exact and near copies, a hot line and a shared passage."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]

    def prose(k):
        return " ".join(r.choice(vocabulary) for _ in range(k))

    line, passage = prose(12), prose(70)
    texts = {}
    for i in range(n):
        kind = r.random()
        if i and kind < 0.35:
            w = texts[r.randrange(i)].split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts[i] = " ".join(w)
        else:
            parts = [prose(r.choice([3, 5, 8, 20, 60, 150, 400]))]
            if kind < 0.7:
                parts.insert(r.randint(0, 1), line)
            if kind > 0.85:
                parts.insert(r.randint(0, 1), passage)
            texts[i] = "\n".join(parts)
    return texts
