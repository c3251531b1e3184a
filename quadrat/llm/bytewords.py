"""Words of many texts at once, on their UTF-8 bytes.

The texts of an Arrow batch lie in one byte buffer; words are runs of bytes of
a class, found with array operations instead of a loop over words. Every word
gets a 64-bit hash that depends on its bytes only, so equal words have equal
hashes in every task. Bytes from 0x80 belong to non-ASCII characters, so classes
that treat all non-ASCII characters alike are exact on bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_R = 0x9E3779B97F4A7C15               # odd multiplier
_FOLD = 64                            # blocks mixed one after the other; longer runs are folded

SPACES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def class_table(separators: bytes) -> np.ndarray:
    """bool[256], true for bytes that are not separators."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words between white space.
SPACED = class_table(SPACES)
#: Words of ASCII letters and digits and any non-ASCII character (after lower-casing).
ALNUM = class_table(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
#: Lines.
LINES = class_table(b"\n")


@dataclass
class Words:
    """Words in text order: byte starts and ends in the buffer, index of their
    text, hash; ``first`` has for each text its first word (and the total)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _fold(block: np.ndarray, first: np.ndarray, count: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """One number for each run of ``count`` blocks from ``first``: its blocks mixed
    in one after the other, all runs at once. Runs of over ``_FOLD`` blocks are
    folded into fewer before."""
    h = mix(seed + np.uint64(_R))
    own, k = np.flatnonzero((count > 0) & (count <= _FOLD)), 0
    while len(own):
        h[own] = mix(h[own] * np.uint64(_R) ^ block[first[own] + k])
        k += 1
        own = own[count[own] > k]
    long = np.flatnonzero(count > _FOLD)
    if len(long):
        parts = -(-count[long] // _FOLD)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        part = _fold(block, np.repeat(first[long], parts) + nth * _FOLD,
                     np.minimum(np.repeat(count[long], parts) - nth * _FOLD, _FOLD), nth.astype(np.uint64))
        h[long] = _fold(part, np.cumsum(parts) - parts, parts, seed[long])
    return h


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span: its length and its 8-byte blocks, mixed one after
    the other. Spans of one length up to 8 bytes have different hashes."""
    start, size = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    count = -(-size // 8)
    out = np.empty(len(start), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    total = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(start):                                  # a bounded number of blocks, or one span
        j = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 17), side="right")) - 1)
        n = count[i:j]
        place = np.repeat(start[i:j] - 8 * (total[i:j] - total[i]), n) + 8 * np.arange(total[j] - total[i])
        block = view[place].view("<u8")[:, 0]
        short = np.flatnonzero(size[i:j] % 8)              # the last block has fewer bytes
        last = total[i + 1:j + 1][short] - total[i] - 1
        block[last] &= (np.uint64(1) << (size[i:j][short] % 8 * 8).astype(np.uint64)) - np.uint64(1)
        out[i:j] = _fold(block, total[i:j] - total[i], n, size[i:j].astype(np.uint64))
        i = j
    return out


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``a`` from each ``at`` equal those of ``b`` from ``bt``."""
    out = np.ones(len(size), bool)
    some = np.flatnonzero(size)
    if len(some):
        n = size[some]
        first = np.cumsum(n) - n
        nth = np.arange(n.sum()) - np.repeat(first, n)
        out[some] = np.logical_and.reduceat(
            a[np.repeat(at[some], n) + nth] == b[np.repeat(bt[some], n) + nth], first)
    return out


def find_words(data: np.ndarray, off: np.ndarray, table: np.ndarray,
               hashes: bool = True) -> Words:
    """The words of every text; ``off`` has the texts' offsets in ``data``."""
    n = len(data)
    inside = table[data]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        cut = off[:-1][off[:-1] < n]
        before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
        last = off[1:] - 1
        after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(start, end, doc, hash_spans(data, start, end) if hashes else None, first)


def word_hash(word: str | bytes) -> int:
    """The hash that :func:`find_words` gives a word."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def windows(w: Words, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every run of ``size`` words inside a text.
    With ``short``, a text with fewer words (at least one) gives one run of all
    its words."""
    n = len(w.hash)
    k = np.maximum(w.counts - size + 1, 0)
    at = np.flatnonzero(np.arange(n) < np.repeat(w.first[:-1] + k, w.counts))
    h = np.full(len(at), np.uint64(size), np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(_R) + w.hash[at + i])
    doc = w.doc[at]
    if short:
        few = np.flatnonzero((w.counts > 0) & (w.counts < size))
        if len(few):
            extra = w.counts[few].astype(np.uint64)
            for i in range(size - 1):
                has = w.counts[few] > i
                nxt = mix(extra * np.uint64(_R) + w.hash[np.where(has, w.first[few] + i, 0)])
                extra = np.where(has, nxt, extra)
            at = np.concatenate([at, w.first[few]])
            doc = np.concatenate([doc, few])
            h = np.concatenate([h, extra])
    return h, doc, at


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a per-byte or per-word array within each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]
