"""Token ids of many texts with the ``tokenizers`` library.

The byte-level BPE of the vocabulary splits a text into pieces before it merges
bytes, and a space before a visible character always begins a new piece (the
pattern takes a space into the piece that follows it). A text's ids are
therefore the ids of the stretches between such spaces, one after the other.
Texts repeat many stretches, so all stretches of a batch are found and hashed
with array operations, each different one is encoded once, and the worker keeps
them in a bounded cache. Stretches of Latin letters and ending marks, whose
pieces are plain, go to the library's model directly; all others through its
whole pipeline. Vocabularies with another pre-tokenizer are encoded text by text.
"""

from __future__ import annotations

import ctypes
import json
import re
from array import array

import numpy as np

from .bytewords import hash_spans, same_bytes

END = 0                           # id after every document
CACHE = 1_000_000                 # stretches kept per worker, about 50 bytes each
RECENT = 100_000                  # newest ones, kept apart from the sorted table
_ENCODERS: dict[str, "Encoder"] = {}
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?*$%&#|]*)\Z")
# First bytes of the characters before which a space begins a piece: visible
# ASCII, and U+00C0 to U+023F.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xC9] = True


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary uses for each byte: itself where it
    is printable, else the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``encode`` gives the ids of texts, flat, and their offsets."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True   # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.split = (not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                      and not pre.get("add_prefix_space") and model.get("type", "BPE") == "BPE"
                      and not model.get("ignore_merges") and not model.get("continuing_subword_prefix"))
        self.size = self.tokenizer.get_vocab_size()
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.pool, self.start = array("I", [END]), array("q", [0, 1])   # number 0: the end of a text
        self.text, self.text_at = bytearray(), array("q", [0, 0])        # the bytes of each number
        self.tables = [self._table(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    @staticmethod
    def _table(key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return key[order], number[order]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> np.ndarray:
        """Encode stretches; their numbers in the pool."""
        first, number = len(self.start) - 1, np.zeros(len(fresh), np.int64)
        other: list[int] = []
        extend, close, size = self.pool.extend, self.start.append, len(self.pool)
        merge, plain, space = self.merge, _PLAIN.match, self.letters[32]
        for i, s in enumerate(fresh):
            m = plain(s)
            if m is None:
                other.append(i)
                continue
            before, letters, marks = m.groups()
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in merge(space + letters if before else letters)]
            if marks:
                ids += [t.id for t in merge(marks)]
            extend(ids)
            size += len(ids)
            number[i] = first
            first += 1
            close(size)
        for i, ids in zip(other, self._ids([fresh[i] for i in other])):
            extend(ids)
            size += len(ids)
            number[i] = first
            first += 1
            close(size)
        return number

    def _kept_same(self, number: np.ndarray, data: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches kept as ``number`` have these bytes."""
        at = np.frombuffer(self.text_at, np.int64)
        same = at[number + 1] - at[number] == size
        i = np.flatnonzero(same & (size > 8))             # shorter ones of one length have their own hashes
        same[i] = same_bytes(np.frombuffer(self.text, np.uint8), at[number[i]], data, a[i], size[i])
        return same

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The pool number of every stretch. Equal hashes only say where to look: the
        bytes decide. A stretch whose hash another one has is encoded by itself."""
        h = hash_spans(data, start, end)
        key, at, which = np.unique(h, return_index=True, return_inverse=True)
        size = end - start
        other = size != size[at][which]
        i = np.flatnonzero(~other & (size > 8))
        other[i] = ~same_bytes(data, start[i], data, start[at[which[i]]], size[i])
        a, z = start[at], end[at]
        number = np.full(len(key), -1, np.int64)
        clash = np.zeros(len(key), bool)
        for k, n in self.tables:
            if len(k):
                i = np.minimum(np.searchsorted(k, key), len(k) - 1)
                hit = np.flatnonzero(k[i] == key)
                same = self._kept_same(n[i[hit]], data, a[hit], (z - a)[hit])
                clash[hit[~same]] = True
                number[hit[same]] = n[i[hit[same]]]
        new = np.flatnonzero(number < 0)
        odd = np.flatnonzero(other)
        if len(new) or len(odd):
            raw = data.tobytes()
            fresh = [raw[x:y] for x, y in zip(np.concatenate([a[new], start[odd]]).tolist(),
                                              np.concatenate([z[new], end[odd]]).tolist())]
            learnt = self._learn([x.decode("utf-8", "replace") for x in fresh])
            order = np.argsort(learnt)                     # numbers are given without gaps
            size = np.concatenate([z[new] - a[new], end[odd] - start[odd]])[order]
            self.text_at.frombytes((len(self.text) + np.cumsum(size)).astype(np.int64).tobytes())
            self.text += b"".join([fresh[i] for i in order.tolist()])
            number[new] = learnt[:len(new)]
            keep = new[~clash[new]]
            recent = self._table(*(np.concatenate([x, y[keep]]) for x, y in zip(self.tables[1], (key, number))))
            if len(recent[0]) > RECENT:
                self.tables = [self._table(*(np.concatenate(x) for x in zip(self.tables[0], recent))),
                               tuple(x[:0] for x in recent)]
            else:
                self.tables = [self.tables[0], recent]
            out = number[which]
            out[odd] = learnt[len(new):]
            return out
        return number[which]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts whose UTF-8 bytes lie in ``data`` at ``off``;
        each text's ids end with ``END``."""
        docs = len(off) - 1
        if not self.split:
            raw = data.tobytes()
            own = [np.array(x + [END], np.uint32) for x in self._ids(
                [raw[a:z].decode("utf-8", "replace") for a, z in zip(off[:-1].tolist(), off[1:].tolist())])]
            return (np.concatenate(own) if own else np.zeros(0, np.uint32),
                    np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)]).astype(np.int64))
        if len(self.start) > CACHE:
            self._forget()
        size = np.diff(off)
        begins = np.zeros(len(data) + 1, bool)
        begins[:-2] = (data[:-1] == 0x20) & _VISIBLE[data[1:]] if len(data) > 1 else False
        begins[off[1:][size > 0] - 1] = False      # a space that ends a text begins nothing
        begins[off[:-1][size > 0]] = True
        start = np.flatnonzero(begins[:-1])
        first = np.searchsorted(start, off)
        end = np.append(start[1:], len(data))[:len(start)]
        which = np.zeros(len(start) + docs, np.int64)   # a stretch's place is moved by the texts that ended before it
        if len(start):
            which[np.arange(len(start)) + np.repeat(np.arange(docs), np.diff(first))] = self._numbers(data, start, end)
        at = np.frombuffer(self.start, np.int64)
        n = at[which + 1] - at[which]
        place = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(self.pool, np.uint32)[np.repeat(at[which] - place[:-1], n) + np.arange(place[-1])]
        return ids, place[first + np.arange(docs + 1)]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for a list of texts."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        return self.encode(np.frombuffer(b"".join(raw), np.uint8),
                           np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64))


def _return_freed_memory() -> None:
    """Let glibc give freed blocks of 8 MB and more back to the system; by default
    it raises that size as arrays are freed, and workers keep half of what they
    once held. Other C libraries have no such setting."""
    try:
        ctypes.CDLL(None).mallopt(-3, 8 << 20)
    except (AttributeError, OSError):
        pass


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _return_freed_memory()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    """Where the public 50k byte-level BPE vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
