"""Personal data, with offset-preserving deobfuscation (operator 6).

The base detectors find e-mail addresses, IP addresses, card numbers and phone
numbers in the text as it stands. Then four transducers rewrite it, each keeping
for every stretch of output the source characters it came from: homoglyphs,
digits of other scripts and invisible characters; runs of spelled-out digits;
dots written out in IP addresses and letters in card numbers; at/dot disguises of
addresses. The detectors run again on the rewritten text
and their spans are carried back through the transducers to source characters;
those that lie in no base span of their kind are added. An added span may thus
hold or overlap base spans, fragments of what was disguised.

Defined results: a null or empty text has no spans; a null id keeps its row;
repeated rows are scanned each; an empty table gives an empty result; other
columns are ignored (``masked`` keeps them). Offsets are code points, ends
exclusive. Whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin only where a run of digits begins, so the look-behind and the
# possessive repeats change no result; they keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _local_start(t: str, at: int, low: int) -> int:
    while at > low and t[at - 1] in _LOCAL:
        at -= 1
    return at


def emails(t: str) -> list[Span]:
    """Leftmost matches: the local part is the run before an @ that no earlier
    match has taken."""
    out, last, p = [], 0, t.find("@")
    while p >= 0:
        s = _local_start(t, p, last)
        m = _DOMAIN.match(t, p + 1) if s < p else None
        if m:
            last = m.end()
            out.append((s, last))
        p = t.find("@", p + 1)
    return out


def ips(t: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(t) if all(int(x[-4:]) <= 255 and (len(x) <= 3 or not x[:-3].strip("0"))
                                                     for x in m.group().split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if c.isdecimal())


def cards(t: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(t) if m.end() - m.start() >= 16
            and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(t: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(t) if 8 <= len(_digits(m.group())) <= 15]


def detect(t: str) -> dict[str, list[Span]]:
    """Spans of every kind in a text."""
    digit = _DIGIT.search(t) is not None
    return {"email": emails(t) if "@" in t else [], "ip": ips(t) if digit else [],
            "card": cards(t) if digit else [], "phone": phones(t) if digit and "+" in t else []}


class Rewritten:
    """A rewritten text that knows where each stretch came from."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """``edits``: ascending, disjoint (start, end, new text) of the source."""
        out, self.at, self.src, self.copied = [], [], [], []
        size = last = 0

        def add(a: int, z: int, new: str | None):
            nonlocal size
            x = source[a:z] if new is None else new
            if x:
                out.append(x)
                self.at.append(size)
                self.src.append((a, z))
                self.copied.append(new is None)
                size += len(x)

        for a, z, new in edits:
            add(last, a, None)
            add(a, z, new)
            last = z
        add(last, len(source), None)
        self.text = "".join(out)

    def back(self, span: Span) -> Span:
        """The source characters of a span of the rewritten text."""
        i, j = bisect_right(self.at, span[0]) - 1, bisect_right(self.at, span[1] - 1) - 1
        start = self.src[i][0] + (span[0] - self.at[i] if self.copied[i] else 0)
        end = self.src[j][0] + span[1] - self.at[j] if self.copied[j] else self.src[j][1]
        return start, end


# Letters of other scripts that look like a Latin one.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "α": "a", "ο": "o", "ρ": "p",
    "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ɡ": "g", "ı": "i",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u2024": ".", "\u3002": ".",
    "\u00a0": " ", "\u202f": " ", "\u3000": " ",
}
# Digit words.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
MARK_WORDS = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "plus": "+", "oh": "0"}
# Words for the at sign and the dot of an address, and the dots that may
# stand with a bare at word (a bare "at" beside "point" is ordinary prose).
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punkt", "punto", "point")
BARE_DOTS = {"at": ("dot", "punkt", "punto"), "arroba": DOT_WORDS, "arobase": DOT_WORDS, "ät": DOT_WORDS}
# Last labels before which a bare dot word counts after a bare at word
# (those that are English words, such as "in" or "me", are left out).
BARE_ENDS = frozenset((
    "ai", "app", "au", "biz", "br", "ca", "ch", "cloud", "cn", "co", "com", "cz", "de", "dev", "dk", "edu", "es", "eu", "fi",
    "fr", "gov", "gr", "hu", "ie", "info", "io", "jp", "kr", "mx", "net", "nl", "nz", "org", "pl", "pt", "ro", "ru", "se",
    "tv", "uk"))
# Letters read as digits in a card number.
CARD_LETTERS = {"l": "1", "I": "1", "O": "0", "o": "0", "S": "5", "B": "8"}
MIN_CARD_DIGITS = 12
MIN_DIGIT_WORDS = 4

_FOREIGN = re.compile("[\u00a0\u00ad\u0131\u0261\u0300-\U0010ffff]")
_INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_MARK = "|".join(sorted(MARK_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[\s-]{{1,9}})?(?:{_WORD}|[0-9])(?:[\s,()-]++(?:{_WORD}|{_MARK}|[0-9]++)(?!\w))+")
_PART = re.compile(r"\w+|\W+")
_TOKEN = re.compile(r"\w+")
# Marks are found first and their blanks walked over afterwards, and every repeat of
# blanks follows something else and gives nothing back, so that long runs of blanks,
# lines and brackets are read once.
_ATS, _DOTS = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_AT = re.compile(rf"(?i)[\[({{<]\s*+(?:{_ATS}|@)\s*+[\])}}>]|(?<=\s)(?:{_ATS}|@)(?=\s)|(?<=[A-Za-z0-9])_(?:at)_(?=[A-Za-z0-9])|@")
_DOT = rf"(?:\s*+[\[({{<]\s*+(?:{_DOTS}|\.)\s*+[\])}}>]\s*+|\s++(?:{_DOTS})\s++|_dot_|\.)"
_HOST = re.compile(rf"(?i)[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+")
_DOT_FORM = re.compile(rf"(?i){_DOT}")
_IP_FORM = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])")
_CARD_FORM = re.compile(r"(?<![A-Za-z0-9])[0-9lIOoSB](?:[ -]?[0-9lIOoSB]){15,18}(?![A-Za-z0-9])")
_DISGUISED = re.compile(rf"(?i)[\[({{<]\s*+(?:{_ATS}|@|{_DOTS}|\.)\s*+[\])}}>]|\s@\s|\s(?:{_DOTS})\s|_dot_")


def _blanks_before(t: str, at: int, low: int) -> int:
    while at > low and t[at - 1].isspace():
        at -= 1
    return at


def _word_before(t: str, at: int, low: int) -> str:
    """The dot word that ends at ``at``, or nothing."""
    for w in DOT_WORDS:
        if at - len(w) >= low and t[at - len(w):at].lower() == w:
            return w
    return ""


def _dot_before(t: str, end: int, low: int) -> int:
    """Where a disguised dot that ends at ``end`` begins, or -1."""
    at = _blanks_before(t, end, low)
    if at > low and t[at - 1] in "])}>":
        inside = _blanks_before(t, at - 1, low)
        inner = inside - 1 if inside > low and t[inside - 1] == "." else inside - len(_word_before(t, inside, low))
        opened = _blanks_before(t, inner, low) if inner < inside else low
        return _blanks_before(t, opened - 1, low) if opened > low and t[opened - 1] in "[({<" else -1
    word = _word_before(t, at, low) if at < end else ""
    start = at - len(word)
    before = _blanks_before(t, start, low)
    return before if word and before < start else -1


def _plain_letter(c: str) -> str:
    """The ASCII character that another one stands for, or itself."""
    if c in _INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() else c


def unify_letters(t: str) -> Rewritten | None:
    """Homoglyphs, digits of other scripts, invisible characters."""
    edits = [(m.start(), m.end(), p) for m in _FOREIGN.finditer(t) if (p := _plain_letter(m.group())) != m.group()]
    return Rewritten(t, edits) if edits else None


def _has_run(low: str) -> bool:
    """Some words in a row are digits, digit words and mark words, with enough
    digit words among them; without that there is no run to rewrite."""
    words = _TOKEN.findall(low)
    if sum(map(DIGIT_WORDS.__contains__, words)) < MIN_DIGIT_WORDS:
        return False
    n = 0
    for x in words:
        if x in DIGIT_WORDS:
            n += 1
            if n == MIN_DIGIT_WORDS:
                return True
        elif n and x not in MARK_WORDS and not x.isdecimal():
            n = 0
    return False


def spelled_digits(t: str) -> Rewritten | None:
    """Runs of digit words become digits; a mark word between them its mark."""
    if not _has_run(t.lower()):
        return None
    edits = []
    for m in _SPELLED.finditer(t):
        parts = [(x.start() + m.start(), x.end() + m.start(), x.group().lower()) for x in _PART.finditer(m.group())]
        if sum(x in DIGIT_WORDS for _, _, x in parts) < MIN_DIGIT_WORDS:
            continue
        for a, z, x in parts:
            if not x.isdecimal():
                edits.append((a, z, DIGIT_WORDS.get(x, MARK_WORDS.get(x, ""))))
    return Rewritten(t, edits) if edits else None


def addresses(t: str) -> Rewritten | None:
    """At and dot written out, spaced, bracketed or between underscores, where an
    address results. A bare at word counts only with a disguised dot, and a bare dot
    word only before a last label of letters."""
    if _DISGUISED.search(t) is None:
        return None
    edits, last, used = [], 0, 0
    for m in _AT.finditer(t):
        spaced = m.group() != "@" or (m.start() > 0 and t[m.start() - 1].isspace() and m.end() < len(t) and t[m.end()].isspace())
        left, right = m.start(), m.end()
        if spaced and m.group()[0] != "_":
            left = _blanks_before(t, left, 0)
            while right < len(t) and t[right].isspace():
                right += 1
        if left < max(last, used):
            continue
        used = right
        start = _local_start(t, left, last)
        host = _HOST.match(t, right) if start < left else None
        if host is None:
            continue
        dots = [(d.start(), d.end()) for d in _DOT_FORM.finditer(t, host.start(), host.end())]
        end = host.end()
        mark = m.group().strip("_").lower()
        bare = mark in AT_WORDS
        allowed = BARE_DOTS.get(mark, DOT_WORDS if m.group()[0] in "[({<" else ("dot",))
        for i, (a, z) in enumerate(dots):              # the host ends before a dot word that is prose
            word = t[a:z].strip().lower()
            label = t[z:dots[i + 1][0] if i + 1 < len(dots) else end].lower()
            final = i + 1 == len(dots)
            if t[a:z].lower() != f"_{word}_" and word in DOT_WORDS and (
                    word not in allowed or not label.isalpha() or bare and m.group()[0] not in "[({<" and final
                    and label not in BARE_ENDS):
                dots, end = dots[:i], a
                break
        if not dots:
            continue
        hidden = [d for d in dots if d[1] - d[0] > 1]
        before = []
        while (at := _dot_before(t, start, last)) >= 0:          # "first dot last at ..."
            s = _local_start(t, at, last)
            if s == at:
                break
            before.insert(0, (at, start, "."))
            start = s
        if (m.group() == "@" and not spaced or bare) and not hidden and not before:
            continue
        edits += before + [(left, right, "@")] + [(a, z, ".") for a, z in hidden]
        last = end
    return Rewritten(t, edits) if edits else None


def split_numbers(t: str) -> Rewritten | None:
    """Disguised dots between the parts of an IP address, and letters in place of
    some digits of a card number."""
    edits = []
    if _DISGUISED.search(t) is not None:
        for m in _IP_FORM.finditer(t):
            hidden = [(d.start(), d.end(), ".") for d in _DOT_FORM.finditer(t, m.start(), m.end()) if d.end() - d.start() > 1]
            if hidden and all(int(x) <= 255 for x in re.findall("[0-9]+", m.group())):
                edits += hidden
    for m in _CARD_FORM.finditer(t):
        letters = [(i, i + 1, CARD_LETTERS[c]) for i, c in enumerate(m.group(), m.start()) if c in CARD_LETTERS]
        if letters and sum(map(str.isdigit, m.group())) >= MIN_CARD_DIGITS:
            edits += letters
    return Rewritten(t, sorted(edits)) if edits else None


def _covered(s: Span, spans: list[Span]) -> bool:
    """Whether one of ascending spans holds this one."""
    i = bisect_right(spans, (s[0], sys.maxsize)) - 1
    return i >= 0 and s[1] <= spans[i][1]


def find(t: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, added spans) of a text by kind."""
    base = detect(t)
    steps, now = [], t
    for step in (unify_letters, spelled_digits, split_numbers, addresses):
        r = step(now)
        if r is not None:
            steps.append(r)
            now = r.text
    added = {k: [] for k in KINDS}
    if steps:
        for kind, spans in detect(now).items():
            for s in spans:
                for r in reversed(steps):
                    s = r.back(s)
                if not any(_covered(s, x) for x in (base[kind], added[kind])):
                    added[kind].append(s)
    return base, added


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k in KINDS for a, z in sorted(spans[k]))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans, digest of the base spans, all spans."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _ in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                base, added = find(t or "")
                rows.append([len(base[k]) for k in KINDS]
                            + [hashlib.sha256(_joined(base).encode()).hexdigest(),
                               _joined({k: base[k] + added[k] for k in KINDS})])
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, SCHEMA)


def mask(t: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; where spans of
    different kinds overlap, the whole stretch is replaced once."""
    if not t:
        return t
    base, added = find(t)
    spans = sorted((a, -z, k) for k in KINDS for a, z in base[k] + added[k])
    out, last = [], 0
    stop = -1
    for a, z, k in spans:
        z = -z
        if a < stop:                               # goes on a stretch that is already replaced
            stop = last = max(stop, z)
            continue
        out += [t[last:a], f"[{k.upper()}]"]
        stop = last = z
    return "".join([*out, t[last:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars`` (where
    there is such a column) brought up to date; all other columns as they are."""
    ship(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _ in slices(batches):
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = [mask(t) for t in old]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            n = b.schema.get_field_index("n_chars")
            if n >= 0:
                own = b.column(n).to_pylist()
                b = b.set_column(n, b.schema.field(n), pa.array(
                    [c if x == y else len(y) for c, x, y in zip(own, old, new)], b.schema.field(n).type))
            yield b

    return docs.mapInArrow(run, schema)
