import random
import re
import time

import pyarrow as pa

from quadrat.llm import bytewords as B
from quadrat.llm import license_scan, pii
from quadrat.llm.shared import text_buffers

from .common import frame, odd_rows


def _reference(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
               if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
                 if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]}


def test_base_detectors():
    r = random.Random(5)
    parts = ["a", "@", "b.c", ".", "1", "23", "4111111111111111", "255.", "+", "-", " ", "(", "x@y.zz", "é", "_",
             "0000256", "10.0.0.1", "+1 (555) 555-1234"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert pii.detect(t) == _reference(t), t


def test_disguises_map_back():
    cases = {"mail john dot smith at example dot com now": ("email", "john dot smith at example dot com"),
             "write to jane [at] mail (dot) org please": ("email", "jane [at] mail (dot) org"),
             "call plus one five five five two three four five six seven": ("phone", "plus one five five five two three four five six seven"),
             "é ａｂ@ｘ.ｃｏｍ!": ("email", "ａｂ@ｘ.ｃｏｍ"), "see foo @ bar.com": ("email", "foo @ bar.com"),
             "host ١٠.٠.٠.١ up": ("ip", "١٠.٠.٠.١")}
    for t, (kind, part) in cases.items():
        base, added = pii.find(t)
        assert not any(base.values())
        assert [(k, t[a:z]) for k in pii.KINDS for a, z in added[k]] == [(kind, part)]
        assert pii.mask(t) == t.replace(part, f"[{kind.upper()}]")
    for t in ("look at example.com", "one two three", "the dot at the end", "", "nothing here"):
        assert pii.find(t) == ({k: [] for k in pii.KINDS},) * 2
    assert pii.mask("a@b.cd, +1 (456) 555-2186") == "[EMAIL], [PHONE]"


def test_disguises_around_a_fragment():
    for part in ("jоhn.smith@example.com", "john@mail.example dot com", "john dot smith@example.com",
                 "john (dot) smith@example.com", "john dot smith at example.com", "jane@exаmple.com", "a.b@x.y [dot] org"):
        t = f"Write to {part}, please"
        base, added = pii.find(t)
        assert base == pii.detect(t) and [t[a:z] for a, z in added["email"]] == [part]
        assert pii.mask(t) == "Write to [EMAIL], please"
    for t in ("é a@b.cd", "é +1 (456) 555-2186", "the dot. a@b.cd", "meet at example.com"):
        assert not any(pii.find(t)[1].values())


def test_spelled_digits_of_any_words(monkeypatch):
    for part in ("+1 555 one six one six 42", "+33 un six neuf un 45 67 89", "+1 555 one 6 six 1 uno 4 seis 2"):
        t = f"Call {part}, please"
        assert pii.mask(t) == "Call [PHONE], please"
    r = random.Random(8)
    words = [*pii.DIGIT_WORDS, *pii.MARK_WORDS, "1", "42", "+", "someone", "a", "Ünder", "İ", "ONE", "Fünf"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", "-", ", ", ".", ""]) for _ in range(r.randint(0, 14)))
             for _ in range(5000)]
    gated = [getattr(pii.spelled_digits(t), "text", None) for t in texts]
    monkeypatch.setattr(pii, "_has_run", lambda low: True)
    assert gated == [getattr(pii.spelled_digits(t), "text", None) for t in texts] and len(set(gated)) > 1000


def test_wider_disguises():
    for kind, part in (("ip", "192[.]168[.]1[.]1"), ("ip", "192 dot 168 dot 1 dot 1"), ("email", "joe_AT_mail_DOT_com"),
                       ("email", "joe arroba mail punto com"), ("email", "joe punkt x at mail punkt de"),
                       ("email", "joe (ät) mail (punkt) de"), ("phone", "+1 (five five five) one two three four five six"),
                       ("phone", "+1 five five five oh one two three four five six"), ("card", "l111 1111 1111 1117"),
                       ("email", "a" * 40 + " dot last at mail dot com")):
        t = f"é Write: {part}; thanks"
        base, added = pii.find(t)
        assert [(k, t[a:z]) for k in pii.KINDS for a, z in added[k]] == [(kind, part)], part
    for t in ("look at the dot on the map", "a look at a point of view", "he stood at point b and at dot five", "at noon. dot com",
              "en un punto de vista", "version 1 point 2", "code l1O1 and B8", "one at a time, two at once"):
        assert pii.find(t)[1] == {k: [] for k in pii.KINDS}, t


def test_long_runs_are_read_once():
    n = 1_000_000
    for t in (" " * n + "anecdote", "dot" + "\n" * n + "anecdote at x", "[" * n + "dot ", "[ " * (n // 2) + " dot ",
              "x at y" + " )" * (n // 2) + " dot z", "a at " * (n // 5) + " dot b", "joe at at dot " * (n // 14),
              "1 " * (n // 2), "one " * (n // 4) + "dot x", (" " * 1000 + "at") * (n // 1002) + " dot x",
              "x@a" + " dot a" * (n // 6), "one" + " (" * (n // 2) + "five dot ", "joe at mail dot com " * (n // 20)):
        began = time.process_time()
        pii.find(t)
        assert time.process_time() - began < 6, t[:40]


def test_personal_data_rows(spark):
    rows = odd_rows() + [(20, "x@y.zz and 10.0.0.1, é +1 (456) 555-2186, card 4387513035237269")]
    got = pii.personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    r = next(r for r in got if r.doc_id == 20)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, int(pii.luhn("4387513035237269")), 1)
    assert r.spans.startswith("email:0:6,ip:11:19")
    assert pii.personal_data(frame(spark, [])).count() == 0
    df = frame(spark, rows)
    out = pii.masked(df)
    assert out.schema == df.schema
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text is None and by[1].n_chars is None and by[20].text.startswith("[EMAIL] and [IP], é [PHONE]")
    assert by[20].n_chars == len(by[20].text)


def _base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    at, labels = [], set()
    for p, label in license_scan.PHRASES.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    r = random.Random(1)
    parts = ["MIT", "License", "mit license", "Apache License, Version 2.0", "general public", "LICENSE", "é", "x-y", "\n",
             "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "GNU General Public License"]
    rows = odd_rows() + [(100 + i, " ".join(r.choice(parts) for _ in range(r.randint(0, 8)))) for i in range(150)]
    rows += [(500, "Words before. Licensed under CC BY-NC 4.0. Words after"), (501, "licensed cc under by nc"),
             (502, "MIT license")]
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    assert sorted((key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word)), r.base_labels) for r in got) == sorted(
        (key((i, *_base(t)[:4])), _base(t)[4]) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[500].labels == "cc-by-nc" and by[500].score > 0.9 and by[500].base_labels == ""
    assert by[501].labels == "" and by[502].labels == "mit"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_scan.license_scan(frame(spark, [])).count() == 0


def test_every_licence_of_a_file_is_found(spark):
    r = random.Random(4)
    texts = {}
    for label, phrase, text in license_scan.TEMPLATES:
        texts.setdefault(label, text if phrase in text else f"{text} {phrase}")
    prose = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    notice = " ".join(f"{prose(50)} {t}" for t in texts.values())
    rare = " mozilla affero unencumbered cc0 redistribution dedication fee lesser nc sa ".join(prose(300) for _ in range(4))
    alone = [(100 + i, f"{rare} {t} {rare}") for i, t in enumerate(texts.values())]
    got = {x.doc_id: x for x in license_scan.license_scan(frame(spark, [(1, notice), (2, prose(90)), *alone])).collect()}
    assert set(got[1].labels.split(",")) == set(texts) and got[1].score > 0.99 and got[2].labels == ""
    assert all(label in got[100 + i].labels.split(",") for i, label in enumerate(texts))


def test_licence_votes_equal_trying_every_place():
    r = random.Random(6)
    idf = {w: r.choice([0.1, 1.0, 4.0, 9.0]) for w in license_scan.VOCABULARY}
    ix = license_scan.RareWordIndex(idf)
    texts = []
    for _ in range(300):
        w = []
        for _, phrase, t in r.sample(license_scan.TEMPLATES, 3):
            t = t.split() if r.random() < 0.7 else phrase.split() + t.split()
            w += [r.choice(license_scan.VOCABULARY) if r.random() < 0.1 else x for x in t if r.random() > 0.03]
        texts.append(w[r.randrange(4):])
    data, off = text_buffers(pa.array([" ".join(w) for w in texts]))
    words = B.find_words(data, off, B.ALNUM)
    got = {}
    for d, label, x in ix.scan(license_scan._licence_words(words, *license_scan._vocabulary_ids()), words):
        got[d, label] = max(x, got.get((d, label), 0))
    want = {}
    for d, w in enumerate(texts):
        for label, phrase, t in license_scan.TEMPLATES:
            t, p = t.split(), phrase.split()
            starts = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            rare = {license_scan.VOCABULARY[i] for i in ix._rare([license_scan.VOCABULARY.index(x) for x in t])}
            for shift in {i - k for i, x in enumerate(w) for k, y in enumerate(t) if x == y and x in rare}:
                if not any(shift - 2 <= i <= shift + len(t) + 2 for i in starts):
                    continue
                has = [y for k, y in enumerate(t) if y in w[max(0, shift + k - 2):max(0, shift + k + 3)]]
                x = min(1.0, sum(idf[y] for y in has) / sum(idf[y] for y in t))
                if x >= license_scan.MIN_SCORE and len(set(has)) >= 2:
                    want[d, label] = max(x, want.get((d, label), 0))
    assert set(got) == set(want) and len(want) > 300
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
