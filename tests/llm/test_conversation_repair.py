import hashlib
import itertools
import random
import re
import zlib

import pytest

from quadrat.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, copies string, digest string, edit string, at string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
OK = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """(initial, fault, role, text) of (role, text) rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        if not BLANK.search(text):
            f = "blank"
        elif (role, text) in seen:
            f = "duplicate"
        else:
            f = "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], f, role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) over all edits, by search over audit and output."""
    layer = {("", ""): (0, "", [])}

    def put(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value

    def short(out):                          # all that the pattern needs to know of the output
        return out if len(out) < 2 else "ua" if out[-2:] == "ua" else out[-1]

    def insert(layer):
        for _ in range(3):
            for (out, _k), (c, a, lines) in list(layer.items()):
                for role in ("user", "assistant"):
                    new = out + role[0]
                    if re.match(r"(s?(ua)*u?)\Z", new):
                        put(layer, (short(new), ""), (c + 3, a + "I", lines + [role + ":"]))
        return layer

    for initial, f, role, text in rows:
        insert(layer)
        after = {}
        for (out, _k), (c, a, lines) in layer.items():
            put(after, (out, ""), (c + 4, a + "D", lines))
            if f in ("blank", "duplicate"):
                continue
            more = 3 if f == "truncated" else 0
            for cost, letter, as_role in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                new = out + as_role[:1]
                if as_role and re.match(r"(s|s?(ua)*u?)\Z", new):
                    put(after, (short(new), ""), (c + cost + more, a + letter, lines + [f"{as_role}:{text}"]))
        layer = after
    insert(layer)
    return min((v for (out, _k), v in layer.items() if OK.match(out)), key=lambda v: v[:2])


def expected(rows):
    """The query's answer for conversations (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            mine += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, _, _ in mine if t is not None}
        rows_ = faults([r[1:] for r in mine])
        kinds = [f for _, f, _, _ in rows_]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows_))
        cost, audit, lines = cheapest(rows_) if rows_ else (0, "", [])
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
                     kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)


def answers(df):
    got = [tuple(r) for r in df.collect()]
    assert df.columns == ["conv_id", *C.REPORT, "cost", "audit", "repaired_sha256"]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def talk(r, n, conv):
    """A conversation with faults of every kind."""
    texts = ["Yes.", "No", "What?", "", " \n", "A longer answer, it ends here! ", "cut off"]
    out, turn = [], r.choice([0, 0, 5])
    for i in range(n):
        role = r.choice(["system", "user", "assistant"]) if r.random() < .4 else ("user", "assistant")[i % 2]
        if r.random() < .05:
            role = r.choice(["tool", "", None, "User"])
        text = r.choice(texts) if r.random() < .4 else f"text {r.randrange(40)}" + r.choice([".", "!", "", ". "])
        out.append((conv, None if r.random() < .04 else turn, role, None if r.random() < .03 else text))
        turn += r.choice([1, 1, 1, 1, 2, 0, 7])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_least_edits(seed):
    """All sequences of up to four rows, and longer ones at random."""
    kinds = [("u", C.SOUND), ("a", C.SOUND), ("s", C.SOUND), ("", C.SOUND), ("u", C.CUT), ("a", C.DOOMED)]
    name = {C.SOUND: "", C.CUT: "truncated", C.DOOMED: "blank"}
    r = random.Random(seed)
    some = [c for n in range(5) for c in itertools.product(kinds, repeat=n)] if not seed else [
        tuple(r.choice(kinds) for _ in range(r.choice([6, 15, 16, 17, 33, 70]))) for _ in range(120)]
    for rows in some:
        want = cheapest([(i, name[f], {"u": "user", "a": "assistant", "s": "system", "": "tool"}[i], "t") if i else
                         ("t", name[f], "tool", "t") for i, f in rows])
        chain = C.Chain()
        step = C.BLOCK if seed < 2 else 3
        for i in range(0, len(rows), step):
            chain.add(C.block_matrix(rows[i:i + step]))
        assert C.best(chain.matrix()) == want[:2], rows


def test_equals_brute_force(spark):
    r = random.Random(7)
    rows = [x for conv in range(150) for x in talk(r, r.choice([1, 2, 4, 5, 8, 12]), conv)]
    rows += talk(r, 700, 1000) + talk(r, 25, None)
    rows += [(2000, t, "user", "same words.") for t in range(200)] + [(2001, None, None, None)] * 3
    rows += [(3000 + i, 0, "user", "only one row") for i in range(60)]
    rows += [(4000, 1, "user", "x" * 300_000 + "."), (4000, 2, "assistant", "y " * 150_000)]
    got = answers(C.repair_report(C.damaged(table(spark, rows))))
    want = expected(rows)
    assert set(got) == set(want)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in got.values())


def test_repaired_rows(spark):
    r = random.Random(8)
    rows = [x for conv in range(40) for x in talk(r, 6, conv)]
    given = C.as_given(table(spark, rows))
    found = C.audits(given)
    audit = {x.conv_id: x.audit for x in found.collect()}
    got = {}
    for x in C.repair(given, found).orderBy("conv_id", "place").collect():
        got.setdefault(x.conv_id, []).append(x)
    for conv, a in audit.items():
        mine = got.get(conv, [])
        assert [x.place for x in mine] == list(range(len(mine)))
        assert "".join(x.edit for x in mine) == a.replace("D", "")
        assert OK.match("".join(x.role[0] for x in mine))
        assert len(a.replace("I", "")) == 6
        texts = {y[3] if y[3] is not None else " " for y in rows if y[0] == conv}
        assert all(x.text in texts if x.edit != "I" else x.text == "" for x in mine)


def test_empty(spark):
    assert C.repair_report(C.damaged(table(spark, []))).count() == 0
    assert C.repair(C.as_given(table(spark, [])), C.audits(C.as_given(table(spark, [])))).count() == 0
