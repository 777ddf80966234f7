"""Conversation repair: every edit sequence tried on short conversations, long ones cut into blocks, and edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quarry.llm import repair

FORM = re.compile("(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def model(rows):
    """One conversation's digests by trying audits from the cheapest up: rows are (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    fault, seen = [], set()
    for _, r, x in rows:
        core = re.sub(r"[\x20\x09-\x0D]+$", "", x)
        fault.append("blank" if not re.search(r"[^\x20\x09-\x0D]", x) else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((r, x))
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, fault, strict=True)):
            continue
        base = sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (e != "D" and f == "truncated") for e, f in zip(edits, fault, strict=True))
        for inserts in range(3):
            if best and base + 5 * inserts > best[0]:
                break
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
                letters = []
                for i in range(len(rows) + 1):
                    letters += ["I"] * places.count(i) + ([edits[i]] if i < len(rows) else [])
                stay, at = [], 0
                for e in letters:
                    if e == "I":
                        stay.append((e, None, ""))
                    else:
                        if e != "D":
                            stay.append((e, rows[at][1], rows[at][2]))
                        at += 1
                for roles in itertools.product(*[[r] if e == "K" else ["user", "assistant"] for e, r, _ in stay]):
                    if FORM.fullmatch("".join(r[:1] or "-" for r in roles)):
                        audit = "".join(letters)
                        text = "\n".join(f"{r}:{x}" for r, (_, _, x) in zip(roles, stay, strict=True))
                        best = min(best or (10**9,), (base + 5 * inserts, audit, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: fault.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "cost": best[0], "audit": best[1], "repaired_sha256": hashlib.sha256(best[2].encode()).hexdigest(),
    }


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "q", "w") for r in rows], "conv_id long, turn long, role string, text string, part string, seq string, conv string")


def some_turns(rng, n):
    text = lambda: rng.choice(["Yes.", "No!", "cut off", "", " \t", "Why?", None, f"Say {rng.randrange(99)}.", "end. \n"])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
    return [(rng.choice([None, *range(9)]) if rng.random() < 0.2 else i, role(), text()) for i in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_paths_against_all_edits(seed):
    rng = random.Random(seed)
    rows = some_turns(rng, rng.randint(1, 6))
    want = model(rows)
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    turns = [r[1:] for r in rows]
    found = repair.faults(turns)
    assert repair.finished(repair.cheapest([r for r, _ in turns], found)) == (want["cost"], want["audit"])
    for size in (1, 2, 3):  # the same path over blocks
        parts = [(turns[a : a + size], found[a : a + size]) for a in range(0, len(turns), size)]
        grids = [[c for e in range(4) for c in repair.cheapest([r for r, _ in t], f, e)] for t, f in parts]
        ranks = [{a: k for k, a in enumerate(sorted({c[1] for c in g if c}))} for g in grids]
        path, inserts = repair.choose_path([[c and c[0] for c in g] for g in grids], [[c and r[c[1]] for c in g] for g, r in zip(grids, ranks, strict=True)])
        audit = "".join(g[4 * e + x][1] for g, (e, x) in zip(grids, path, strict=True)) + "I" * inserts
        assert audit == want["audit"] and sum(g[4 * e + x][0] for g, (e, x) in zip(grids, path, strict=True)) + 5 * inserts == want["cost"]


def test_inserts_where_they_pay(monkeypatch):
    monkeypatch.setattr(repair, "INSERT", 1)
    monkeypatch.setattr(repair, "DELETE", 4)
    turns = [("system", "S."), ("user", "a."), ("user", "b."), ("assistant", "c."), ("user", "d.")]
    cost, audit = repair.finished(repair.cheapest([r for r, _ in turns], [""] * 5))
    assert (cost, audit) == (2, "KKIKKKI")
    assert [(r, t) for _, r, t in repair.apply_audit(audit, turns)] == [turns[0], turns[1], ("assistant", ""), turns[2], turns[3], turns[4], ("assistant", "")]


def check(spark, rows, monkeypatch=None):
    digests, repaired = repair.repair_conversations(frame(spark, rows))
    got = {r["conv_id"]: r.asDict() for r in digests.collect()}
    convs = {}
    for c, *r in rows:
        convs.setdefault(c, []).append(tuple(r))
    assert set(got) == set(convs) and len(got) == digests.count()
    for c, own in convs.items():
        if len(own) <= 6:
            assert {k: v for k, v in got[c].items() if k != "conv_id"} == model(own), c
    stayed = {}
    for r in sorted(repaired.collect(), key=lambda r: (r["block"], r["place"])):
        stayed.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c in convs:
        assert hashlib.sha256("\n".join(stayed.get(c, [])).encode()).hexdigest() == got[c]["repaired_sha256"]
    return got


def test_conversations(spark):
    rng = random.Random(7)
    rows = [(c, *r) for c in [None, *range(60)] for r in some_turns(rng, rng.randint(1, 6))]
    rng.shuffle(rows)
    check(spark, rows)


def test_long_conversations_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, *r) for c in range(12) for r in some_turns(rng, 200 if c == 5 else rng.randint(1, 40))]
    rows += [(5, None, "user", "the same.")] * 300 + [(5, 3, "user", "x" * 5000)]
    whole = check(spark, rows)
    monkeypatch.setattr(repair, "BLOCK_TURNS", 7)
    monkeypatch.setattr(repair, "BLOCK_CHARS", 3000)
    assert check(spark, rows) == whole
    own = sorted(((t, r or (" " if r is None else r), x if x is not None else " ") for c, t, r, x in rows if c == 5), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    found = repair.faults([r[1:] for r in own])
    cost, audit = repair.finished(repair.cheapest([r for _, r, _ in own], found))
    assert (whole[5]["cost"], whole[5]["audit"]) == (cost, audit) and whole[5]["duplicate"] == found.count("duplicate") >= 299
    assert FORM.fullmatch("".join(r[:1] for _, r, _ in repair.apply_audit(audit, [r[1:] for r in own])))


def test_damage_and_conversations_without_turns(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None]), rng.choice(["Hi. There! ok?", "no", None, "z" * 9000 + "."])) for c in [*range(80), None] for t in [None, 0, 1]]
    turns = frame(spark, rows)
    want = {}
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind, r, x = zlib.crc32(key.encode()) % 20, " " if r is None else r, " " if x is None else x
        own = want.setdefault(c, [])
        if kind:
            own += [(t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)] * (2 if kind == 3 else 1)
    nothing = frame(spark, rows).filter("conv_id = 3")
    got = {r["conv_id"]: r.asDict() for r in repair.digests_of_all(repair.damage(turns), turns).collect()}
    assert set(got) == set(want)
    for c, own in want.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == model(own), c
    (only,) = repair.digests_of_all(nothing.filter("false"), nothing).collect()
    assert only.asDict() == {"conv_id": 3, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": EMPTY}
    assert repair.digests_of_all(repair.damage(turns.limit(0)), turns.limit(0)).count() == 0
