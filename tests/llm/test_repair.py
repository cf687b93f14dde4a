"""Repair against enumeration of all edits, and against a plain loop over whole conversations."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import product

import pytest

from tessera.llm import repair


def tried(signature):
    """(cost, audit) over all edits with at most two inserts before each row and at the end."""
    best = None
    for edits in product("DRK", repeat=len(signature)):
        for gaps in product(range(3), repeat=len(signature) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""]))
            if best and (repair.INSERT * audit.count("I"), "") > best:
                continue
            roles, cost, at, good = "", 0, 0, True
            for e in audit:
                put = "a" if roles.endswith("u") else "u"
                if e == "I":
                    roles, cost = roles + put, cost + 2
                    continue
                letter = signature[at]
                at += 1
                if e == "D":
                    cost += 3
                elif letter in "0123":
                    good = False
                else:
                    roles, cost = roles + (put if e == "R" else letter.lower()), cost + (2 if e == "R" else 0) + letter.isupper()
            if good and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("signature", ["", *("".join(s) for n in (1, 2) for s in product("suaxSUAX02", repeat=n)), "uau", "ssu", "aua", "xX1", "Usa", "uuuu", "aaua", "s0ua", "SuaU"])
def test_cheapest_edits(signature):
    assert repair.solve(signature) == tried(signature)


@pytest.mark.parametrize("stride", [1, 3, 7])
def test_pieces_give_what_the_whole_gives(monkeypatch, stride):
    import random

    r = random.Random(stride)
    signatures = ["".join(r.choice("sssuuuaaaxSUAX0123") for _ in range(r.randrange(60))) for _ in range(60)]
    whole = [repair.solve(s) for s in signatures]
    monkeypatch.setattr(repair, "STRIDE", stride)
    assert [repair.solve(s) for s in signatures] == whole


def test_long_conversations():
    cost, audit = repair.solve("ua" * 100_000)
    assert cost == 0 and audit == "K" * 200_000


def plain(rows):
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        dice = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        role = "user" if dice == 4 else role
        convs.setdefault(conv, [])
        convs[conv] += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), turn, text)] * {0: 0, 3: 2}.get(dice, 1)
    for conv, said in convs.items():
        said.sort(key=lambda r: r[:4])
        signature, seen, counts = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, _, text in said:
            place, words = "sua".find(role[:1]) if role[:1] else -1, re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            signature += (repair.GONE if fault in ("blank", "duplicate") else repair.LARGE if fault else repair.SMALL)[place]
        cost, audit = repair.solve(signature)
        lines, at, led = [], 0, 0
        for e in audit:
            put = "assistant" if (len(lines) - led) % 2 else "user"
            if e == "K":
                led |= not lines and said[at][2][0] == "s"
                lines.append(f"{said[at][2]}:{said[at][5]}")
            elif e != "D":
                lines.append(f"{put}:{said[at][5] if e == 'R' else ''}")
            at += e != "I"
        turns = {r[4] for r in said} - {None}
        roles = [r[2][:1] for r in said]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


SCHEMA = "conv_id long, turn long, role string, text string, kind string, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_whole_conversations(spark):
    import random

    r = random.Random(5)
    texts = ["Yes.", "No!", "open end", "", "  \t", "Who?  ", None, "été.", "a.b", "z" * 200_000]
    rows = [(c, t if r.random() < 0.9 else t + 3, r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(texts)) for c in range(60) for t in range(r.randrange(9))]
    rows += [(None, None, "user", "Hi."), (None, 4, "assistant", "Hi."), (None, None, None, None)] + [(500, None, "user", "Same.")] * 3 + [(501, 2**40, "user", "Far."), (501, 0, "user", "Far.")]
    rows += [(700, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    got = repair.repaired(repair.damaged(frame(spark, rows).repartition(6))).collect()
    assert {x[0]: tuple(x[1:]) for x in got} == plain(rows) and len(got) == len(plain(rows))


def test_undamaged_and_empty(spark):
    assert repair.repaired(repair.damaged(frame(spark, []))).count() == 0
    got = repair.repaired(repair.sound(frame(spark, [(1, 0, "user", "A."), (1, 1, "assistant", "B.")]))).collect()
    assert [(x.cost, x.audit, x.repaired_sha256) for x in got] == [(0, "KK", hashlib.sha256(b"user:A.\nassistant:B.").hexdigest())]
