"""Repair against every way to edit: costs, least audits, repaired texts and counts, in one piece and in many."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from tallyforge.llm.queries import op13_conversation_repair
from tallyforge.llm.repair import Automaton, damage, matrix, repair_conversations, times

INSIDE = {"": "su", "s": "u", "u": "a", "a": "u"}
WORD = re.compile(r"[^\x20\x09-\x0D]")


def order(r):
    return tuple((x is not None, x) for x in r)


def damaged(rows):
    out = []
    for conv, turn, role, text in sorted(rows, key=order):
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def by_hand(rows):
    """rows: (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        words = WORD.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, inserts):
        """Least (cost, audit) from row i on, and the repaired rows that go with it."""
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append(((0, ""), ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if role[0] in INSIDE[last]:
                    (c, a), rest = best(i, role[0], inserts + 1)
                    ways.append(((c + 2, "I" + a), (f"{role}:", *rest)))
        if i < len(rows):
            _, role, text = rows[i]
            (c, a), rest = best(i + 1, last, 0)
            ways.append(((c + 3, "D" + a), rest))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if role[:1] and role[0] in INSIDE[last]:
                    (c, a), rest = best(i + 1, role[0], 0)
                    ways.append(((c + extra, "K" + a), (f"{role}:{text}", *rest)))
                for new in ("user", "assistant"):
                    if new[0] in INSIDE[last]:
                        (c, a), rest = best(i + 1, new[0], 0)
                        ways.append(((c + 2 + extra, "R" + a), (f"{new}:{text}", *rest)))
        return min(ways) if ways else ((10**9, ""), ())

    (cost, audit), repaired = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()


def grouped(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return by


def of(df):
    found = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def test_query_against_brute_force(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert of(op13_conversation_repair(spark, d)) == {k: by_hand(damaged(v)) for k, v in grouped(rows).items()}


def noise(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "user", "assistant", "", None], ["Yes.", "No!", "cut", "", " \t", "Why?", None, "a.b", "é.  ", "Yes."]
    return [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice([*texts, f"text {i}.", f"part {i}"])) for i in range(n)]


def test_pieces_agree_with_brute_force(spark):
    rng = random.Random(8)
    for n, size in ((60, 4096), (60, 5), (160, 16), (9, 1)):
        rows = noise(rng, n)
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, fault int, gone string")
        assert of(repair_conversations(df, damage, size)) == {k: by_hand(damaged(v)) for k, v in grouped(rows).items()}
        plain = {k: by_hand([(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in sorted(v, key=order)]) for k, v in grouped(rows).items()}
        assert of(repair_conversations(df, size=size)) == plain


def test_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert repair_conversations(spark.createDataFrame([], schema), damage).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"k{i}:0".encode()) % 20 == 0)
    long = "word " * 200_000 + "end."
    rows = [(f"k{gone}", 0, "user", "Hi."), ("long", 1, "user", long), ("long", 1, "user", long), ("long", 2, "assistant", "Yes.")]
    got = of(repair_conversations(spark.createDataFrame(rows, schema), damage))
    assert got == {k: by_hand(damaged(v)) for k, v in grouped(rows).items()}
    assert got[f"k{gone}"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_automaton_stays_small_and_pieces_compose():
    rng, auto = random.Random(9), Automaton()
    for _ in range(300):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randrange(1, 60)))
        cut = rng.randrange(len(symbols) + 1)
        whole, _ = auto.scan(symbols, (0, 4, 2, 0))
        assert whole == times(matrix(auto, symbols[:cut]), times(matrix(auto, symbols[cut:]), [0, 4, 2, 0]))
    assert len(auto.vectors) < 200
