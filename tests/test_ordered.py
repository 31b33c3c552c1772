"""Pieces of ordered rows against plain loops, with one key that holds half of all rows."""

import random

from tallyforge.operators import ledger
from tallyforge.operators.ordered import PIECE, POS, in_pieces, neighbours, running_sum

SCHEMA = "k string, o int, t string, v long"


def rows_of(seed, n):
    rng = random.Random(seed)
    return [("hot" if i % 2 else rng.choice(["a", "b", None, "rare" + str(rng.randrange(40))]), rng.randrange(30), rng.choice(["", "x" * 40 + rng.choice("pq"), None, f"t{i}"]), rng.choice([None, rng.randrange(-9, 99)])) for i in range(n)]


def order(r):
    return tuple((x is not None, x) for x in r[:3])


def test_order_and_sizes(spark):
    rows = rows_of(1, 900)
    got = in_pieces(spark.createDataFrame(rows, SCHEMA), ["k"], ["o", "t"], 16).orderBy(POS).collect()
    assert [order(r) for r in got] == sorted(map(order, rows)) and len({r[POS] for r in got}) == len(got)
    sizes = {}
    for r in got:
        sizes[r[PIECE]] = sizes.get(r[PIECE], 0) + 1
    assert max(sizes.values()) <= 16 and [r[PIECE] for r in got] == sorted(r[PIECE] for r in got)
    assert in_pieces(spark.createDataFrame([], SCHEMA), ["k"], ["o"]).count() == 0


def test_running_sums_and_neighbours(spark):
    pieces = in_pieces(spark.createDataFrame(rows_of(2, 700), SCHEMA), ["k"], ["o", "t"], 7)
    sums, near = running_sum(pieces, ["k"], "v", "s"), neighbours(pieces, ["k"], ["v", POS])
    got = {r[POS]: r for r in sums.join(near.select(POS, "_prev", "_next"), POS).collect()}
    last, total = {}, {}
    for at in sorted(got):
        r = got[at]
        if r.v is not None:
            total[r.k] = (total.get(r.k) or 0) + r.v
        assert r.s == total.get(r.k)
        assert (r._prev and r._prev[POS]) == last.get(r.k) and (r._prev is None or got[last[r.k]]._next[POS] == at)
        last[r.k] = at
    assert all(got[at]._next is None for at in last.values())


def test_balances_do_not_depend_on_pieces(spark):
    """One account with half of all rows: small pieces, large ones and windows agree."""
    rng, rows, held = random.Random(3), [], {}
    for i in range(1200):
        k, amount = "hot" if i % 2 else f"k{rng.randrange(9)}", rng.randrange(-500, 500)
        held[k] = held.get(k, 1000) + amount
        rows.append((k, i, amount if i % 37 else None, held[k] + (7 if i % 41 == 0 else 0) if i % 5 else None))
    rows += [("up", 2000 - i, 10, 10 * i) for i in range(30)] + [("none", 1, None, None), (None, 1, 5, 5), (None, 2, 5, 11)]
    df = spark.createDataFrame(rows, "account string, i int, amount long, balance long")
    want = {(r.account, r.i): r.balance_mismatch for r in ledger.tag_balance_mismatches(df, "account", ["i"]).collect()}
    checks = [sorted(map(tuple, ledger.balance_check(df, ["account"], ["i"], size).collect()), key=str) for size in (5, 4096)]
    assert checks[0] == checks[1] and len(checks[0]) == 13
    hot = [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == "hot"]
    opening = next(b - a for _, _, a, b in hot if a is not None and b is not None)
    assert next(c for c in checks[0] if c[0] == "hot")[1] == opening and next(c for c in checks[0] if c[0] == "hot")[3] == sum(a or 0 for _, _, a, _ in hot)
    for size in (5, 4096):
        assert {(r.account, r.i): r.balance_mismatch for r in ledger.tag_running_mismatches(df, "account", ["i"], size).collect()} == want
    assert sum(want.values()) > 20


def test_statements_do_not_depend_on_where_they_are_cut(spark):
    from tallyforge.operators import pages
    from tallyforge.operators import statement_pages as sp

    rng, lines = random.Random(5), []
    said = ["12 Jan 2026", "Monday, 13 Jan 2026", "Coffee 4.50", "SGD 12.00", "Rent of a room", "Page 1 of 2", "Card service", "", "Paid -3.00", "Available balance 9.00", "2026", "Odd 1,000.00 CR", "Name: 7.25"]
    for file in ("long", "b", "c"):
        lines += [(file, i, rng.choice(said)) for i in range(400 if file == "long" else 25)]
    df = spark.createDataFrame(lines, "file_id string, line int, text string")
    want = sorted(map(tuple, sp.grouped_statement(df).collect()))
    assert len(want) > 100 and sp.grouped_statement(df.limit(0)).count() == 0
    for size in (1, 3, 16):
        assert sorted(map(tuple, sp.grouped_statement(df, size=size).collect())) == want
    start = df["text"].startswith("Page")
    want = sorted(map(tuple, pages.wrapped_rows(df, ["file_id"], ["line"], start).collect()))
    assert sorted(map(tuple, pages.wrapped_rows(df, ["file_id"], ["line"], start, size=2).collect())) == want
    by = {}
    for file, _, text in lines:
        rows = by.setdefault(file, [])
        if text.startswith("Page"):
            rows.append([text])
        elif rows:
            rows[-1].append(text)
    assert want == sorted((f, i + 1, " ".join(r), len(r)) for f, rows in by.items() for i, r in enumerate(rows))
