"""Names and phrases in texts against plain loops."""

import random
import re

from tallyforge.functions import text
from tallyforge.operators import names


def by_hand(t, known):
    return sorted((n, m.start(1), m.end(1)) for n in known for m in re.finditer(rf"(?<!\w)(?=({re.escape(n)}))(?={re.escape(n)}(?!\w))", t, re.I)) if t else []


def test_every_place_of_every_name(spark):
    known = ["Bank", "Bank of Where", "of Where", "of", "St. George", "O'Neil & Co", "bank of", "Ünion", "a", "a a", "Bank of Where Else Entirely"]
    texts = ["Bank of Where", "the BANK OF WHERE, bank of where else", "bankof where", "embankment", "St. George; St  George; st. georges", "O'Neil & Co. and o'neil & co", "ünion ÜNION", "a a a a", "", None, "İ Bank " * 3, "x" * 50 + " bank " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    told = spark.createDataFrame([(n, i) for i, n in enumerate(known)] + [(None, 99), ("...", 100)], "name string, ord int")
    got = {}
    for r in names.find_names(df, told, "id").collect():
        got.setdefault(r.id, []).append((r.name, r.start, r.stop))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == by_hand(t, known), t
    best = {r.id: r.name for r in names.first_names(df, told, "id").collect()}
    assert best[0] == "Bank" and best[6] == "Ünion" and best[2] is None and best[8] is None and len(best) == len(texts)


def test_ten_thousand_names(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    known = list({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(12000)})
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(20)]
    have = {}
    for n in known:
        have.setdefault(n, n)
    want = {}
    for i, t in enumerate(texts):
        ws = t.split()
        want[i] = sum(" ".join(ws[j : j + k]) in have for j in range(len(ws)) for k in (1, 2, 3) if j + k <= len(ws))
    got = names.find_names(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(n,) for n in known], "name string"), "id").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_phrases_against_all_windows(spark):
    rng = random.Random(2)

    def worn(p, k):
        for _ in range(k):
            at = rng.randrange(len(p) + 1)
            p = rng.choice([p[:at] + "q" + p[at:], p[:at] + p[at + 1 :], p[:at] + "z" + p[at + 1 :]])
        return p

    phrases = ["transaction history", "card", "ab", "x", "account statement of march", "no"]
    rows = [(p, "some words before " + worn(p, k) + " and some behind") for p in phrases for k in (0, 1, 1, 2, 2, 2, 3, 3, 4) for _ in range(4)]
    rows += [("", "text"), ("card", ""), (None, "card"), ("card", None), ("gone", "word " * 20000), ("transaction history", "word " * 20000 + "trnsaction histry")]
    df = spark.createDataFrame(rows, "p string, h string")
    got = df.select("p", "h", text.normalize_phrase("p").alias("np"), text.normalize_phrase("h").alias("nh"), text.token_overlap(text.normalize_phrase("p"), text.normalize_phrase("h")).alias("o"), text.fuzzy_in_text("p", "h").alias("f")).collect()
    for r in got:
        if not r.np or not r.nh:
            assert not r.f
            continue
        words, n = r.nh.split(" "), len(r.np.split(" "))
        windows = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
        assert bool(r.f) == (r.np in r.nh or (r.o or 0) >= 0.85 or any(abs(len(w) - len(r.np)) <= 4 and distance(w, r.np) <= 2 for w in windows)), (r.p, r.h[-60:])


def test_places_are_counted_where_texts_are_read(spark):
    """Ids that repeat, null ids and texts; no sort or aggregate between the texts and the exchange by id."""
    known = spark.createDataFrame([("bank",), ("bank of",), ("of",), (None,)], "name string")
    df = spark.createDataFrame([(1, "Bank of of"), (1, "a bank"), (None, "of"), (None, "bank"), (2, None), (3, ""), (4, "none"), (5, "bank " * 5000)], "id int, text string")
    out = names.sum_names(df, known, "id")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 5, 3, "bank"), (None, 2, 2, "bank"), (5, 5000, 1, "bank")], key=str)
    steps = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("\n")
    below = steps[max(i for i, x in enumerate(steps) if "Exchange hashpartitioning(id" in x) :]
    assert "REPARTITION_BY_NUM" in below[0] and not any("Aggregate" in x or "Sort" in x for x in below[: next(i for i, x in enumerate(below) if "MapInArrow" in x)])
