"""Matching with bounds against every pair scored in full."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import match


def test_bounds_leave_out_no_profile(spark):
    rng = random.Random(7)
    words = ["Date", "Amount", "Details", "Balance", "Debit", "Credit", "Ref", "Card No"]
    some = lambda pool, k: [rng.choice(pool) for _ in range(rng.randrange(k))]
    text = ["Bank of Here", "statement", "account", "monthly", "visa", "total"]
    files = [(i, rng.choice(["csv", "pdf"]), rng.choice(["here-2024.csv", "x.csv", "visa_card.pdf"]), some(words, 6), " ".join(some(text, 7)) or None) for i in range(60)]
    profiles = [(f"p{i}", rng.choice(["csv", "pdf"]), rng.choice(["Bank of Here", "", "Elsewhere"]), some(words, 3), some(words, 5), some([t.upper() for t in text], 4), some(text, 3), rng.choice(["", "here", "visa.*card"])) for i in range(50)]
    f = spark.createDataFrame(files, "file_id int, type string, name string, header array<string>, text string")
    p = spark.createDataFrame(profiles, "profile_id string, type string, bank string, required array<string>, header array<string>, keywords array<string>, anchors array<string>, filename string")
    got = {(r.file_id, r.profile_id): (r.confidence, r.layout_changed) for r in match.match_profiles(f, p).collect()}
    pairs = f.select("file_id", "type", F.struct("name", "header", "text").alias("f")).join(p.select("profile_id", "type", F.struct("bank", "required", "header", "keywords", "anchors", "filename").alias("p")), "type")
    every = pairs.select("file_id", "profile_id", match.signature_score("p", "f").alias("s"), match.sources_present(F.col("p.required"), F.col("f.header")).alias("here"), F.coalesce(match.bank_present(F.col("p.bank"), F.col("f.text"), F.col("f.name")), F.lit(False)).alias("bank"), (F.size("p.header") > 0).alias("h")).collect()
    want = {}
    for r in every:
        s = r.s or 0.0
        confidence, changed = (s, r.h and r.bank and s < match.THRESHOLD) if r.here else (min(s, match.CAPPED), s >= match.THRESHOLD or r.bank)
        if confidence >= match.THRESHOLD or changed:
            want[r.file_id, r.profile_id] = confidence, changed
    assert 30 < len(want) < len(every) and {k: (v[0] or 0.0, v[1]) for k, v in got.items()} == want


def test_seed_mapping_sorts_no_joined_sides(spark):
    """Repeated headers and suggestions, nulls, and files that one side alone has; rows of a file meet once, in parts of their own."""
    from tallyforge.operators import infer

    saved = spark.createDataFrame([("date", "Date"), ("amount", " SUM "), ("total", "sum")], "field string, header string")
    columns = spark.createDataFrame([(1, 3, "date"), (1, None, "DATE"), (1, 2, " Date "), (1, 5, "sum"), (2, 0, None), (3, 0, "date"), (4, None, "date"), (None, 7, "Date")], "file_id int, column int, header string")
    suggested = spark.createDataFrame([(1, "date", 9), (1, "note", 2), (1, "note", 3), (1, "note", 3), (1, None, 5), (1, None, None), (2, "date", 0), (4, "note", None), (5, "date", 1), (None, "date", 1), (None, "note", 7)], "file_id int, field string, column int")
    out = infer.seed_mapping(saved, columns, suggested)
    want = [(1, "date", 2), (1, "amount", 5), (1, "total", 5), (1, "note", 3), (1, "note", 3), (1, None, None), (2, "date", 0), (3, "date", 0), (4, "date", None), (4, "note", None), (5, "date", 1), (None, "date", 7), (None, "date", 1), (None, "note", 7)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan
