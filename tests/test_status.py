"""Exact medians of files that may hold any share of all rows."""

from tallyforge.operators import status


def test_low_confidence_without_a_files_rows_in_one_place(spark):
    big = 3 << 50
    given = {"a": [100, -200, 300, 40_000, None, 150], "b": [None, None], None: [7, 7, -9, 900], "c": [big, big + 1, -big - 2, big + (1 << 49), 5], "d": [-65_536, 65_535, 65_537, 131_072]}
    rows, want = [], {}
    for file, amounts in given.items():
        sizes = sorted(abs(a) for a in amounts if a is not None)
        for a in amounts:
            for confidence in (0.0, 30.0, 50.0, 70.0):
                i = len(rows)
                rows.append((i, file, a, confidence))
                bare = a is not None and a % 100 == 0
                odd = a is not None and (confidence < 40 or bare and sum(s % 100 != 0 for s in sizes) * 2 > len(sizes) or abs(a) > 100 * sizes[len(sizes) // 2])
                want[i] = (confidence < 60 and odd, a // 100 if confidence == 0 and bare else None)
    df = spark.createDataFrame(rows, "id int, file string, amount long, confidence double")
    out = status.low_confidence(df, "file")
    assert {r.id: (r.low_confidence, r.amount_alt) for r in out.collect()} == want
    assert {r.file: r.median for r in status.upper_medians(df.filter("amount IS NOT NULL"), "file", status.F.abs("amount")).collect()} == {f: sorted(abs(a) for a in x if a is not None)[sum(a is not None for a in x) // 2] for f, x in given.items() if f != "b"}
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()
