"""Versions as a column against the plan for one version, and trying candidates."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.amounts import EU, US, is_amount, parse_amount
from tallyforge.functions.dates import INPUT_FORMATS, is_date, parse_date
from tallyforge.operators import grid, infer, normalise, versions
from tallyforge.operators.grid import Rule, Window
from tallyforge.operators.normalise import Transform, Version

GRID = [
    ["Bank of somewhere"], [" Date ", "What", "Amount", "What"], ["", " ", ""], ["01/02/2026", "Coffee", "(4.50)", "a-b"], ["Carried forward", "", "9.00"], ["02/02/2026", "Salary", "1,000.00 CR", "c"],
    ["not a day", "Odd", "7"], ["neither", "nor", "none"], ["03/02/2026", "Tea", "500", "d", "beyond"], ["total", "", "12.00"], ["04/02/2026", "After", "1.00", "e"],
]
WINDOWS = [
    Window(), Window(1), Window(1, footers=(Rule("startsWith", "TOTAL"),)), Window(1, footers=(Rule("regex", r"^tot\w+"),), ignored=(Rule("contains", "carried"),)), Window(1, first_row=4, last_row=6),
    Window(1, skip_before=5), Window(1, excluded=(1, 3)), Window(1, excluded=(3,), ignored=(Rule("other", "x"),)), Window(40), Window(1, last_row=99),
]


def test_windows_as_a_column(spark):
    """One plan for all windows gives what a plan for each gives."""
    saved = versions.saved_versions(spark, [{"profile_id": str(i), "config": versions.config_of(w, Version({}))} for i, w in enumerate(WINDOWS)])
    files = spark.createDataFrame([("f", GRID), ("empty", []), ("null", None)], "file_id string, grid array<array<string>>")
    got = versions.records_by_version(files.join(F.broadcast(saved)), "file_id", "profile_id").collect()
    for i, w in enumerate(WINDOWS):
        want = {(r.file_id, r.row): r.record for r in grid.apply_window(files.filter("grid IS NOT NULL"), w).collect()}
        assert {(r.file_id, r.row): r.record for r in got if r.profile_id == str(i)} == want


def test_rows_by_version_against_one_version(spark):
    sources = {"date": ["Date"], "description_raw": ["What"], "amount": ["Amount"]}
    made = [
        Version(sources, "DD/MM/YYYY", "1,234.56", "signed", "SGD"), Version(sources, "MM/DD/YYYY", None, "positiveIsOut", "JPY"),
        Version({**sources, "currency": ["What"]}, "DD/MM/YYYY", currency="USD", transforms=(Transform("description_raw", "upper"), Transform("description_raw", "replace", "[-B]", "+", True), Transform("amount", "trim"))),
        Version({"date": ["Date"], "debit": ["Amount"], "credit": ["None"], "balance": ["Amount"]}, "DD/MM/YYYY", currency="SGD", transforms=(Transform("description_raw", "fixed", value="same"),)),
        Version({}, "no such format"),
    ]
    window = Window(1, footers=(Rule("startsWith", "total"),), ignored=(Rule("contains", "carried"),))
    saved = versions.saved_versions(spark, [{"profile_id": str(i), "config": versions.config_of(window, v)} for i, v in enumerate(made)])
    files = spark.createDataFrame([("f", GRID)], "file_id string, grid array<array<string>>")
    got = versions.file_rows(files.join(F.broadcast(saved)), "file_id", "profile_id").collect()
    for i, v in enumerate(made[:4]):
        want = normalise.file_rows(grid.apply_window(files, window), v).collect()
        mine = {r.row: r for r in got if r.profile_id == str(i)}
        assert len(mine) == len(want)
        for r in want:
            m = mine[r.row]
            assert (m.date, m.description_raw, m.amount, m.currency, m.balance) == (r.date, r.description_raw, r.amount, r.currency, r.balance)
            assert m.skipped == (r.date is None and r.amount is None)
            assert set(m.flags) == (set(r.flags) - {"unparseable_date", "missing_amount", "unknown_currency", "possible_duplicate", "balance_mismatch"} if m.skipped else set(r.flags) - {"balance_mismatch"})
    assert all(r.skipped and not r.flags for r in got if r.profile_id == "4")
    # An amount has the digits of its own row's currency.
    yen = spark.createDataFrame([("f", [["Date", "What", "Amount"], ["03/02/2026", "Tea", "JPY 500"], ["04/02/2026", "Tea", "500"]])], "file_id string, grid array<array<string>>")
    one = versions.saved_versions(spark, [{"profile_id": "0", "config": versions.config_of(Window(), made[0])}])
    assert {(r.amount, r.currency) for r in versions.file_rows(yen.join(F.broadcast(one)), "file_id").collect()} == {(500, "JPY"), (50000, "SGD")}


def test_candidates_are_tried(spark):
    good = versions.config_of(Window(0), Version({"date": ["Date"], "amount": ["Amount"]}, "DD/MM/YYYY", currency="SGD"))
    none = {**good, "first_row": 50}
    wrong = {**good, "date_format": "YYYY-MM-DD"}
    broken = versions.config_of(Window(0, footers=(Rule("regex", "(("),)), Version({"date": ["Date"], "amount": ["Amount"]}, "DD/MM/YYYY"))
    assert broken["broken"] and not good["broken"]
    grid_ = [["Date", "Amount"], ["13/02/2026", "5.00"], ["14/02/2026", "6.00"]]
    rows = [
        ("near", "w", 0.95, 1, wrong), ("near", "g", 0.90, 2, good), ("far", "w", 0.95, 1, wrong), ("far", "b", 0.9, 2, broken), ("far", "g", 0.7, 3, good), ("lost", "w", 0.95, 1, wrong), ("lost", "n", 0.7, 2, none),
        ("scan", "w", 0.95, 1, wrong), ("scan", "n", 0.7, 2, none), ("seen", "n", 0.95, 1, none), ("seen", "w", 0.7, 2, wrong), ("blank", "g", 0.9, 1, good),
    ]
    saved = versions.saved_versions(spark, [{"profile_id": f"{f}-{p}", "created": "2024", "config": c} for f, p, _, _, c in rows])
    told = spark.createDataFrame([(f, f"{f}-{p}", c, r) for f, p, c, r, _ in rows], "file_id string, profile_id string, confidence double, rank int")
    files = spark.createDataFrame([(f, "csv", f in ("scan", "seen"), None if f == "blank" else grid_) for f in ("near", "far", "lost", "scan", "seen", "blank", "alone")], "file_id string, type string, ocr boolean, grid array<array<string>>")
    got = {r.file_id: (r.profile_id.split("-")[1], r.fell_back, r.state) for r in versions.apply_matches(files, told.join(saved, "profile_id")).collect()}
    assert got == {"near": ("g", False, "applied"), "far": ("g", True, "applied"), "lost": ("n", True, "matchFailed"), "scan": ("n", True, "ocrFailed"), "seen": ("w", True, "matchFailed"), "blank": ("g", False, "matchFailed")}
    chosen = spark.createDataFrame([("near", "near-g"), ("far", "far-w"), ("seen", "seen-n"), ("blank", "blank-g")], "file_id string, profile_id string")
    assert {r.file_id: r.outcome for r in versions.use_chosen(files, chosen, saved).collect()} == {"near": "learn", "far": "layoutChanged", "seen": "layoutChanged", "blank": "layoutChanged"}


@pytest.mark.parametrize(
    "rows,best",
    [
        ([("a", 0.95, 0.80, "2020", False), ("b", 0.94, 0.81, "2019", False)], "b"),  # better by less than the margin
        ([("a", 0.95, 0.80, "2020", True), ("b", 0.94, 0.79, "2019", False)], "b"),  # people's own before built-in
        ([("a", 0.95, 0.80, "2020", False), ("b", 0.94, 0.79, "2021", True)], "a"),  # never built-in for being newer
        ([("a", 0.95, 0.80, "2020", False), ("b", 0.94, 0.79, "2021", False)], "b"),  # the newer of near ties
        ([("a", 0.95, 0.80, "2020", False), ("b", 0.94, 0.77, "2021", False)], "a"),
        ([("a", 0.95, 0.10, "2020", False), ("b", 0.84, 0.90, "2021", False)], "a"),  # beyond the margin of confidence
        ([("a", 0.95, 0.1, "1", False), ("b", 0.95, 0.2, "1", False), ("c", 0.95, 0.3, "1", False), ("d", 0.95, 0.4, "1", False), ("e", 0.95, 0.9, "1", False)], "d"),  # four at most
        ([("a", 0.95, 0.8, None, False), ("b", 0.95, 0.8, "1", False)], "b"),
    ],
)
def test_pick_among_near_ties(spark, rows, best):
    df = spark.createDataFrame([("f", *r) for r in rows], "file_id string, profile_id string, confidence double, quality double, created string, built_in boolean")
    assert infer.pick_candidate(df).first().profile_id == best


def test_candidates_are_counted_where_they_are_read(spark):
    """Trying asks for dates and amounts alone: no flag that needs a file's rows side by side is worked out for it."""
    config = versions.config_of(Window(0), Version({"date": ["Date"], "amount": ["Amount"]}, "DD/MM/YYYY", currency="SGD"))
    saved = versions.saved_versions(spark, [{"profile_id": "p", "config": config}])
    rows = [["Date", "Amount"], ["13/02/2026", "5.00"], ["13/02/2026", "5.00"], ["x", "6.00"], ["14/02/2026", ""], ["x", "y"], ["Total", "9.00"]]
    files = spark.createDataFrame([("f", "csv", rows), ("g", "pdf", rows[:3])], "file_id string, type string, grid array<array<string>>")
    told = files.select("file_id").crossJoin(saved)
    keys = ("file_id", "type", "profile_id", "version_id")
    flagged = versions.file_rows(files.join(told, "file_id"), *keys)
    has = lambda f: F.count_if(~F.col("skipped") & F.array_contains("flags", f))
    want = {r.file_id: (r.n, r.m, r.u) for r in flagged.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), has("missing_amount").alias("m"), has("unparseable_date").alias("u")).collect()}
    got = {r.file_id: (r.n, r.missing, r.unparseable) for r in versions.extraction(versions.cells_by_version(versions.records_by_version(files.join(told, "file_id"), *keys), *keys), "file_id").collect()}
    assert got == want == {"f": (6, 1, 1), "g": (2, 0, 0)}
    assert "Window" not in versions.try_candidates(files, told)._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_read_once_for_all_their_candidates(spark):
    """One plan holds the files once, whatever becomes of the picked candidate, and asks for no window."""
    config = versions.config_of(Window(0), Version({"date": ["Date"], "amount": ["Amount"]}, "DD/MM/YYYY"))
    saved = versions.saved_versions(spark, [{"profile_id": "p", "config": config}])
    files = spark.createDataFrame([("f", "csv", [["Date", "Amount"]])], "file_id string, type string, grid array<array<string>>").withColumn("grid", F.reverse(F.reverse("grid")))
    told = spark.createDataFrame([("f", "p", 0.9, 1)], "file_id string, profile_id string, confidence double, rank int").join(saved, "profile_id")
    for made in (versions.try_candidates(files, told), versions.apply_matches(files, told)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("reverse(reverse(") == 1
        assert "Window" not in plan


def test_candidates_read_as_rows_do(spark):
    """Lines told from their shapes, each way of reading once, count as the rows of each version do."""
    sources = {"date": ["Date"], "description_raw": ["What"], "amount": ["Amount"]}
    made = [
        Version(sources, "DD/MM/YYYY", "1,234.56", "signed", "SGD"), Version(sources, "DD/MM/YYYY", "1,234.56", "positiveIsOut", "JPY"), Version(sources, "MM/DD/YYYY", None), Version({**sources, "date": ["Gone", "Date"]}, "DD/MM/YYYY"),
        Version({"date": ["Date"], "debit": ["Amount"], "credit": ["What"]}, "DD/MM/YYYY", "1.234,56"), Version({"date": ["Date"], "credit": ["What", "Amount"], "amount": ["Amount"]}, "MM/DD/YYYY"), Version({}, "no such format"), Version(sources, "DD MMM"),
    ]
    rows = [*GRID[:-2], ["31/04/2026", "Odd", "1"], ["29/02/2024", "Odd", "x"], ["", "", "5"], [None, "Balance", "5"], ["1/13/26", None, "S$ 5.00-"], ["05/02/2026"], *GRID[-2:]]
    configs = [versions.config_of(w, v) for w in (*WINDOWS, Window(1, footers=(Rule("regex", "(("),))) for v in made]
    saved = versions.saved_versions(spark, [{"profile_id": str(i), "config": c} for i, c in enumerate(configs)])
    files = spark.createDataFrame([("f", "csv", rows), ("empty", "csv", []), ("null", "csv", None)], "file_id string, type string, grid array<array<string>>")
    told = files.select("file_id").crossJoin(saved)
    keys = ("file_id", "profile_id")
    want = {(r.file_id, r.profile_id): r for r in versions.extraction(versions.cells_by_version(versions.records_by_version(files.join(told, "file_id"), *keys), *keys), *keys).collect()}
    led = 6  # lines that look like transactions
    for r in versions.try_candidates(files, told).collect():
        w = want.get((r.file_id, r.profile_id))
        rate = lambda x: x / w.kept if w.kept else 0.0
        assert (r.n_rows, r.kept, r.failed) == ((w.n, w.kept, w.unusable * 2 > w.n) if w else (0, 0, True))
        assert r.quality == pytest.approx(w.valid / led - 0.5 * rate(w.missing) - 0.5 * rate(w.unparseable) if w else 0.0, abs=1e-8)
    assert len(want) > 50 and len({(w.n, w.valid, w.missing, w.unparseable) for w in want.values()}) > 10


def test_dates_and_amounts_are_told_as_they_are_read(spark):
    dates = ["29/02/2024", "29/02/2023", "29-2-1900", "31.4.24", "00/01/2024", "12/13/2024", "1/2/0000", "2024-02-30", "2024/2/29", "1 Jan, 24", "31 june 2024", "3 anF 2024", "30 FEBRUARY 2024", "12 Jan", "1/2", "", " 01/02/2024\n", "x", None]
    told = spark.createDataFrame([(x,) for x in dates], "s string").select("s", *[F.struct(parse_date("s", f).isNotNull().alias("read"), is_date("s", f).alias("told")).alias(f"f{i}") for i, f in enumerate(INPUT_FORMATS)])
    assert all(x.read == x.told for r in told.collect() for x in r[1:])
    amounts = ["1,234.56", "1.234,56", "-5", "5-", "(5)", "S$5", "usd 5 DR", "1 234", "1,2d", "1e5,2", "1.2.3", ",5", "5.", "-", "x", "", "5 x", "٣", " 7\n", None]
    told = spark.createDataFrame([(x,) for x in amounts], "s string").select("s", *[F.struct(parse_amount("s", c, f).isNotNull().alias("read"), is_amount("s", f).alias("told")).alias(f"f{i}{c}") for i, f in enumerate((None, US, EU)) for c in (None, "JPY")])
    assert all(x.read == x.told for r in told.collect() for x in r[1:])
