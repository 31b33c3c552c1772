"""Operators on documents against brute force on odd rows and on whole small tables."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import pytest

from tallyforge.llm.graph import components
from tallyforge.llm.license import BLOCK, PHRASES, STEP, TEMPLATES, scan_licenses
from tallyforge.llm.lines import dedup_lines
from tallyforge.llm.minhash import near_duplicates
from tallyforge.llm.mixing import Flow, capped_targets, mix_sources, plan
from tallyforge.llm.quality import Rules, clean_lines, fault
from tallyforge.llm.substring import dedup_substrings, difference_cover

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = " ".join(f"w{i}" for i in range(70))
ROWS = [
    (1, "", "a"), (2, None, None), (3, "one", "a"), (4, "one", "b"), (5, "ONE", "c"), (6, RUN, "a"), (7, f"before {RUN} after", "b"), (8, f"{RUN}\n{RUN}", None),
    (9, RUN.replace("w30", "x"), "a"), (9, RUN + " again", "z"), (None, RUN, "a"), (None, None, None), (10, "x " * 3000, "hot"), (11, "\n\n \n", "hot"),
    (12, "Home | About | Contact | News\nA full sentence that has a few words in it, and then ends.\nAll rights reserved.", "b"),
    (13, "released under the MIT license\nLicensed under CC BY-NC 4.0 cc by, CC-BY all rights reserved", "c"), (13, "released under the MIT license\nLicensed under CC BY-NC 4.0 cc by, CC-BY all rights reserved", "c"),
    (14, " wide space \x1c stays\x85in words", "d"), (15, "ПРИВЕТ МИР Über ÉTÉ", "d"), (16, "y" * 100_000, "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, f"k{i}", i) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row_key string, size int").repartition(5)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- components ------------------------------------------------------------


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7), (900, 3), (900, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 580)} | {3: 3, 4: 3, 900: 3}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near duplicates -------------------------------------------------------


def _components(rows, percent):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sets, [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, odd, small, percent):
    for docs in (odd, small):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        sets, comp = _components(rows, percent)
        want = sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, comp, strict=True)), key=repr)
        assert plain(near_duplicates(docs, percent).select("doc_id", "n_shingles", "component_id")) == want


def test_chain_of_near_copies_is_one_component(spark):
    words = [f"u{i}" for i in range(300)]
    rows = []
    for i in range(40):
        words = list(words)
        words[(7 * i) % 300] = f"new{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows + [(100 + i, rows[3][1]) for i in range(300)], "doc_id long, text string")
    got = near_duplicates(docs)
    assert {r.component_id for r in got.collect()} == {0} and [r.doc_id for r in got.filter("kept").collect()] == [0]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_large_groups_are_compared_in_cells(spark, monkeypatch):
    import tallyforge.llm.minhash as m

    monkeypatch.setattr(m, "CELL_BYTES", 5 * 4096)
    test_chain_of_near_copies_is_one_component(spark)


# --- quality ---------------------------------------------------------------


def _base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality_base(spark, odd, small):
    for docs in (odd, small):
        want = sorted([(r.doc_id, *_base(r.text)) for r in docs.collect()], key=repr)
        assert plain(clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
    assert clean_lines(odd.limit(0)).count() == 0


def test_quality_lines(spark):
    good = "The tall tree by the river lost all of its leaves in one night of wind, and nobody saw it happen."
    more = "Some years later a painter came along that road with two dogs, looked at the bare branches for a while and sat down."
    rows = [
        (1, f"Home | About | News | Contact\n{good}\n{more}", True, ["navigation"]),
        (2, f"{good}\nSo it was.\nSubscribe to our letter today.\n{more}\nSo it was.", True, ["boilerplate", "duplicate"]),
        (3, "Home | About | News | Contact | Shop | Help | Login | More | Top | Up | Maps | Jobs | Legal | Press\n" + good, False, ["navigation"]),
        (4, f"{good}\nshort heading\n\n{more}", True, ["punctuation"]),
    ]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")).collect()}
    for i, _, kept, broken in rows:
        assert (got[i].kept, sorted(got[i].rules_broken)) == (kept, broken), i
    assert "Home" not in got[1].clean_text and got[4].clean_text.count("\n") == 2
    assert fault("go go go go stop stop stop stop on on on on.", Rules()) == "repetition"
    assert fault(good, Rules()) is None


def test_quality_commonest_word_at_any_place(spark):
    rules, lines = Rules(), []
    for n in range(20, 201):
        for often in (n // 2 - 1, (n + 1) // 2):
            words = [f"x{i}" for i in range(n)]
            words[1 : 2 * often : 2] = ["buy"] * len(words[1 : 2 * often : 2])
            words[-1] = "buy" if words.count("buy") < often else words[-1]
            lines.append(" ".join(words) + " .")
    for line in lines:
        words = line.split()
        want = "repetition" if max(words.count(w) for w in words) >= rules.same_word_share * len(words) else None
        assert fault(line, rules) == want, line
    assert {fault(x, rules) for x in lines} == {"repetition", None}
    spam = " ".join(f"x{i} buy" for i in range(1, 13))
    (got,) = clean_lines(spark.createDataFrame([(1, spam + "\n" + spam + " buy")], "doc_id long, text string")).collect()
    assert got.n_lines_removed == 2 and not got.kept and got.rules_broken == ["repetition"] and got.clean_text == ""


def _verdict(text, rules):
    """The line rules written out plainly."""
    text = text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    kept, seen, broken, lost = [], [], set(), 0
    for line in text.split("\n"):
        if not WORD.search(line):
            kept.append(line)
            continue
        words = line.split()
        count = lambda chars, line=line: sum(ch in chars for ch in line)
        tests = [
            ("duplicate", line in seen),
            ("navigation", count(rules.separators) >= 2 and count(rules.separators) >= rules.separator_share * len(words)),
            ("symbols", count("#*$%&|<>") >= 3 and count("#*$%&|<>") >= rules.symbol_share * len(words)),
            ("repetition", len(words) >= 10 and (max(map(words.count, words)) >= rules.same_word_share * len(words) or sum(a == b for a, b in zip(words, words[1:], strict=False)) >= rules.stutter_share * len(words))),
            ("boilerplate", len(words) <= rules.boilerplate_words and any(x in line.lower() for x in rules.boilerplate)),
            ("punctuation", len(words) < rules.unpunctuated_words and line.rstrip()[-1:] not in set(rules.ends)),
        ]
        seen.append(line)
        why = next((name for name, hit in tests if hit), None)
        if why:
            broken.add(why)
            lost += sum(ch not in " \t\n\r\x0b\x0c" for ch in line)
        else:
            kept.append(line)
    chars = sum(map(len, WORD.findall(text)))
    return not _base(text)[-1] and lost <= rules.lost_share * chars, len(lines), lost, sorted(broken), "\n".join(kept)


def test_quality_verdicts_by_brute_force(spark, odd, small):
    rules = Rules()
    for docs in (odd, small):
        want = sorted([(r.doc_id, *_verdict(r.text, rules)) for r in docs.collect()], key=repr)
        got = clean_lines(docs).collect()
        assert sorted([(r.doc_id, r.kept, r.n_lines, r.chars_removed, sorted(r.rules_broken), r.clean_text) for r in got], key=repr) == want
    assert {x for *_, broken, _ in want for x in broken} >= {"duplicate", "punctuation"}


@pytest.mark.parametrize("line", ["Alle Rechte vorbehalten.", "Lire la suite de cet article.", "Política de privacidad de este sitio.", "All Rights Reserved."])
def test_quality_boilerplate_in_four_languages(line):
    assert fault(line, Rules()) == "boilerplate"


# --- substrings ------------------------------------------------------------


def _substrings(rows, window):
    first = {}
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    ids = [1 << 62 if r[0] is None else r[0] for r in rows]
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            first[run] = min(first.get(run, i), i)
    out = []
    for r, i, w in zip(rows, ids, words, strict=True):
        gone = {k + x for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for x in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "period"), [(50, 31), (50, 7), (20, 11), (8, 3)])
def test_substrings(spark, odd, small, window, period):
    for docs in (odd, small):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert plain(dedup_substrings(docs, window, period)) == _substrings(rows, window)


def test_substrings_shifted_and_edited(spark):
    import random

    rng = random.Random(3)
    base = [f"t{rng.randrange(400)}" for _ in range(900)]
    rows = []
    for i in range(60):
        a, n = rng.randrange(800), rng.randrange(40, 120)
        w = [f"p{rng.randrange(90)}" for _ in range(rng.randrange(60))] + base[a : a + n] + base[rng.randrange(800) :][:70]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[20][1]), (101, rows[20][1] + " end"), (5, rows[30][1]), (5, rows[30][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(dedup_substrings(docs)) == _substrings(rows, 50)
    assert dedup_substrings(docs.limit(0)).count() == 0


def test_difference_covers():
    for period in range(2, 60):
        cover = difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# --- mixing ----------------------------------------------------------------


def test_targets():
    assert capped_targets([100, 100, 100], [1, 2, 3], 3) == [50.0, 100.0, 150.0]
    got = capped_targets([10, 100, 1000], [1, 2, 3], 3)
    assert got[0] == 30.0 and got[1] == 300.0 and got[2] == pytest.approx(780.0)
    assert capped_targets([0, 0], [1, 2], 3) == [0.0, 0.0]


def test_flow_prefers_first_uses():
    # Two patterns, one of them in both sources; repetition is only used where the quotas need it.
    got = plan({("a",): 100, ("a", "b"): 100}, (1, 5), 3)
    assert got.taken[("a", "b")] >= got.routed["b"] and sum(got.taken.values()) == sum(got.routed.values())
    assert got.taken[("a", "b")] <= 300
    net = Flow()
    cheap, dear = net.arc(0, 1, 5, 0.0), net.arc(0, 1, 5, 1.0)
    net.arc(1, 2, 7)
    net.run(0, 2)
    assert (net.room[cheap ^ 1], net.room[dear ^ 1]) == (5, 2)


def test_mixing(spark, odd, small):
    for docs, near in ((small, True), (odd, False)):
        rows = [(r.doc_id, len(WORD.findall(r.text or "")), r.source) for r in docs.collect()]
        sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
        sizes = [sum(n for _, n, x in rows if x == s) for s in sources]
        targets = dict(zip(sources, capped_targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(sources))], 3), strict=True))
        got = plain(mix_sources(docs).drop("row_key"))
        again = plain(mix_sources(docs.repartition(3)).drop("row_key"))
        assert got == again
        assert Counter((i, n, dict(zip(sources, sizes, strict=True))[s], round(targets[s], 6)) for i, n, s in rows) == Counter((i, n, t, round(x, 6)) for i, n, t, x, _ in got)
        assert all(t % n == 0 and t <= 3 * n if n else t == 0 for _, n, _, _, t in got)
        if near:
            by = {r.doc_id: r.source for r in docs.collect()}
            taken = Counter()
            for i, _, _, _, t in got:
                taken[by[i]] += t
            for s in sources:
                # The prefix of the seeded order is short of the next document; the nearest one leaves half of that at most.
                assert abs(taken[s] - targets[s]) <= max(n for _, n, x in rows if x == s) / 2 + 1
    assert mix_sources(odd.limit(0)).count() == 0


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 2 else ["a", "b", "b"]) for i in range(200)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(1, 4))
    taken = {r.doc_id: r.taken for r in got.collect()}
    assert sum(taken.values()) == 2000 and all(t <= 30 for t in taken.values())
    assert sum(t for i, t in taken.items() if i % 2 == 0) == 1600
    with pytest.raises(ValueError, match="patterns"):
        mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), most_patterns=1)


def test_mixing_takes_equal_rows_one_by_one(spark):
    docs = spark.createDataFrame([(1, "w " * 10, "a")] * 60 + [(2, "w " * 1000, "b")], "doc_id long, text string, source string")
    for weights in ((1, 2, 3), (1, 1.6)):
        taken = Counter()
        for r in mix_sources(docs, weights=weights).collect():
            taken[r.doc_id, r.target] += r.taken
        assert all(i == 2 or 0 <= target - n < 10 for (i, target), n in taken.items())


# --- licenses --------------------------------------------------------------


def _licenses(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = cut.findall(low)
    places = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = {x for _, x in places}
    more, score = set(), 0.0
    for at in range(0, max(len(words) - BLOCK, 0) + STEP, STEP):
        have = set(words[at : at + BLOCK])
        hits = {}
        for label, keys, t in TEMPLATES:
            own = frozenset(t.split())
            if len(have & own) / len(own) >= 0.8 - 1e-9 and have.issuperset(keys.split()):
                hits[own] = label
        for own, label in hits.items():
            if not any(own < other and label != hits[other] for other in hits):
                more.add(label)
                score = max(score, len(have & own) / len(own))
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


def test_licenses(spark, odd, small):
    extra = spark.createDataFrame([(50 + i, t.upper() + " and some more", "x") for i, (_, _, t) in enumerate(TEMPLATES)] + [(90, "cc b\u212a \u212a cc by all r\u0130ghts reserved", None)], "doc_id long, text string, source string")
    for docs in (odd.select("doc_id", "text", "source").union(extra), small):
        want = sorted([(r.doc_id, *_licenses(r.text)) for r in docs.collect()], key=repr)
        assert plain(scan_licenses(docs)) == want
    assert scan_licenses(odd.limit(0)).count() == 0


def test_each_license_gets_its_own_label(spark):
    before, after = "word " * 30, " word" * 30
    rows = [(i, before + t + after) for i, (_, _, t) in enumerate(TEMPLATES)]
    rows += [(100 + i, (before + t + after).replace(" ", "\n")) for i, (_, _, t) in enumerate(TEMPLATES)]  # wrapped hard
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(TEMPLATES):
        labels, base, score = got[i]
        assert set(labels.split(",")) == {label} | set(filter(None, base.split(","))) and score == 1.0
        assert got[100 + i] == got[i]
    near = [(1, "released under the x license"), (2, "licensed under the gnu general public license version 3"), (3, "Licensed under CC BY-NC 4.0.")]
    assert {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(near, "doc_id long, text string")).collect()} == {1: "", 2: "gpl", 3: "cc-by,cc-by-nc"}


# --- lines -----------------------------------------------------------------


def _lines(rows, least):
    sites, where = defaultdict(set), defaultdict(list)
    cut = [(t or "").split("\n") for _, t, _ in rows]
    for r, lines in zip(rows, cut, strict=True):
        for k, x in enumerate(lines):
            if x := x.strip(" \t\r"):
                sites[x].add(r[2])
                where[x].append((r[0] is not None, r[0] or 0, k))
    out = []
    for r, lines in zip(rows, cut, strict=True):
        gone = [bool(s := x.strip(" \t\r")) and len(sites[s]) >= least and (r[0] is not None, r[0] or 0, k) != min(where[s]) for k, x in enumerate(lines)]
        text = r[1] if not any(gone) else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((r[0], text, sum(bool(x.strip(" \t\r")) for x in lines), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 10])
def test_lines(spark, small, least):
    odd = [(1, "same\n same \nother", "a"), (2, "same", "b"), (3, None, None), (4, "same\r\n\nx", None), (5, "", "a"), (6, "same\nmine", "c"), (6, "same\nmine", "c"), (None, "last\nsame", "d")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(odd)], "doc_id long, text string, source string, site int")
    for rows, df in (([tuple(r) for r in small.collect()], small), (odd[:-3] + odd[-1:], docs.filter("site not in (5, 6)"))):
        got = dedup_lines(df, least).select("doc_id", "text", "lines_total", "lines_removed")
        if rows[-1][0] is None:  # the null id comes before all others
            assert sum(r.lines_removed for r in got.collect()) == sum(r[3] for r in _lines([(0 if i is None else i, *x) for i, *x in rows], least))
        else:
            assert plain(got) == _lines(rows, least)
    twice = dedup_lines(docs, 2).filter("doc_id = 6").collect()
    assert len(twice) == 2 and twice[0].text == twice[1].text
    assert dedup_lines(docs.limit(0)).count() == 0 and dedup_lines(docs).columns == [*docs.columns, "lines_total", "lines_removed"]


def test_lines_near_the_threshold(spark):
    rows = [(i, f"line {k}", f"site{i % 400}") for k, n in enumerate((99, 100, 101, 300, 3)) for i in range(n)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 100, lg_k=8, near=0.4)
    left = Counter(r.text for r in got.collect() if r.text)
    assert left == {"line 0": 99, "line 1": 1, "line 2": 1, "line 3": 1, "line 4": 3}


def test_templates_of_any_length_are_found_verbatim(spark):
    """A notice as long as the longest template lies inside some block, wherever it begins."""
    from tallyforge.llm.license import block_size

    long = " ".join(f"clause{i}" for i in range(150))
    templates = (("long", "clause0 clause149", long), ("short", "tiny", "under the tiny license"))
    block, step = block_size(templates)
    assert (block, step) == (300, 150) and block_size(TEMPLATES) == (BLOCK, STEP)
    texts = [("pad " * at) + long + " end" * 7 for at in (0, 1, 149, 150, 151, 299, 1000)] + ["x " * 40 + "under the tiny license", " ".join(long.split()[:100])]
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates, phrases=PHRASES).collect()}
    assert all(got[i] == ("long", 1.0) for i in range(7)) and got[7] == ("short", 1.0) and got[8] == ("", 0.0)


def test_a_passage_in_very_many_documents(spark):
    """Every window of a passage that all documents hold goes, but for the first document's; ids may be missing."""
    passage = " ".join(f"w{i}" for i in range(70))
    docs = [(i if i % 10 else None, f"a{i} " * (i % 7) + passage + f" z{i}" * 3) for i in range(1, 400)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    want = sorted((i is None, i or 0, len(t.split()), 0 if i == 1 else 70) for i, t in docs)
    assert got == want


def test_flow_against_every_routing():
    """On tiny instances: as many words as any routing fits into the quotas, and none with less repetition among those."""
    import random

    rng = random.Random(11)
    for _ in range(40):
        names = ["a", "b", "c"][: rng.randrange(1, 4)]
        patterns = {}
        for _ in range(rng.randrange(1, 4)):
            patterns[tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1))))] = rng.randrange(1, 4)
        got = plan(patterns, (1, 2, 3), 2)
        quota = {s: round(q) for s, q in got.target.items()}
        cost = lambda p, t: max(0, t - patterns[p])  # noqa: E731  a second use costs 1 a word
        best = None
        ways = [[(p, split) for split in itertools.product(range(2 * n + 1), repeat=len(p)) if sum(split) <= 2 * n] for p, n in patterns.items()]
        for routing in itertools.product(*ways):
            into = Counter()
            for p, split in routing:
                into.update(dict(zip(p, split, strict=True)))
            if all(into[s] <= quota[s] for s in quota):
                key = -sum(into.values()), sum(cost(p, sum(split)) for p, split in routing)
                best = key if best is None or key < best else best
        assert (-sum(got.taken.values()), sum(cost(p, t) for p, t in got.taken.items())) == best
        assert all(got.routed[s] <= quota[s] for s in quota) and sum(got.routed.values()) == sum(got.taken.values())
