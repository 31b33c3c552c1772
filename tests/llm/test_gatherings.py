"""Candidate pairs of one large gathering, against all pairs by brute force."""

from itertools import combinations

import numpy as np

from tallyforge.llm import gatherings


def test_common_gaps_make_few_comparisons(spark, monkeypatch):
    """Nodes that all lack some of the head's elements share these gaps with many others, and are linked with few."""
    rng = np.random.default_rng(5)
    head = np.arange(400)
    nodes = {0: head}
    for node in range(1, 160):
        gaps = rng.choice(160, 80, replace=False)
        nodes[node] = np.union1d(np.setdiff1d(head, gaps), np.arange(1000 + 100 * node, 1048 + 100 * node))
    nodes |= {160: np.append(nodes[1][:-20], 99_000), 161: np.append(nodes[2][10:], 99_001), 162: np.setdiff1d(head, [3]), 163: np.append(nodes[3][:-30], [99_002, 99_003])}
    nodes[164] = np.union1d(np.setdiff1d(head, np.arange(70)), [99_004])  # linked with the head
    nodes[165] = np.union1d(np.setdiff1d(head, np.arange(100)), [99_004, 99_005])  # with the one before alone
    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    label = {n: 0 if linked(x, head) else n for n, x in nodes.items()}
    rows = spark.createDataFrame([(0, n, label[n], 0) for n in nodes if n], "head long, node long, label long, head_label long")
    sets = spark.createDataFrame([(n, np.sort(x).astype(np.int64).tobytes()) for n, x in nodes.items()], "node long, shingles binary")
    compared, join = [], type(rows).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if "node_a" in self.columns and "node_b" in other.columns:
            compared.append(out.count())
        return out

    monkeypatch.setattr(type(rows), "join", counted)
    found = {(r.a, r.b) for r in gatherings._many(rows, sets, 80).collect()}
    asked = {(b, a) for a, b in combinations(sorted(nodes), 2) if a and label[a] != label[b] and linked(nodes[a], nodes[b])}
    assert {(160, 1), (161, 2), (163, 3), (165, 164)} <= asked <= found
    assert compared and max(compared) <= 60 * len(nodes)


def test_common_elements_make_no_rows(spark, monkeypatch):
    """Under a head that is far from all nodes, what they all lack or have is not joined node by node, and no link is lost."""
    rng = np.random.default_rng(7)
    base, new = np.arange(200), iter(range(10_000, 1_000_000))
    head = np.union1d(base[60:], np.arange(1000, 1060))
    nodes = {0: head}
    for node in range(1, 100):
        nodes[node] = np.union1d(rng.choice(base, rng.integers(120, 190), replace=False), [next(new) for _ in range(rng.integers(0, 60))])
    for node in range(100, 140):  # copies with edits, some of which are linked with the copied text
        old = nodes[node - 99]
        nodes[node] = np.union1d(rng.choice(old, len(old) - rng.integers(0, 20), replace=False), [next(new) for _ in range(rng.integers(0, 20))])
    for node in range(140, 160):  # the former half is linked with the head, the latter with the former alone
        nodes[node] = np.union1d(rng.choice(head, len(head) - 15, replace=False), [next(new) for _ in range(8)]) if node < 150 else rng.choice(nodes[node - 10], len(nodes[node - 10]) - 25, replace=False)
    sets = spark.createDataFrame([(n, np.sort(x).astype(np.int64).tobytes()) for n, x in nodes.items()], "node long, shingles binary")
    made, join = [], type(sets).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if {"node", "element"} <= set(self.columns) and "n" in other.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(sets), "join", counted)
    for percent in (80, 85):
        linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))  # noqa: B023, E731
        label = {n: 0 if linked(x, head) else n for n, x in nodes.items()}
        rows = spark.createDataFrame([(0, n, label[n], 0) for n in nodes if n], "head long, node long, label long, head_label long")
        found = {(r.a, r.b) for r in gatherings._many(rows, sets, percent).collect()}
        asked = {(b, a) for a, b in combinations(sorted(nodes), 2) if a and label[a] != label[b] and linked(nodes[a], nodes[b])}
        assert len(asked) > 20 and any(not label[a] or not label[b] for a, b in asked)
        assert asked <= found
    assert made and max(made) <= 20 * len(nodes)
