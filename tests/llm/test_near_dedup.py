import random

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from ledgerloom.llm import near_dedup
from ledgerloom.llm.components import components

from .conftest import sentence


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(rows, percent=75):
    """{row number: (set size, component)} by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            every = len(sets[i]) + len(sets[j]) - common
            if every and 100 * common >= percent * every and None not in (rows[i][0], rows[j][0]):
                parent[root(i)] = root(j)
    lowest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            lowest[root(i)] = min(key, lowest.get(root(i), key))
    return [(k, len(sets[i]), lowest.get(root(i))) for i, (k, _) in enumerate(rows)]


def result(df):
    return sorted(((r[0], r[1], r[2]) for r in df.collect()), key=str)


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    found = near_dedup.near_duplicates(awkward)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(found) == sorted(brute(rows), key=str)
    for r in found.collect():
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_empty_table(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 512])
def test_large_groups_and_borderline_pairs(spark, leaf):
    """Groups beyond the leaf size go down and, at the last depth, through blocks."""
    rng = random.Random(leaf)
    rows = []
    for group in range(12):
        words = sentence(rng, 60, 10_000).split()
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_dedup.near_duplicates(docs, leaf=leaf, depth=4)) == sorted(brute(rows), key=str)


def test_large_nodes_branch_once(spark, monkeypatch):
    """Members that branch on are not made again for the join with their nodes."""

    class Listed(AccumulatorParam):
        def zero(self, value):
            return []

        def addInPlace(self, one, two):
            return one + two

    made = spark.sparkContext.accumulator([], Listed())
    children = near_dedup._children

    def noted(similarity, roots):
        run = children(similarity, roots)

        def branches(batches):
            for batch in run(batches):
                if roots is None:
                    made.add(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
                yield batch

        return branches

    monkeypatch.setattr(near_dedup, "_children", noted)
    rng = random.Random(8)
    line = sentence(rng, 60, 10_000)
    rows = [(i, f"{line} {sentence(rng, 40, 10_000)}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_dedup.near_duplicates(docs, leaf=1, depth=2)) == sorted(brute(rows), key=str)
    assert made.value and len(made.value) == len(set(made.value))


def test_sketch_agreement():
    """The share of equal minwise tokens estimates the similarity."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    left, right = near_dedup.minwise(pool[:2400]), near_dedup.minwise(pool[600:])
    assert abs((left == right).mean() - 0.6) < 0.2


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, k) for k in range(101, 160)]
    edges = spark.createDataFrame(chain + hub + [(200, 201), (200, 200)], "a long, b long")
    found = {r[0]: r[1] for r in components(edges).collect()}
    assert all(found[k] == 0 for k in range(41))
    assert all(found[k] == 100 for k in range(100, 160))
    assert found[201] == found[200] == 200
    assert components(edges.filter(F.lit(False))).count() == 0
