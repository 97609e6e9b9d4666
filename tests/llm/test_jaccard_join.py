import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import jaccard_join as jj
from ledgerloom.llm.common import words
from ledgerloom.llm.shingle_sets import shingle_sets

from .conftest import sentence


def plain_set(text, width=5):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def plain_join(rows, percent=80):
    """Brute force over rows (id, text): per row (n_shingles, component_id, n_links)."""
    sets = [plain_set(t) for _, t in rows]
    parent = {i: i for i, _ in rows}
    links = [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(
        ((i, len(s), None if i is None else root(i), n) for (i, _), s, n in zip(rows, sets, links, strict=True)),
        key=str,
    )


def joined(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jj.jaccard_join(docs, **options).collect()), key=str)


def variants(rng, n, edits, words_each=60, start=0):
    """Texts around a few bases, each with up to `edits` changed words."""
    bases = [sentence(rng, words_each, 5000).split() for _ in range(3)]
    rows = []
    for k in range(n):
        text = list(bases[k % 3])
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((start + k, " ".join(text)))
    return rows


def test_sets_of_a_batch():
    texts = ["a b c d e f", "A B c\td e f", None, "", " \n", "x", "one two", "One  two", "é ß a b c d", "q\x1cq r", "a " * 40]
    flat, sizes = next(shingle_sets(pa.array(texts), 5))
    assert sizes.tolist() == [len(plain_set(t)) for t in texts]
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    assert (parts[0] == parts[1]).all() and (parts[6] == parts[7]).all()
    assert all((np.diff(p.astype(object)) > 0).all() for p in parts if len(p) > 1)
    again = next(shingle_sets(pa.array(texts).slice(5, 3), 5))
    assert again[1].tolist() == [1, 1, 1] and (again[0] == np.concatenate(parts[5:8])).all()


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(2)
    for n in (3, 200, 700, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: int(n * 0.8)], rng.integers(0, 2**63, n // 3, dtype=np.uint64)])
        apart = len(np.setxor1d(a, b))
        x, y = jj._bitmap(a), jj._bitmap(b)
        while len(x) != len(y):
            x, y = (jj._folded(x), y) if len(x) > len(y) else (x, jj._folded(y))
        assert np.bitwise_count(x ^ y).sum() <= apart


def test_join_is_the_brute_force_one(spark):
    rng = random.Random(3)
    rows = variants(rng, 90, 6) + [(900 + k, sentence(rng, 40, 300)) for k in range(20)]
    shared = sentence(rng, 30, 900)
    rows += [(1000 + k, f"{sentence(rng, 20)} {shared}") for k in range(30)]
    assert joined(spark, rows) == plain_join(rows)


def test_cut_groups_give_the_same(spark, monkeypatch):
    """Blocks of a few sets: all tiles of bands and blocks are needed, and every link counts once."""
    monkeypatch.setattr(jj, "BLOCK", 5)
    monkeypatch.setattr(jj, "FREQUENT", 3)
    rng = random.Random(4)
    rows = variants(rng, 70, 3) + variants(rng, 20, 9, 30, 500)
    base = sentence(rng, 100, 9000).split()  # a chain of growing texts crosses bands
    rows += [(700 + k, " ".join(base[: 30 + 4 * k])) for k in range(15)]
    assert joined(spark, rows) == plain_join(rows)


def test_thresholds_are_exact(spark):
    base = [f"w{k}" for k in range(94)]  # 90 shingles
    at = " ".join(base[:-18])  # 72 of 90: exactly 80 %
    below = " ".join(base[:-19])  # 71 of 90
    rows = [(1, " ".join(base)), (2, at), (3, below)]
    got = {r[0]: r for r in joined(spark, rows)}
    assert got[2][2] == 1 and got[1][3] == 1
    assert joined(spark, rows) == plain_join(rows)
    assert joined(spark, rows, percent=75) == plain_join(rows, 75)


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in jj.jaccard_join(awkward).collect()), key=str)
    assert got == plain_join(rows)
    assert jj.jaccard_join(nothing).collect() == []


def test_ids_with_several_texts(spark):
    rng = random.Random(6)
    a, b, c = (sentence(rng, 50, 5000) for _ in range(3))
    rows = [(5, a), (7, a), (7, b), (9, b), (9, c), (3, c), (4, sentence(rng, 50)), (7, b)]
    got = joined(spark, rows)
    assert {r[2] for r in got if r[0] != 4} == {3}
    assert got == plain_join(rows)
    counts = defaultdict(int)
    for r in got:
        counts[r[0]] += 1
    assert counts[7] == 3


@pytest.mark.parametrize("width", [1, 3])
def test_other_widths(spark, width):
    rows = [(1, "a b c d"), (2, "A b c d"), (3, "d c b a"), (4, "z")]
    got = {r[0]: r[2] for r in joined(spark, rows, width=width)}
    assert got == {1: 1, 2: 1, 3: 1 if width == 1 else 3, 4: 4}
