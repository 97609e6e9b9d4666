import random

import pytest

CLASHING = "id long, shard int, kept boolean, factor double, ids string, toxicity string, labels string, a int"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows():
    """Nulls, empty, blank, short and long texts, ties, repeated rows, odd signs."""
    rng = random.Random(5)
    base, long = sentence(rng, 120), sentence(rng, 30_000, 5000)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base),
        (2, base),
        (2, base),
        (3, base.upper()),
        (4, " ".join(near)),
        (5, None),
        (6, ""),
        (7, " \t\n "),
        (8, "one two"),
        (9, "one two"),
        (10, long),
        (11, "start " + " ".join(long.split()[100:400]) + " end"),
        (12, sentence(rng, 80)),
        (13, "▁ und   日本語 😀 \x00 ß"),
        (14, "x " * 300),
        (None, base),
        (None, None),
    ]


@pytest.fixture
def awkward(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    rows = [
        (i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}", len(t or ""), *[None] * 8)
        for i, t in awkward_rows()
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def nothing(awkward):
    return awkward.limit(0)
