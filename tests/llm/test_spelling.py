import random
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    """Whether one edit makes a and b equal."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    others = {w: [x for x in counts if near(w, x)] for w in counts}
    best = {w: min(xs, key=lambda x: (-counts[x], x), default=None) for w, xs in others.items()}
    form = {w: b if b and counts[b] >= 5 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(others[w]), counts.get(form[w])) for w, n in counts.items())


def vocabulary(rng, n):
    """Words with long halves in common, runs of one letter, and letters beyond ASCII."""
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 10))) for _ in range(n // 6)]
    words = set(stems) | {"a" * k for k in range(6, 12)}
    while len(words) < n:
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            w[k : k + (kind > 0)] = [] if kind == 1 else [rng.choice("abcéÿ")]
        if len(w) >= 6:
            words.add("".join(w))
    return {w: rng.choice([5, 6, 25, 30, 130, 700]) for w in words}


@pytest.mark.parametrize("block", [1_000, 7])
def test_variants_are_the_plain_ones(spark, block):
    counts = vocabulary(random.Random(block), 220)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.spelling_variants(words, block=block).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(tuple(r) for r in got.collect()) == plain_variants(counts)


def test_query_is_the_plain_one(spark, tmp_path):
    rng = random.Random(8)
    vocab = [*vocabulary(rng, 40), "Straße", "ÀÉÎÕÜÿ", "x", "naïveté"]
    texts = [" ".join(rng.choice(vocab) + rng.choice(["", ",", "1", "-"]) for _ in range(120)) for _ in range(60)]
    rows = [*enumerate(texts), (3, texts[5]), (None, texts[6]), (70, None), (71, ""), (72, " \n42"), (73, "LONGWORDS " * 3000), (74, "longwordz " * 7)]
    clash = "doc_id long, text string, word string, n long, id string, sum int"
    spark.createDataFrame([(*r, None, None, None, None) for r in rows], clash).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n")
    plain = plain_variants(plain_words(rows))
    assert sorted(tuple(r) for r in got.collect()) == plain
    assert any(r[1] for r in plain)


def test_suffix_ranks_are_sorted_suffixes():
    import numpy as np

    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(50)]
    text = np.concatenate([[*(ord(c) for c in w), 0] for w in words])
    ends = np.flatnonzero(text == 0)

    def suffix(k):
        end = ends[np.searchsorted(ends, k)]
        return [*text[k:end].tolist()], int(end)

    order = spelling.suffix_ranks(text, 9).tolist()
    assert order == sorted(range(len(text)), key=lambda k: ([*((c, -1) for c in suffix(k)[0]), (0, suffix(k)[1])]))


def test_no_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(none).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "short x")], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.vocabulary(docs, slips=199)).collect() == []
