"""Pieces, language model, licenses and toxicity."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import licenses, lm, pieces, queries, toxicity

from .conftest import sentence

needs_model = pytest.mark.skipif(not os.path.exists(queries.PIECES), reason="no vocabulary file")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(queries.PIECES)


@pytest.fixture(scope="module")
def cutter(vocabulary):
    return pieces.Segmenter(vocabulary, vocabulary.double_array())


@needs_model
def test_cuts_score_as_another_library_finds(vocabulary, cutter):
    names = [
        p.decode() if vocabulary.normal[i] else f"<{i}>" for i, p in enumerate(vocabulary.pieces)
    ]
    other = tokenizers.Tokenizer(
        tokenizers.models.Unigram(list(zip(names, vocabulary.scores, strict=True)), 0, False)
    )
    rng = random.Random(1)
    for _ in range(300):
        word = " " + "".join(rng.choice("aeinorst ") for _ in range(rng.randrange(1, 30)))
        mine = cutter.encode([word[1:]])[0]
        assert sum(vocabulary.scores[i] for i in mine) == pytest.approx(
            sum(vocabulary.scores[i] for i in other.encode(word).ids)
        )


@needs_model
@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=90))
def test_round_trip_and_both_ways_of_cutting(vocabulary, cutter, text):
    ids = cutter.encode([text])[0]
    assert pieces.decode_ids(ids.tolist(), vocabulary.pieces) == text
    if text:
        chunks = cutter.chunks(b" " + text.encode())
        single = np.concatenate([np.frombuffer(cutter._one(c), np.int32) for c in chunks])
        assert single.tolist() == ids.tolist()


@needs_model
def test_piece_frames(awkward, nothing, vocabulary):
    rows = pieces.encode_pieces(awkward, vocabulary, check=True)
    back = pieces.decode_pieces(rows, vocabulary).collect()
    for r in back:
        assert r["exact"] and r["decoded"] == r["text"]
        assert (r["ids"] is None) == (r["text"] is None)
        assert r["n_pieces"] == len(r["ids"] or [])
    assert rows.columns.count("ids") == 1
    assert pieces.encode_pieces(nothing, vocabulary).count() == 0


def plain_model(rows, learns, strength):
    tokens = [(t or "").encode().lower().split() + ["end"] for t in rows]
    counts, pairs, before = collections.Counter(), collections.Counter(), collections.Counter()
    for words, learn in zip(tokens, learns, strict=True):
        if learn:
            counts.update(words)
            pairs.update(zip(["begin", *words], words))
            before.update(["begin", *words[:-1]])
    n, v = sum(counts.values()), len(counts)
    for words in tokens:
        base = [(counts[w] + 1) / (n + v + 1) for w in words]
        full = [
            (pairs[h, w] + strength * p) / (before[h] + strength)
            for h, w, p in zip(["begin", *words], words, base)
        ]
        yield (len(words), sum(counts[w] > 0 for w in words), n,
               sum(map(math.log10, base)), sum(map(math.log10, full)))


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_language_model_against_plain_counts(awkward, block):
    learn = F.col("doc_id") % 3 != 1
    found = lm.score_texts(awkward, learn, block_bytes=block).collect()
    rows = awkward.select("doc_id", "text", F.coalesce(learn, F.lit(True))).collect()
    expected = plain_model([r[1] for r in rows], [r[2] for r in rows], found[0]["strength"])
    expected = sorted((str(r[0]), *(round(x, 6) for x in e)) for r, e in zip(rows, expected, strict=True))
    got = sorted(
        (str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6),
         round(r["score"], 6)) for r in found
    )
    assert got == expected


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("segment", [5, 256])
def test_automaton_walks_states_like_plain_backoff(monkeypatch, order, segment):
    """State by state and weight by weight, with texts longer than a segment."""
    monkeypatch.setattr(lm, "SEGMENT", segment)
    rng = random.Random(order)
    texts = [[rng.randrange(7) for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    learns = [k % 3 > 0 for k in range(30)]
    seen = collections.Counter()
    for words, learn in zip(texts, learns, strict=True):
        if learn:
            seen.update(
                tuple(["begin", *words][max(0, k + 1 - n + 1) : k + 2])
                for k in range(len(words)) for n in range(1, order + 1) if n <= k + 2
            )
    bounds = np.cumsum([0, *map(len, texts)])
    grams, counts = [], []
    for n in range(1, order + 1):
        names = [
            tuple(["begin", *w][k + 2 - n : k + 2]) if n <= k + 2 else None for w in texts for k in range(len(w))
        ]
        kinds = {g: i for i, g in enumerate(sorted({g for g in names if g}, key=str))}
        grams.append(np.array([kinds[g] if g else -1 for g in names]))
        counts.append(np.array([seen[g] for g in kinds], dtype=np.uint64))
    begins = np.zeros(bounds[-1], dtype=bool)
    begins[bounds[:-1]] = True
    strengths, n_texts, bottom = (2.0, 32.0), sum(learns), 500.0
    automaton = lm.Automaton(grams, counts, begins, n_texts, bottom, strengths)

    def probability(history, word, s):
        if not history:
            return (seen[(word,)] + 1) / bottom
        before = n_texts if history == ("begin",) else seen[history]
        return (seen[(*history, word)] + s * probability(history[1:], word, s)) / (before + s)

    got = automaton.read(grams[0], bounds)
    for k, words in enumerate(texts):
        for c, s in enumerate(strengths):
            line = ["begin", *words]
            whole = sum(
                math.log10(probability(tuple(line[max(0, i - order + 1) : i]), line[i], s)) for i in range(1, len(line))
            )
            assert got[k, c] == pytest.approx(whole, abs=1e-9)
    # the carried state is the longest known history
    if order > 1:
        state = np.array([1])
        line = ["begin", *texts[0]]
        for i in range(1, len(line)):
            state, _ = automaton.step(state, grams[0][[bounds[0] + i - 1]])
            longest = max((n for n in range(order) if n <= i + 1 and (not n or seen[tuple(line[i + 1 - n : i + 1])])), default=0)
            depth, at = 0, int(state[0])
            while at:
                at, depth = int(automaton.fails[at]), depth + 1
            assert depth == longest


def test_counts_beyond_32_bits_arrive():
    for top in (7, 2**32 - 1, 2**32, 2**40):
        packed = [lm._packed(np.array([3, 9], dtype=np.uint64))] * 2
        counts = [zlib.compress(np.array([top % 2**32, 1], dtype=np.uint32).tobytes(), 1)] * 2
        table = pa.table({"block": pa.array([0, 1], pa.int32()), "hashes": packed, "counts": counts})
        answer = lm._answers((pa.scalar(0), pa.scalar(1)), table)
        assert lm._received(answer.column("counts")[0].as_py()).tolist() == [2 * (top % 2**32), 2]


def test_language_model_orders_and_empty_input(spark, awkward, nothing):
    assert lm.score_texts(nothing, F.lit(True)).count() == 0
    none = lm.score_texts(awkward, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)
    rng = random.Random(2)
    pattern = [sentence(rng, 40, 30) for _ in range(5)]
    docs = spark.createDataFrame([(i, pattern[i % 5]) for i in range(60)], "doc_id long, text string")
    sums = [
        lm.score_texts(docs, F.col("doc_id") < 30, order=n).filter("doc_id >= 30").agg(F.sum("score")).first()[0]
        for n in (1, 2, 3)
    ]
    assert sums[0] < sums[1] < sums[2]


def test_packed_hashes():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 100_000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm._unpacked(lm._packed(hashes)) == hashes).all()


def test_template_automata():
    machine = licenses.compile_template("under [[the terms of]] license [[version <<1-2>>]] applies")

    def accepts(text):
        words = licenses.plain_words(text)
        return licenses.longest_match(words, 0, machine) == len(words) > 0

    assert accepts("Under license applies") and accepts("under the terms of LICENSE applies")
    assert accepts("under license version 2 applies") and accepts("under license version 2.0 applies")
    for wrong in ("under the license applies", "under license version applies", "license applies",
                  "under license version 1 2 3 applies", "under licence applies"):
        assert not accepts(wrong)
    for bad in ("<<1-2>> x", "[[x]]", "[[x"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad)


def test_license_rows(spark, awkward, nothing):
    rows = [
        (1, "All rights reserved. ALL-RIGHTS reserved!"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "all rights were reserved; general public licenses"),
        (4, None),
        (5, "Copyright 2020 Some Body. All rights reserved"),
        (6, "éall rights reserved"),
    ]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"]) == (2, 0, 3)
    assert found[2]["base_labels"] == "cc-by" and found[2]["labels"] == "cc-by,notice:cc-by-nc"
    assert found[3]["n_base"] == 0 and found[3]["first_word"] is None and found[3]["score"] == 0
    assert found[4]["n_words"] == 0 and found[4]["labels"] == ""
    assert found[5]["labels"] == "notice:copyright,reserved" and found[5]["matches"][0]["n_words"] == 7
    assert found[6]["n_base"] == 0
    assert licenses.scan_licenses(awkward).count() == awkward.count()
    assert licenses.scan_licenses(nothing).count() == 0


def test_segments_are_the_maximal_ones():
    """Against the definition: repeatedly take the best stretch, left and right of it go on."""

    def brute(scores, a, b):
        best = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)),
                   key=lambda x: (round(x[0], 9), -(x[2] - x[1]), -x[1]), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        return brute(scores, a, best[1]) + [(best[1], best[2] - 1, best[0])] + brute(scores, best[2], b)

    rng = random.Random(6)
    for _ in range(200):
        scores = [rng.choice([-0.25, -0.25, 1.03, 2.017, -1.5]) for _ in range(rng.randrange(1, 14))]
        hits = [(i, s) for i, s in enumerate(scores) if s != -0.25]
        found = toxicity.segments(hits, 0.25)
        expected = brute(scores, 0, len(scores))
        assert [x[:2] for x in found] == [x[:2] for x in expected]
        assert [x[2] for x in found] == pytest.approx([x[2] for x in expected])


def test_toxicity_on_planted_words(spark, awkward, nothing):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = sentence(rng, 80).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "foul"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels + [(None, 1), (9999, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marked.filter("doc_id < 200 or doc_id is null"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(got[i]["toxicity"] >= 0.7, y) for i, y in labels if i >= 200]
    assert sum(p for p, y in held if y) >= 36 and sum(p for p, y in held if not y) == 0
    spans = got[200]["passages"]
    assert spans and all(0 <= s["first_word"] <= s["last_word"] < 84 for s in spans)
    scored = toxicity.score_toxicity(awkward, model)
    assert scored.count() == awkward.count() and scored.filter("toxicity between 0 and 1").count() == scored.count()
    assert toxicity.score_toxicity(nothing, model).count() == 0
    bare = toxicity.fit_toxicity(docs, marked.limit(0))
    assert toxicity.score_toxicity(docs, bare).agg(F.max("toxicity")).first()[0] < 0.01


def test_toxicity_query_over_awkward_rows(spark, awkward, tmp_path):
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, int(i in (4, 9, 12))) for i in range(14)] + [(None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(key.encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= queries.TOXIC)
