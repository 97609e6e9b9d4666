"""Vector search, passages and the pipeline."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import ann, exact_search, passages, queries
from ledgerloom.llm.vectors import usable

from .conftest import sentence


def vectors_of(spark, n=600, d=8, seed=1, whole=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 2 * rng.normal(size=(6, d))[rng.integers(0, 6, n)]
    x[: n // 3] = x[0]  # one vector holds a third
    x = np.floor(8 * x) if whole else x
    rows = [(i, x[i].tolist(), "same") for i in range(n)]
    odd = [(n, None, ""), (n + 1, [], ""), (n + 2, [None] * d, ""), (n + 3, [float("nan")] * d, ""),
           (n + 4, [float("inf")] * d, ""), (None, [1.0] * d, "")]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")


def best(x, query, k):
    scores = x @ x[query]
    order = np.lexsort((np.arange(len(x)), -scores))
    return [int(i) for i in order if i != query][:k]


def test_exact_search_against_all_pairs(spark):
    x, table = vectors_of(spark, whole=True)
    kept = usable(table, "vec_id", F.col("embedding"))
    rows = exact_search.exact_top_k(kept, kept.filter("id % 50 = 0"), 5).collect()
    for query in range(0, len(x), 50):
        mine = sorted((r for r in rows if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == best(x, query, 5)
        assert [r["score"] for r in mine] == [float(x[query] @ x[v]) for v in best(x, query, 5)]


def test_exact_search_small_and_empty(spark):
    _, table = vectors_of(spark)
    kept = usable(table, "vec_id", F.col("embedding"))
    assert exact_search.exact_top_k(kept.limit(0), kept.limit(0), 5).count() == 0
    assert exact_search.exact_top_k(kept, kept.limit(0), 5).count() == 0
    few = exact_search.exact_top_k(kept.filter("id < 3"), kept.filter("id = 0"), 5)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [1, 2]


def test_exact_search_in_small_blocks(spark, monkeypatch):
    x, table = vectors_of(spark, whole=True, seed=4)
    kept = usable(table, "vec_id", F.col("embedding"))
    for name, value in (("BLOCK", 16), ("QUERY_BLOCK", 4), ("FIRST", 8), ("PIVOTS", 3)):
        monkeypatch.setattr(exact_search, name, value)
    rows = exact_search.exact_top_k(kept, kept.filter("id % 60 = 7"), 5).collect()
    for query in range(7, len(x), 60):
        mine = sorted((r for r in rows if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == best(x, query, 5)


def test_graph_search_recall(spark):
    x, table = vectors_of(spark, n=2000, d=16, seed=2)
    kept = usable(table, "vec_id", F.col("embedding"), zero=False)
    rows = ann.nearest_neighbours(kept, kept.filter("id % 20 = 1"), 20).collect()
    hits = 0
    asked = range(1, len(x), 20)
    for query in asked:
        mine = sorted((r for r in rows if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        scores = x @ x[query]
        assert all(r["score"] == pytest.approx(scores[r["vec_id"]], abs=1e-9) for r in mine)
        edge = sorted(np.delete(scores, query))[-20] - 1e-9  # ties in score are as near
        hits += sum(r["score"] >= edge for r in mine)
    assert hits >= 0.9 * 20 * len(asked)


def test_graph_search_small_and_empty(spark):
    _, table = vectors_of(spark)
    kept = usable(table, "vec_id", F.col("embedding"), zero=False)
    assert ann.nearest_neighbours(kept.limit(0), kept, 5).count() == 0
    few = ann.nearest_neighbours(kept.filter("id in (1, 300, 301)"), kept.filter("id = 1"), 5).collect()
    assert sorted(r["vec_id"] for r in few) == [300, 301]


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(7)
    for _ in range(60):
        sizes = rng.integers(0, 40, 4)
        values = rng.integers(1, 25, sizes.sum()).astype(np.uint64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        least = int(rng.integers(2, 9))
        expected = set()
        for d in range(4):
            line = values[bounds[d] : bounds[d + 1]]
            for c in range(len(line)):
                low, high = c, c
                while low > 0 and line[low - 1] >= line[c]:
                    low -= 1
                while high + 1 < len(line) and line[high + 1] >= line[c]:
                    high += 1
                if high - low + 1 >= least:
                    expected.add((d, low, int(line[c]), high))
        found = passages.compact_windows(values, bounds, least)
        got = [(d, low, int(values[bounds[d] + c]), high) for d, low, c, high in found]
        assert set(got) == expected and len(got) == len(set(got))


def passages_of(a, b, seed, words=50, percent=75, width=5):
    a, b = (passages.word_hashes(" ".join(x)) for x in (a, b))
    return passages.common_passages(a, b, [seed], words, percent, width)


def around(rng, words, before=80, after=80):
    return sentence(rng, before, 10**6).split() + words + sentence(rng, after, 10**6).split()


@pytest.mark.parametrize("edits", [[44], [9], [44, 54], [6, 93], [48], [15, 16, 17, 18, 19, 20, 21]])
def test_edits_near_the_ends_and_close_to_each_other(edits):
    rng = random.Random(3)
    size = 55 if len(edits) == 1 else 100
    passage = sentence(rng, size, 10**6).split()
    changed = [f"e{k}" if k in edits else w for k, w in enumerate(passage)]
    seed = max(set(range(size - 5)) - {k - d for k in edits for d in range(5)}, key=lambda k: -abs(k - 27))
    (s, e, t, u, common, every), = passages_of(around(rng, passage), around(rng, changed), (80 + seed, 80 + seed))
    assert (s, e, t, u) == (80, 80 + size, 80, 80 + size) and 100 * common >= 75 * every


def test_a_less_similar_continuation_hides_no_passage():
    rng = random.Random(4)
    first, rest = sentence(rng, 90, 10**6).split(), sentence(rng, 200, 10**6).split()
    changed = [f"f{k}" if k in (30, 60) else w for k, w in enumerate(first)]
    worse = [w if k % 40 < 20 else f"r{k}" for k, w in enumerate(rest)]
    found = passages_of(around(rng, first + rest), around(rng, changed + worse), (90, 90))
    assert any(s <= 80 and e >= 170 for s, e, *_ in found)
    assert all(100 * common >= 75 * every for *_, common, every in found)


def test_long_insertions_are_crossed():
    rng = random.Random(6)
    passage = sentence(rng, 300, 10**6).split()
    longer = passage[:150] + sentence(rng, 40, 10**6).split() + passage[150:]
    found = passages_of(around(rng, passage), around(rng, longer), (100, 100))
    assert [f[:4] for f in found] == [(80, 380, 80, 420)]


def test_passages_against_brute_force():
    words, width = 12, 2
    seen = [0, 0]
    for turn in range(150):
        rng = random.Random(turn)
        passage = sentence(rng, rng.randrange(9, 22), 10**6).split()
        changed = list(passage)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(3)
        a, b = around(rng, passage, 6, 6), around(rng, changed, 5, 7)
        x, y = list(zip(a, a[1:])), list(zip(b, b[1:]))
        same = [(i, y.index(g)) for i, g in enumerate(x) if g in y]
        sets = [
            [set(z[s : e - 1]) for s in range(len(z)) for e in range(s + words, len(z) + 2)] for z in (x, y)
        ]
        expected = any(4 * len(p & q) >= 3 * len(p | q) for p in sets[0] for q in sets[1])
        found = [f for seed in same for f in passages_of(a, b, seed, words, 75, width)]
        assert bool(found) == expected, turn
        for s, e, t, u, common, every in found:
            p, q = set(x[s : e - 1]), set(y[t : u - 1])
            assert (common, every) == (len(p & q), len(p | q)) and 4 * common >= 3 * every
            assert min(e - s, u - t) >= words and e <= len(a) and u <= len(b) and s >= 0 and t >= 0
        seen[expected] += 1
    assert min(seen) > 20


def test_stretches_give_the_chains_and_ranges_of_single_steps():
    seen = Counter()
    for turn in range(300):
        rng = random.Random(turn)
        a = sentence(rng, rng.randrange(60, 160), 10**6).split()
        b = list(a)
        for _ in range(rng.randrange(12)):
            i, k, to = (rng.randrange(len(b)) for _ in range(3))
            if rng.random() < 0.3:  # a part at another place
                part = b[i : i + 15]
                del b[i : i + 15]
                b[to:to] = part
            else:
                b[k : k + rng.randrange(8)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(4)
        x, y = (passages.shingle_hashes(passages.word_hashes(" ".join(z)), 2) for z in (a, b))
        shared = [np.flatnonzero(np.isin(*z)) for z in ((x, y), (y, x))]
        plain = passages._sharing(x, y, *shared)
        seen[plain is not None] += 1
        if plain is None:
            continue
        most = min(len(x), len(y)) // 3
        for at_x in shared[0][::7].tolist():
            at_y = int(np.flatnonzero(y == x[at_x])[0])
            chain = passages._chain(x, y, *shared, at_x, at_y, most)
            ranges = list(map(tuple, passages._ranges(x, y, chain, 12, 75, 2)))
            runs = plain.chain(plain.row_of(at_x), most)[1]
            assert runs == list(map(tuple, chain.tolist())), turn
            assert list(map(tuple, plain.ranges(runs, 12, 75, 2))) == ranges, turn
            seen["several"] += len(ranges) > 1
    assert seen[True] > 200 and seen["several"] > 50


def test_texts_that_share_a_line_are_told_by_marks(monkeypatch):
    rng = random.Random(8)
    line = sentence(rng, 12, 10**6)
    texts = [f"{sentence(rng, 100, 10**6)} {line}" for _ in range(20)]
    table = pa.table({"id": pa.array(range(20), pa.int64()), "text": texts})
    pairs = pa.table({
        "a": pa.array([a for b in range(20) for a in range(b)], pa.int64()),
        "b": pa.array([b for b in range(20) for a in range(b)], pa.int64()),
        "at_a": [[100]] * 190, "at_b": [[100]] * 190,
    })
    compared = []
    monkeypatch.setattr(np, "intersect1d", lambda *a, **k: compared.append(a))
    assert passages._verified(50, 75, 5)(None, table, pairs).num_rows == 0
    assert compared == []


def threshold_pairs(n):
    """Pairs of texts around passages of 50 to 59 words whose similarity is 0.75 to 0.77."""
    rng = random.Random(5)
    while n:
        size = rng.randrange(50, 60)
        passage = sentence(rng, size, 10**6).split()
        changed = list(passage)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(size)
            changed[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(3)
        x, y = (set(zip(*(p[k:] for k in range(5)))) for p in (passage, changed))
        if len(changed) >= 50 and 0.75 <= len(x & y) / len(x | y) <= 0.77:
            n -= 1
            yield [" ".join(around(rng, p)) for p in (passage, changed)]


def test_threshold_passages_become_candidates():
    found = 0
    for texts in threshold_pairs(1200):
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], names=["id", "text"])
        rows = [r for made in passages._windows(5, 46, np.empty(0, np.int64))([batch]) for r in made.to_pylist()]
        later = {}
        for r in rows:
            if r["id"] == 2:
                later.setdefault(r["v"], []).append(r)
        seeds = [
            {"h": x["h"], "ca": x["c"], "la": x["l"], "ra": x["r"], "cb": y["c"], "lb": y["l"], "rb": y["r"]}
            for x in rows if x["id"] == 1 for y in later.get(x["v"], [])
        ]
        if seeds:
            pair = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([seeds])], names=["a", "b", "seeds"])
            found += sum(made.num_rows for made in passages._agreeing(46)([pair]))
    assert found == 1200


def planted(spark):
    rng = random.Random(11)
    passage = sentence(rng, 70, 5000).split()
    changed = list(passage)
    changed[35] = "other"
    line = "this very line stands in all of the texts"
    rows = []
    for i in range(40):
        words = sentence(rng, 150, 5000).split()
        if i in (3, 17, 29):
            words[40:40] = passage
        if i == 33:
            words[10:10] = changed
        rows.append((i, " ".join(words) + " " + line))
    rows.append((40, rows[8][1]))
    return spark.createDataFrame(rows, "doc_id long, text string"), passage


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    docs, passage = planted(spark)
    found = passages.near_passages(docs).collect()
    assert {(r["a"], r["b"]) for r in found} == {(3, 17), (3, 29), (3, 33), (8, 40)}
    exact = next(r for r in found if r["b"] == 17)
    assert (exact["b_first"], exact["b_end"]) == (40, 110) and exact["similarity"] == 1.0
    spans = passages.repeated_spans(passages.near_passages(docs))
    cut = {r["doc_id"]: r["text"] for r in passages.cut_passages(docs, spans).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 40 not in cut and len(cut) == 40
    assert " ".join(passage) in cut[3] and " ".join(passage) not in cut[17]
    assert all(cut[i] == before[i] for i in cut if i not in (17, 29, 33))


def test_documents_that_quote_a_part_hide_no_passage(spark):
    rng = random.Random(8)
    rows, pairs = [], set()
    for _ in range(3):
        passage = sentence(rng, 60, 10**6).split()
        quotes = [passage[at : at + 24] for at in range(0, 37, 2) for _ in range(8)]
        pairs.add((len(rows) + len(quotes), len(rows) + len(quotes) + 1))
        rows += [(len(rows) + n, " ".join(around(rng, q))) for n, q in enumerate([*quotes, passage, passage])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["a"], r["b"]) for r in passages.near_passages(docs).collect()} == pairs


def test_documents_that_share_a_quote_are_not_compared(spark, monkeypatch):
    rng = random.Random(12)
    passage, quote = (sentence(rng, n, 10**6).split() for n in (60, 24))
    texts = [" ".join(around(rng, quote)) for _ in range(60)] + [" ".join(around(rng, passage)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared, decided = [], passages._decided

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return decided(pairs, *rest)

    monkeypatch.setattr(passages, "_decided", counted)
    assert [(r["a"], r["b"]) for r in passages.near_passages(docs).collect()] == [(60, 61)]
    assert sum(compared) == 1


def test_dense_places_are_all_stretches_with_few_lone_shingles():
    for turn in range(200):
        rng = np.random.default_rng(turn)
        lone = rng.random(rng.integers(0, 40)) < rng.choice([0.1, 0.25, 0.4])
        expected = np.zeros(len(lone), dtype=bool)
        for i in range(len(lone)):
            for j in range(i + 6, len(lone) + 1):
                if 100 * lone[i:j].sum() <= 25 * (j - i):
                    expected[i:j] = True
        assert (passages._dense_places(lone, lone, 6, 75) == expected).all(), turn


def test_shingles_that_other_texts_have_are_told_across_groups():
    lines = [np.arange(k, k + 30, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (0, 20, 100, 20)]
    blobs, codes = [], []
    for g, group in enumerate((lines[:1], lines[1:3], lines[3:])):
        found, several, places = passages._by_bucket(group, 5)
        codes.append(found)
        for k, i, j in places:
            low, high = found[i:j].astype("<u4"), (found[i:j] >> np.uint64(32)).astype(np.uint8)
            blobs.append((g, k, low.tobytes(), high.tobytes(), np.packbits(several[i:j]).tobytes(), j - i))
    met = [set(), set(), set()]
    for bucket in range(5):
        rows = [b for b in blobs if b[1] == bucket]
        names = ["g", "bucket", "low", "high", "several"]
        table = pa.table([pa.array(c) for c in list(zip(*rows))[:5]], names)
        for row, blob in zip(passages._met(None, table).to_pylist(), rows):
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=blob[5]).astype(bool)
            mine = [b[5] for b in blobs if b[0] == blob[0] and b[1] < bucket]
            met[row["g"]] |= set(codes[row["g"]][sum(mine) : sum(mine) + blob[5]][bits].tolist())
    a, b, c, d = (set(x.tolist()) for x in lines)
    assert met == [a & b, b, d]


def test_a_text_moves_once_for_documents_that_meet_each_other(spark):
    rows = [(a, b, [0], [0]) for a in range(20) for b in range(a + 1, 20)]
    dealt = passages._dealt(spark.createDataFrame(rows, "a long, b long, at_a array<int>, at_b array<int>"))
    assert dealt.count() == len(rows)
    assert dealt.select("b", "block", "part").distinct().count() == 19


def test_frequent_signatures_are_split(spark, monkeypatch):
    monkeypatch.setattr(passages, "SAMPLE_SHARE", 1)
    monkeypatch.setattr(passages, "SAMPLE_HOT", 2)
    docs, _ = planted(spark)
    flagged = {r["b"] for r in passages.near_passages(docs).collect()}
    assert flagged == {17, 29, 33, 40}


def test_awkward_passages(awkward, nothing):
    flagged = {r["b"] for r in passages.near_passages(awkward).collect()}
    assert flagged == {2, 3, 4, 11}
    spans = passages.repeated_spans(passages.near_passages(awkward))
    left = passages.cut_passages(awkward, spans)
    assert left.columns == awkward.columns and {5, 6, 10, 12} <= {r["doc_id"] for r in left.collect()}
    assert passages.near_passages(nothing).count() == 0


@pytest.mark.skipif(not os.path.exists(queries.PIECES), reason="no vocabulary file")
def test_pipeline(spark, awkward, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = awkward.select(*columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_dedup", "substring_dedup", "mixing", "pieces"
    ]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns and now.schema == docs.schema
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()}
    assert {1, 5, 6, 8, 10} <= kept and not kept & {2, 3, 4, 9}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == ["doc_id", "lang", "source", "n_pieces", "ids"] and final.count() > 3
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
