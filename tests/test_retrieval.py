import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.operators import bm25, cache, hybrid, index, ordering, postings, similar, snapshots, temporal, vector
from ledgerloom.functions.vectors import embed_text

CFG = EngineConfig()
TEXTS = [
    "cash rose", "cash fell cash", "debt rose twice", "", "plain words only",
    "cash rose", "unrelated text", "rose rose rose cash",
]
QUERIES = [("a", "cash rose rose"), ("b", "zebra"), ("c", "Debt words")]


@pytest.fixture
def docs(spark):
    rows = [(f"d{i}", i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_key string, ord bigint, content string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id string, query string")


def plain_bm25(query):
    docs = [t.lower().split() for t in TEXTS]
    avg = sum(map(len, docs)) / len(docs)
    vocabulary = {w for d in docs for w in d}
    df = {w: sum(w in d for d in docs) for w in vocabulary}
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return [
        sum(
            idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg))
            for w in query.lower().split()
        )
        for d in docs
    ]


@pytest.mark.parametrize("cfg", [CFG, CFG.replace(broadcast_max_rows=0, salt_buckets=3)])
def test_bm25_against_plain_code(docs, asked, cfg):
    got = {(r.query_id, r.doc_key): r.bm25 for r in bm25.bm25_scores(asked, docs, cfg).collect()}
    for key, text in QUERIES:
        for i, score in enumerate(plain_bm25(text)):
            assert got.get((key, f"d{i}"), 0.0) == pytest.approx(score, abs=1e-6)


def embed(df, column):
    return df.withColumn("embedding", embed_text(F.col(column), CFG.embedding_dim))


def plain_hybrid(query, query_vec, vecs, k, w_v=0.5, w_b=0.5):
    scores = plain_bm25(query)
    top = max(scores)
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    dist = [
        round(1 - sum(a * b for a, b in zip(query_vec, v)) / max(norm(query_vec) * norm(v), 1e-12), 6)
        for v in vecs
    ]
    near = sorted(range(len(vecs)), key=lambda i: (dist[i], i))[: 2 * k]
    combined = {i: w_v / (1 + dist[i]) for i in near}
    for i, s in enumerate(scores):
        combined[i] = combined.get(i, 0.0) + w_b * (s / top if top > 0 else 0.0)
    order = sorted(combined, key=lambda i: -round(combined[i], 6))
    return [(f"d{i}", round(combined[i], 6)) for i in order[:k]]


@pytest.mark.parametrize("k", [1, 2, 5, 8])
@pytest.mark.parametrize("weights", [(0.5, 0.5), (0.0, 1.0), (1.0, 0.0)])
def test_hybrid_against_plain_code(docs, asked, k, weights):
    cfg = CFG.replace(vector_weight=weights[0], bm25_weight=weights[1])
    d, q = embed(docs, "content").persist(), embed(asked, "query").persist()
    vecs = [r.embedding for r in d.orderBy("ord").collect()]
    asked_vecs = {r.query_id: r.embedding for r in q.collect()}
    got = hybrid.hybrid_topk(q, d, k, cfg).orderBy("query_id", "rank").collect()
    for key, text in QUERIES:
        mine = [(r.doc_key, pytest.approx(r.score, abs=2e-6)) for r in got if r.query_id == key]
        assert plain_hybrid(text, asked_vecs[key], vecs, k, *weights) == mine


def random_vectors(spark, n, key, seed):
    data = np.random.default_rng(seed).integers(-3, 4, (n, 6)).astype(float)
    rows = [(i, i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{key} bigint, ord bigint, embedding array<double>")


def test_blocked_search_equals_one_pass(spark):
    q = random_vectors(spark, 40, "query_id", 1).drop("ord")
    d = random_vectors(spark, 300, "doc_key", 2)
    one = vector.vector_topk(q, d, 7, CFG).collect()
    small = CFG.replace(query_block_rows=9, corpus_block_rows=31)
    assert sorted(one) == sorted(vector.vector_topk(q, d, 7, small).collect())
    assert len(one) == 280
    # integer vectors give many equal distances: the lower ord must come first
    ranks = sorted((r.query_id, r["rank"], r.distance, r.ord) for r in one)
    for a, b in zip(ranks, ranks[1:]):
        assert a[0] != b[0] or (a[2], a[3]) < (b[2], b[3])
    entries = vector.nearest_entry(q, d, CFG).collect()
    assert sorted(entries) == sorted(vector.nearest_entry(q, d, small).collect())


def test_k_larger_than_corpus(spark):
    q = random_vectors(spark, 2, "query_id", 1).drop("ord")
    assert vector.vector_topk(q, random_vectors(spark, 3, "doc_key", 2), 50).count() == 6


def test_rerank_blends_scores(spark):
    rows = [("q", f"d{i}", s, i + 1, "a b", t) for i, (s, t) in enumerate([(0.9, "x"), (0.8, "a"), (0.1, "a b")])]
    pool = spark.createDataFrame(rows, "query_id string, doc_key string, score double, rank int, query string, content string")
    got = hybrid.rerank(pool, 2).orderBy("rank").collect()
    assert [(r.doc_key, r.score) for r in got] == [("d1", pytest.approx(0.71)), ("d0", pytest.approx(0.63))]


def test_diversify(spark):
    kinds = ["text"] * 4 + ["table"] * 3 + ["table_summary"]
    rows = [("q", k, i + 1) for i, k in enumerate(kinds)]
    ranked = spark.createDataFrame(rows, "query_id string, doc_type string, rank int")
    got = [r.doc_type for r in hybrid.diversify(ranked, 5).orderBy("rank").collect()]
    assert got == ["table", "table", "text", "text", "text"]
    assert [r.doc_type for r in hybrid.diversify(ranked, 1).collect()] == ["table"]


REF = dt.datetime(2024, 1, 1)


def test_decay_factors(spark):
    days = [0, 1, 365, 730, -365, None]
    rows = [("q", str(d), 1.0, i + 1, None if d is None else REF - dt.timedelta(days=d)) for i, d in enumerate(days)]
    ranked = spark.createDataFrame(rows, "query_id string, doc_key string, score double, rank int, filing_date timestamp")
    got = {r.doc_key: r for r in temporal.apply_decay(ranked, REF, CFG.replace(score_scale=12)).collect()}
    expected = [1.0, 0.9997260649243266, 0.9048374180359595, 0.8187307530779818, 1.1051709180756477]
    for d, factor in zip(days, expected):
        assert got[str(d)].decay_factor == pytest.approx(factor, abs=1e-15)
    assert got["None"].score == 1.0 and got["None"].days_old is None
    assert got["-365"]["rank"] == 1
    off = temporal.apply_decay(ranked, REF, CFG.replace(decay_enabled=False))
    assert off.filter("days_old = 365").count() == 1


def filing_rows(spark):
    rows = [
        ("q", f"d{i}", i, 10.0 - i, t, k, None if d is None else REF - dt.timedelta(days=d))
        for i, (t, k, d) in enumerate(
            [("aapl", "10-K", 400), ("AAPL", "10-K", 10), ("MSFT", "10-K", 5), ("AAPL", "10-Q", 3), ("AAPL", "10-K", None), ("AAPL", "10-K", 40)]
        )
    ]
    return spark.createDataFrame(rows, "query_id string, doc_key string, ord bigint, score double, ticker string, filing_type string, filing_date timestamp")


def test_recent_filings_filters_after_the_cut(spark):
    found = temporal.recent_filings(filing_rows(spark), 2, REF, CFG, "Aapl", "10-K", 365).collect()
    assert [r.doc_key for r in found] == ["d1"]
    no_age = temporal.recent_filings(filing_rows(spark), 3, REF, CFG, "aapl", "10-K").orderBy("rank")
    assert [r.doc_key for r in no_age.collect()] == ["d1", "d0", "d4"]
    best = temporal.most_recent(filing_rows(spark), REF, CFG, "AAPL")
    assert [r.doc_key for r in best.collect()] == ["d1"]
    early = temporal.recent_filings(filing_rows(spark), 1, REF, CFG.replace(decay_before_cut=True, decay_lambda=5.0))
    assert early.first().doc_key == "d1"


def test_periods(spark):
    found = temporal.compare_periods(filing_rows(spark), 2, REF, CFG, "AAPL").orderBy("period_rank").collect()
    assert [(r.period, r.doc_key) for r in found] == [("2023-12", "d1"), ("2023-11", "d5")]


def test_cache(spark):
    entries = spark.createDataFrame(
        [("x", [1.0, 0.0], "one", 1), ("y", [0.0, 1.0], "two", 2), ("x again", [2.0, 0.0], "three", 3)],
        "query string, embedding array<double>, value string, ord bigint",
    )
    probes = spark.createDataFrame([("p", [1.0, 0.1]), ("r", [1.0, 1.0])], "query_id string, embedding array<double>")
    got = {r.query_id: r for r in cache.cache_lookup(probes, entries).collect()}
    assert got["p"].value == "one" and got["p"].is_hit
    assert got["r"].value is None and not got["r"].is_hit
    scoped = entries.withColumn("scope", F.when(F.col("ord") == 2, "b").otherwise("a"))
    asked = probes.withColumn("scope", F.lit("a")).unionByName(
        spark.createDataFrame([("s", [1.0, 0.0], "b"), ("t", [1.0, 0.0], "c")], "query_id string, embedding array<double>, scope string")
    )
    few, many = (
        sorted(map(tuple, vector.nearest_entry(asked, scoped.withColumn("doc_key", F.col("ord")), c).collect()))
        for c in (CFG, CFG.replace(query_block_rows=1))
    )
    assert few == many and [r[0] for r in few] == ["p", "r", "s"]
    known = spark.createDataFrame([("q1", "x", "old", 1), ("q1", "x", "new", 2)], "scope string, query string, value string, ord bigint")
    questions = spark.createDataFrame([("q1", "x"), ("q2", "x")], "scope string, query string")
    answered, open_ = cache.split_known(questions, known)
    assert answered.first().value == "new" and open_.first().scope == "q2"


def test_reuse_stays_within_a_scope(spark):
    entries = spark.createDataFrame(
        [("q1", "x", [1.0, 0.0], "one", 1), ("q2", "y", [0.9, 0.1], "two", 2)],
        "scope string, query string, embedding array<double>, value string, ord bigint",
    )
    asked = spark.createDataFrame(
        [("a", "q1", "x", [0.0, 1.0]), ("b", "q2", "z", [1.0, 0.0]), ("c", "q3", "x", [1.0, 0.0]), ("d", "q1", "w", [0.0, 1.0])],
        "query_id string, scope string, query string, embedding array<double>",
    )
    reused, left = cache.reuse_results(asked, entries)
    assert {r.query_id: r.value for r in reused.collect()} == {"a": "one", "b": "two"}
    assert {r.query_id for r in left.collect()} == {"c", "d"}
    off, all_ = cache.reuse_results(asked, entries, CFG.replace(cache_enabled=False))
    assert off.isEmpty() and all_.count() == 4


@pytest.mark.parametrize("block", [4096, 5])
def test_similar_pairs_are_all_of_them(spark, block):
    """Also with slices of a few rows, a scope that holds most rows, and vectors near the bound."""
    rng = np.random.default_rng(block)
    bases = rng.normal(size=(6, 24))
    rows = []
    for k in range(140):
        v = bases[k % 6] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.22, 0.4])
        rows.append(("s" if k % 4 else f"t{k % 3}", k, v.tolist()))
    rows += [("s", 900, [0.0] * 24), ("s", 901, None), (None, 902, rows[0][2]), ("s", 903, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "scope string, id long, embedding array<double>")
    good = [r for r in rows[:140]]
    unit = np.array([r[2] for r in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 6)
    want = {
        (a[1], b[1]): cosine[i, j]
        for i, a in enumerate(good)
        for j, b in enumerate(good)
        if a[0] == b[0] and cosine[i, j] >= 0.95
    }
    cfg = CFG.replace(query_block_rows=block)
    got = {(r.left_id, r.right_id): r.similarity for r in similar.similar_pairs(df, df, 0.95, cfg).collect()}
    assert got.keys() == want.keys() and len(want) > 300
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
    probes, entries = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "ord").filter("ord < 60")
    near = {r.query_id: (r.ord, r.similarity) for r in similar.nearest_above(probes, entries, 0.95, cfg).collect()}
    for q in range(140):
        mine = [(-want[q, o], o) for o in range(60) if (q, o) in want]
        assert (near[q][0] == min(mine)[1]) if mine else q not in near
    none = df.limit(0)
    assert similar.similar_pairs(none, df, 0.95, cfg).count() == similar.similar_pairs(df, none, 0.95, cfg).count() == 0


def test_few_products_are_finished():
    rng = np.random.default_rng(1)
    sizes = 1 / np.arange(1, 65)
    vectors = rng.normal(size=(400, 64)) * sizes
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    i, j, _, multiplied = similar.pairs_above(vectors, vectors, 0.95)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*np.nonzero(vectors @ vectors.T >= 0.95), strict=True))
    assert multiplied < 400 * 400 / 20


def test_answers_are_stored_and_reused(spark, tmp_path):
    store = cache.AnswerStore(spark, str(tmp_path / "answers"))
    asked = []

    def answer(left):
        rows = left.collect()
        asked.extend(r.query_id for r in rows)
        given = [(r.query_id, None if r.query == "unknown" else f"to {r.query}") for r in rows]
        return spark.createDataFrame(given, "query_id string, value string")

    def ask(*rows):
        df = spark.createDataFrame(list(rows), "query_id string, scope string, query string, embedding array<double>")
        return {r.query_id: (r.value, r.from_cache) for r in cache.answered(df, answer, store).collect()}

    first = ask(("1", "k=5", "cash", [1.0, 0.0]), ("2", "k=5", "unknown", [0.0, 1.0]))
    assert first == {"1": ("to cash", False), "2": (None, False)}
    again = ask(
        ("3", "k=5", "cash", [0.0, 1.0]), ("4", "k=5", "cash?", [1.0, 0.1]), ("5", "k=9", "cash", [1.0, 0.0]),
        ("6", "k=5", "unknown", [0.0, 1.0]),
    )
    # the same text, a similar one, other settings, and what had no answer
    assert again == {"3": ("to cash", True), "4": ("to cash", True), "5": ("to cash", False), "6": (None, False)}
    assert asked == ["1", "2", "5", "6"] or sorted(asked) == ["1", "2", "5", "6"]
    assert sorted((r.scope, r.ord) for r in store.entries().collect()) == [("k=5", 0), ("k=9", 1)]
    assert ask(("7", "k=9", "cash", [0.5, 0.5])) == {"7": ("to cash", True)}


def chunk_rows(docs):
    extra = {c: F.lit(None).cast(t) for c, t in index_columns().items()}
    return docs.withColumns(extra).withColumn("doc_id", F.col("doc_key")).withColumn("chunk_id", F.lit("c"))


def index_columns():
    from ledgerloom.schema import CHUNK

    return {c: t for c, t in CHUNK.items() if c not in ("content", "doc_id", "chunk_id")}


def indexed(spark, root, asked, k=3, cfg=CFG):
    found = index.read_index(spark, root).topk(asked, k, cfg).collect()
    return sorted((r.query_id, r.rank, r.doc_key, r.score) for r in found)


def searched(asked, docs, k=3):
    found = bm25.bm25_topk(asked, docs, k, CFG).collect()
    return sorted((r.query_id, r.rank, r.doc_key, r.score) for r in found)


def test_index_grows_by_batches(spark, docs, asked, tmp_path):
    root = str(tmp_path / "index")
    rows = chunk_rows(docs)
    index.publish(rows.filter("ord < 5"), root, "one", CFG)
    # the second batch repeats some chunks; they are indexed once, and so is a repeated batch
    index.publish(rows.filter("ord >= 3"), root, "two", CFG)
    index.publish(rows.filter("ord >= 3"), root, "two", CFG)
    stored = index.read_index(spark, root)
    assert stored.chunks.count() == len(TEXTS)
    assert sorted(r.ord for r in stored.chunks.select("ord").collect()) == list(range(len(TEXTS)))
    assert indexed(spark, root, asked) == searched(asked, docs)
    index.clear_index(spark, root)
    with pytest.raises(FileNotFoundError):
        index.read_index(spark, root)
    index.publish(rows.filter("ord < 2"), root, "one", CFG)
    assert index.read_index(spark, root).chunks.count() == 2


def test_index_follows_changed_and_removed_documents(spark, docs, asked, tmp_path):
    root = str(tmp_path / "index")
    longer = F.when(F.col("ord") % 2 == 0, F.concat("content", F.lit(" cash extra debt"))).otherwise(F.col("content"))
    index.publish(chunk_rows(docs.withColumn("content", longer)), root, None, CFG)
    old = indexed(spark, root, asked)
    index.publish(chunk_rows(docs), root, None, CFG)  # shortened
    left = docs.filter("ord not in (0, 3)")
    index.publish(chunk_rows(left), root, None, CFG, scope=F.lit(True))  # removed
    stored = index.read_index(spark, root)
    order = {r.doc_key: r.ord for r in stored.chunks.collect()}
    assert len(order) == len(TEXTS) - 2
    # changed documents have moved behind the others
    assert sorted(order, key=order.get) == ["d1", "d5", "d7", "d2", "d4", "d6"]
    moved = left.drop("ord").join(stored.chunks.select("doc_key", "ord"), "doc_key")
    assert indexed(spark, root, asked) == searched(asked, moved)
    fresh = {r.token: r.df for r in bm25.vocabulary(left)[0].collect()}
    assert {r.token: r.df for r in stored.document_frequency.collect()} == fresh
    assert index.read_index(spark, root, 0).topk(asked, 3, CFG).count() == len(old)  # earlier states stay readable
    index.compact(spark, root)
    assert len(index.read_index(spark, root).manifest["segments"]) == 1
    assert indexed(spark, root, asked) == searched(asked, moved)


def test_failed_writes_leave_the_old_state(spark, docs, asked, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    rows = chunk_rows(docs)
    index.publish(rows.filter("ord < 4"), root, None, CFG)
    before = indexed(spark, root, asked)

    def fails(*_):
        raise OSError("disk full")

    # the third of the segment's tables fails: two are written, none counts
    monkeypatch.setattr(index, "document_frequency", fails)
    with pytest.raises(OSError):
        index.publish(rows, root, "again", CFG)
    monkeypatch.undo()
    assert indexed(spark, root, asked) == before
    index.publish(rows, root, "again", CFG)
    assert indexed(spark, root, asked) == searched(asked, docs)


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    log = snapshots.SnapshotLog(spark, str(tmp_path / "log"))
    first = log.publish({"n": 1}, None)
    second = log.publish({"n": 2}, first)
    with pytest.raises(snapshots.Conflict):
        log.publish({"n": 3}, first)
    assert log.read() == second == {"n": 2, "version": 1} and log.read(0)["n"] == 1


def test_bounds_skip_ranges_and_change_nothing(spark, tmp_path):
    """Documents with the asked words close together lie in a few ranges; others only have a
    frequent word, and their ranges are not scored."""
    rng = random.Random(4)
    texts = [f"common w{rng.randrange(50)} w{rng.randrange(50)}" for _ in range(400)]
    for k in (17, 18, 19, 203, 204, 390):
        texts[k] = "rare words common"
    rows = spark.createDataFrame([(f"d{k}", k, t) for k, t in enumerate(texts)], "doc_key string, ord long, content string")
    cfg = CFG.replace(posting_range=10, first_ranges=1, index_buckets=4)
    root = str(tmp_path / "index")
    index.publish(chunk_rows(rows), root, None, cfg)
    asked = spark.createDataFrame([("a", "rare words"), ("b", "common w7 rare"), ("c", "absent")], "query_id string, query string")
    stored, scan = index.read_index(spark, root), []
    assert indexed(spark, root, asked, 3, cfg) == searched(asked, rows)
    stored.scores(asked, 3, cfg, scan=scan).count()
    assert scan[1] < scan[0] / 4
    few = spark.createDataFrame([("w7",)], "token string")
    names = stored.postings(few, cfg).inputFiles()
    assert names and len(names) < len(stored.postings(None, cfg).inputFiles())
    plan = stored.scores(asked, 3, cfg)._jdf.queryExecution().toString()
    assert "content" not in plan
    also = spark.createDataFrame([("b", 5), ("c", 5)], "query_id string, ord long")
    wanted = {(r.query_id, r.ord) for r in stored.scores(asked, 1, cfg, also=also).collect()}
    assert ("b", 5) in wanted and ("c", 5) not in wanted


def test_hybrid_by_index_is_hybrid_by_scan(spark, docs, asked, tmp_path):
    root = str(tmp_path / "index")
    index.publish(chunk_rows(docs), root, None, CFG)
    stored = index.read_index(spark, root)
    queries = asked.withColumn("embedding", embed_text(F.col("query"), CFG.embedding_dim))
    ways = [hybrid.hybrid_topk(queries, stored.chunks, 2, CFG, i).collect() for i in (None, stored)]
    a, b = (sorted((r.query_id, r.rank, r.doc_key, r.score) for r in w) for w in ways)
    assert a == b and a


def test_positions_are_dense(spark):
    rows = spark.range(0, 1000, 1, 7).withColumn("key", F.xxhash64("id"))
    got = ordering.with_positions(rows, "key").orderBy("key").collect()
    assert [r.ord for r in got] == list(range(1000))


def test_hot_word_does_not_shuffle_by_word(docs, asked):
    plan = bm25.bm25_topk(asked, docs, 3, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("held", [4_000_000, 40])
def test_words_are_listed_where_texts_are_read(spark, monkeypatch, held):
    monkeypatch.setattr(postings, "WORDS_HELD", held)
    rng = random.Random(2)
    texts = {k: " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))) for k in range(60)}
    texts |= {60: None, 61: "W1 w1"}
    docs = spark.createDataFrame(list(texts.items()), "ord long, content string").coalesce(2)
    built = postings.build_postings(docs, CFG.replace(posting_range=16))
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    found, rows = {}, built.collect()
    for r in rows:
        assert r.n == len(r.places) == len(r.tfs) == len(r.lens) and list(r.places) == sorted(r.places)
        assert (r.max_tf, r.min_len) == (max(r.tfs), min(r.lens))
        for place, tf, n in zip(r.places, r.tfs, r.lens):
            assert found.setdefault((r.token, r.range * 16 + place), (tf, n)) == (tf, n)
    said = {k: (t or "").lower().split() for k, t in texts.items()}
    assert found == {(w, k): (t.count(w), len(t)) for k, t in said.items() for w in t}
    assert len(rows) >= len({(r.token, r.range) for r in rows}) and len(found) == sum(r.n for r in rows)


def test_index_keeps_no_copies_and_moves_no_texts_for_a_few_changes(spark, docs, asked, tmp_path, monkeypatch):
    root, cfg = str(tmp_path / "index"), CFG.replace(broadcast_max_rows=2)
    index.publish(chunk_rows(docs), root, None, cfg)
    changed = F.when(F.col("ord") == 2, F.concat("content", F.lit(" cash"))).otherwise(F.col("content"))
    state = chunk_rows(docs.filter("ord <> 3").withColumn("content", changed))
    positions, plans = index.with_positions, []

    def planned(rows, *order, **more):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return positions(rows, *order, **more)

    monkeypatch.setattr(index, "with_positions", planned)
    index.publish(state, root, None, cfg, scope=F.lit(True))
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0] and "hashpartitioning" not in plans[0]
    moved = docs.filter("ord <> 3").withColumn("content", changed)
    order = index.read_index(spark, root).chunks.select("doc_key", "ord")
    assert indexed(spark, root, asked) == searched(asked, moved.drop("ord").join(order, "doc_key"))
    assert index.SnapshotLog(spark, root).children("_staged") == []


def test_a_state_without_new_chunks_is_not_read_for_its_segment(spark, docs, tmp_path, monkeypatch):
    root, staged = str(tmp_path / "index"), []
    index.publish(chunk_rows(docs), root, None, CFG)
    positions = index.with_positions

    def planned(rows, *order, **more):
        staged.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return positions(rows, *order, **more)

    monkeypatch.setattr(index, "with_positions", planned)
    index.publish(chunk_rows(docs.filter("ord <> 3")), root, None, CFG, scope=F.lit(True))
    assert len(staged) == 1 and "LogicalRDD" not in staged[0] and "Join" not in staged[0]
    assert index.read_index(spark, root).chunks.count() == len(TEXTS) - 1


def test_chunks_without_a_key_are_new_in_any_state(spark, tmp_path):
    root, cfg = str(tmp_path / "index"), CFG.replace(broadcast_max_rows=2)
    rows = [(None if k == 4 else f"k{k}", k, f"text {k}") for k in range(5)]
    chunks = chunk_rows(spark.createDataFrame(rows, "doc_key string, ord long, content string"))
    for _ in range(2):
        index.publish(chunks, root, None, cfg)
    kept = sorted((r.ord, r.doc_key) for r in index.read_index(spark, root).chunks.collect())
    assert kept == [(0, "k0"), (1, "k1"), (2, "k2"), (3, "k3"), (4, None), (5, None)]


@pytest.mark.parametrize("most", [100, 10])
def test_chunks_by_position(spark, monkeypatch, most):
    monkeypatch.setattr(index, "BROADCAST_PLACES", most)
    chunks = spark.range(0, 99).selectExpr("id as ord", "cast(id as string) as content")
    dead = spark.createDataFrame([(0,), (63,), (64,), (98,)], "ord long")
    for inside in (True, False):
        got = {r.ord for r in index._placed_in(chunks, dead, 99, inside).collect()}
        assert got == ({0, 63, 64, 98} if inside else set(range(99)) - {0, 63, 64, 98})


def test_index_scores_are_added_up_where_postings_meet(spark, docs, asked, tmp_path):
    """Nothing is exchanged once the posting arrays are opened, also with dead positions."""
    cfg, root = CFG.replace(posting_range=3), str(tmp_path / "index")
    index.publish(chunk_rows(docs), root, None, cfg)
    left = docs.filter("ord not in (1, 7)")
    index.publish(chunk_rows(left), root, None, cfg, scope=F.lit(True))
    stored = index.read_index(spark, root)
    assert indexed(spark, root, asked, 3, cfg) == searched(asked, left)
    plan = stored.scores(asked, 3, cfg)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(range" in plan and "hashpartitioning(query_id" not in plan


def test_bm25_partitions_grow_with_corpus_and_queries(docs, asked, monkeypatch):
    before = sorted(map(tuple, bm25.bm25_scores(asked, docs, CFG).collect()))
    monkeypatch.setattr(bm25, "SCORES_HELD", 1)
    scores = bm25.bm25_scores(asked, docs, CFG)
    assert scores.rdd.getNumPartitions() == len(TEXTS) * len(QUERIES)
    assert sorted(map(tuple, scores.collect())) == before


@pytest.mark.parametrize("block", [4096, 7])
def test_earlier_similar_rows_are_counted_without_pairs(spark, block):
    """A group of like rows yields one row per row and pair of slices, with all pairs counted."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [("s", k, (base + rng.normal(size=8) * 0.05 * (k % 3)).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "scope string, id long, embedding array<double>")
    cfg = CFG.replace(query_block_rows=block)
    plain = {}
    for r in similar.similar_pairs(df, df, 0.95, cfg).filter("right_id < left_id").collect():
        plain.setdefault(r.left_id, []).append((-r.similarity, r.right_id))
    found, got = similar.similar_pairs(df, df, 0.95, cfg, earlier=True).collect(), {}
    for r in found:
        n, best = got.get(r.left_id, (0, (0, 0)))
        got[r.left_id] = (n + r.n, min(best, (-r.similarity, r.right_id)))
    assert got == {k: (len(v), min(v)) for k, v in plain.items()}
    slices = -(-60 // block)
    assert len(found) <= 60 * slices and sum(r.n for r in found) > 10 * 60
