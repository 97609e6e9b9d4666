"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Building starts from neighbours inside overlapping clusters around sampled pivots and then
repeats the step of NN-descent: every vector visits some of those it lists and some
that list it, whoever meets at one place is compared, and a better neighbour replaces a
worse one. Rounds end when few entries change. Lengths are evened out by one more
coordinate, so the nearest neighbour is the one with the largest inner product.

Searching keeps the best vectors found so far for each query, takes up their neighbours, and
ends when nothing better turns up. All queries step together: a step is one join with the
shards that hold the vectors and one merge per block of queries. A shard gets a query once
per step, with the list of vectors to look at, so vectors never travel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import written
from ledgerloom.llm.exact_search import choose_pivots
from ledgerloom.llm.vectors import best_rows, bucket, lists, matrix, ragged
from ledgerloom.session import materialise

NEIGHBOURS = 24
CLUSTER = 1024  # vectors of a cluster block, on average
OVERLAP = 5  # clusters that a vector is in
MOST_PIVOTS = 1024
VISITS = 12  # new and old listed vectors that one visits per round, each
ROUNDS = 3
STILL = 0.02  # share of changed entries that ends the rounds
SHARD = 4096  # vectors of a shard, on average
BEAM = 256
ENTRIES = 1024  # sampled vectors that a search starts from
STEPS = 12
QUERY_BLOCK = 64


def _evened(x: np.ndarray, top: float) -> np.ndarray:
    """x with the coordinate that makes all lengths equal."""
    rest = np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0.0))
    return np.column_stack([x, rest]).astype(np.float32)


def _clusters(pivots: np.ndarray, top: float, overlap: int):
    even = _evened(pivots, top)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            mine = _evened(x, top)
            near = np.argpartition(-(mine @ even.T), min(overlap, len(even)) - 1, axis=1)[:, :overlap]
            rows = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(near.ravel().astype(np.int32)),
                    batch.column(0).take(pa.array(rows)),
                    lists(mine[rows], pa.float32()),
                ],
                names=["pivot", "id", "x"],
            )

    return run


def _inside(k: int, shards: int):
    def run(key, table):
        ids = table.column("id").to_numpy()
        x = matrix(table.column("x"), np.float32)
        found, scores = [], []
        for start in range(0, len(ids), 512):
            near = x[start : start + 512] @ x.T
            near[np.arange(len(near)), start + np.arange(len(near))] = -np.inf
            for row in near:
                at = best_rows(row, ids, min(k, len(ids) - 1))
                found.append(ids[at])
                scores.append(row[at])
        return pa.table(
            {
                "shard": pa.array(bucket(ids, shards)),
                "id": pa.array(ids),
                "near": ragged(found, pa.int64()),
                "scores": ragged(scores, pa.float32()),
            }
        )

    return run


def _merge(k: int):
    """Nodes of a shard with the best k of what they list and what was offered to them."""

    def run(key, nodes, offers):
        ids = nodes.column("id").to_numpy()
        old = nodes.column("near").to_pylist()
        old_scores = nodes.column("scores").to_pylist()
        who = offers.column("id").to_numpy()
        sizes = np.array([len(x) for x in offers.column("near").to_pylist()], dtype=np.int64)
        flat = offers.column("near").combine_chunks().flatten().to_numpy()
        flat_scores = offers.column("scores").combine_chunks().flatten().to_numpy()
        target = np.repeat(who, sizes)
        by = np.argsort(target, kind="stable")
        target, flat, flat_scores = target[by], flat[by], flat_scores[by]
        starts = np.searchsorted(target, ids, "left")
        ends = np.searchsorted(target, ids, "right")
        near, scores, fresh, changed = [], [], [], 0
        for row in range(len(ids)):
            had = np.array(old[row], dtype=np.int64)
            new = flat[starts[row] : ends[row]]
            every = np.concatenate([had, new])
            value = np.concatenate(
                [np.array(old_scores[row], dtype=np.float32), flat_scores[starts[row] : ends[row]]]
            )
            every, first = np.unique(every, return_index=True)  # what was listed comes first
            keep = every != ids[row]
            every, value, known = every[keep], value[first][keep], (first < len(had))[keep]
            at = best_rows(value, every, k)
            near.append(every[at])
            scores.append(value[at])
            fresh.append(~known[at])
            changed += int((~known[at]).sum())
        return pa.table(
            {
                "shard": nodes.column("shard"),
                "id": nodes.column("id"),
                "x": nodes.column("x"),
                "near": ragged(near, pa.int64()),
                "scores": ragged(scores, pa.float32()),
                "fresh": ragged(fresh, pa.bool_()),
                "changed": pa.array([changed] + [0] * (len(ids) - 1), pa.int64()),
            }
        )

    return run


_NODE = "shard int, id long, x array<float>, near array<long>, scores array<float>, fresh array<boolean>, changed long"
_OFFER = "shard int, id long, near array<long>, scores array<float>"


def _visits(shards: int, k: int, seed: int):
    """A vector goes to some new and some old entries of its list; those it lists are told
    about it by the same visit, so lists and reversed lists meet at one place."""

    def run(batches):
        rng = np.random.default_rng(seed)
        for batch in batches:
            rows, hosts, news = [], [], []
            for row, (near, fresh) in enumerate(
                zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ):
                near, fresh = np.array(near, dtype=np.int64), np.array(fresh, dtype=bool)
                for flag in (True, False):
                    some = near[fresh == flag]
                    if len(some) > VISITS:
                        some = some[rng.permutation(len(some))[:VISITS]]
                    hosts.append(some)
                    rows.append(np.full(len(some), row))
                    news.append(np.full(len(some), flag))
            if not rows:
                continue
            hosts, rows, news = map(np.concatenate, (hosts, rows, news))
            scores = batch.column(4).to_pylist()
            bar = np.array([s[-1] if len(s) >= k else -np.inf for s in scores], dtype=np.float32)
            x = matrix(batch.column(3), np.float32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket(hosts, shards)),
                    pa.array(hosts),
                    batch.column(0).take(pa.array(rows)),
                    pa.array([v.tobytes() for v in x[rows].astype(np.float16)], pa.binary()),
                    pa.array(bar[rows]),
                    pa.array(news),
                ],
                names=["shard", "host", "guest", "x", "bar", "fresh"],
            )

    return run


def _meetings(shards: int):
    """Compare the guests of each host, and the host with them; offer what beats a bar."""

    def run(key, guests, hosts):
        names = ("shard", "id", "near", "scores")
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()))
        if not guests.num_rows or not hosts.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        host = guests.column("host").to_numpy()
        order = np.argsort(host, kind="stable")
        host = host[order]
        guest = guests.column("guest").to_numpy()[order]
        raw = b"".join(guests.column("x").to_pylist())
        x = np.frombuffer(raw, dtype=np.float16).reshape(len(order), -1)[order].astype(np.float32)
        bar = guests.column("bar").to_numpy(zero_copy_only=False)[order]
        fresh = guests.column("fresh").to_numpy(zero_copy_only=False)[order]
        cuts = np.flatnonzero(np.r_[True, host[1:] != host[:-1], True])
        to, of, value = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for start in range(a, b, 512):  # a popular host has its guests compared in blocks
                rows = slice(start, min(b, start + 512))
                for other in range(start, b, 512):
                    cols = slice(other, min(b, other + 512))
                    near = x[rows] @ x[cols].T
                    pair = fresh[rows][:, None] | fresh[cols][None, :]
                    pair &= guest[rows][:, None] != guest[cols][None, :]
                    for bars, turned in ((bar[rows][:, None], False), (bar[cols][None, :], True)):
                        if turned and other == start:
                            continue
                        i, j = np.nonzero(pair & (near > bars))
                        left, right = guest[rows][i], guest[cols][j]
                        to.append(right if turned else left)
                        of.append(left if turned else right)
                        value.append(near[i, j])
        to, of, value = map(np.concatenate, (to, of, value))
        by = np.argsort(to, kind="stable")
        to, of, value = to[by], of[by], value[by]
        ids, first = np.unique(to, return_index=True)
        ends = np.append(first, len(to)).astype(np.int32)
        return pa.table(
            {
                "shard": pa.array(bucket(ids, shards)),
                "id": pa.array(ids),
                "near": pa.ListArray.from_arrays(pa.array(ends), pa.array(of)),
                "scores": pa.ListArray.from_arrays(pa.array(ends), pa.array(value)),
            }
        )

    return run


def build_graph(vectors: DataFrame, neighbours: int = NEIGHBOURS) -> tuple[DataFrame, int]:
    """((shard, id, near), number of shards): the neighbours of every vector by NN-descent.

    vectors: (id long, v array<double>) of one dimension, ids distinct.
    """
    whole = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"),
    ).first()
    n, top = whole["n"], float(whole["top"] or 0.0)
    shards = max(12, -(-n // SHARD))
    wanted = min(MOST_PIVOTS, max(1, -(-n * OVERLAP // CLUSTER)))
    pivots = choose_pivots(vectors, wanted)
    near = vectors.mapInArrow(
        _clusters(pivots, top, min(OVERLAP, len(pivots))), "pivot int, id long, x array<float>"
    )
    if n == 0:
        raise ValueError("no vectors")
    sizes = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / (2 * CLUSTER)).cast("int").alias("subs"))
    blocks = near.join(F.broadcast(sizes), "pivot").withColumn(  # one row per pivot
        "sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")
    )
    offers = blocks.groupBy("pivot", "sub").applyInArrow(_inside(neighbours, shards), _OFFER)

    def seeded(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            ids = batch.column(0).to_numpy()
            none = [np.empty(0, np.int64)] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket(ids, shards)),
                    batch.column(0),
                    lists(_evened(x, top), pa.float32()),
                    ragged(none, pa.int64()),
                    ragged(none, pa.float32()),
                    ragged(none, pa.bool_()),
                    pa.array(np.zeros(len(ids), np.int64)),
                ],
                names=["shard", "id", "x", "near", "scores", "fresh", "changed"],
            )

    nodes = vectors.mapInArrow(seeded, _NODE)
    for step in range(ROUNDS + 1):
        nodes = written(
            nodes.groupBy("shard").cogroup(offers.groupBy("shard")).applyInArrow(_merge(neighbours), _NODE)
        )
        if step == ROUNDS or nodes.agg(F.sum("changed")).first()[0] <= STILL * n * neighbours:
            break
        guests = nodes.select("id", "near", "fresh", "x", "scores").mapInArrow(
            _visits(shards, neighbours, step),
            "shard int, host long, guest long, x binary, bar float, fresh boolean",
        )
        hosts = nodes.select(F.col("shard").alias("at"), F.col("id").alias("host_id"))
        offers = guests.groupBy("shard").cogroup(hosts.groupBy("at")).applyInArrow(
            _meetings(shards), _OFFER
        )
    return nodes.select("shard", "id", "near"), shards


def both_ways(graph: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, links): listed neighbours, and up to twice as many that list the vector back."""
    forth = graph.select("id", F.explode("near").alias("other"))
    back = forth.select(F.col("other").alias("id"), F.col("id").alias("other"))
    order = Window.partitionBy("id").orderBy(F.xxhash64("other"), "other")
    some = back.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= 2 * neighbours)
    every = forth.unionAll(some.select("id", "other")).groupBy("id")
    return every.agg(F.collect_set("other").alias("links"))


def _started(entry_ids: np.ndarray, entries: np.ndarray, beam: int):
    def run(batches):
        for batch in batches:
            q = matrix(batch.column(1))
            if not len(q):
                continue
            scores = q @ entries.T
            at = [best_rows(row, entry_ids, beam) for row in scores]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    ragged([entry_ids[a] for a in at], pa.int64()),
                    ragged([row[a] for row, a in zip(scores, at, strict=True)], pa.float64()),
                    ragged([np.arange(len(a)) >= 32 for a in at], pa.bool_()),
                ],
                names=["query_id", "v", "part", "ids", "scores", "done"],
            )

    return run


_STATE = "query_id long, v array<double>, part int, ids array<long>, scores array<double>, done array<boolean>"
_ASK = "shard int, query_id long, part int, v array<double>, bar double, ids array<long>"


def _asked(shards: int, expand: bool):
    """Per query and shard the vectors to look at: those whose neighbours are wanted, or
    those whose scores are."""

    def run(batches):
        for batch in batches:
            rows, at, ids, bars = [], [], [], []
            columns = batch.schema.names
            for row, wanted in enumerate(batch.column(columns.index("ask")).to_pylist()):
                wanted = np.array(wanted, dtype=np.int64)
                where = bucket(wanted, shards)
                for shard in np.unique(where):
                    rows.append(row)
                    at.append(shard)
                    ids.append(wanted[where == shard])
            pick = pa.array(rows, pa.int32())
            take = lambda name: batch.column(columns.index(name)).take(pick)
            v = take("v") if not expand else pa.array([None] * len(rows), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), take("query_id"), take("part"), v, take("bar"), ragged(ids, pa.int64())],
                names=["shard", "query_id", "part", "v", "bar", "ids"],
            )

    return run


def _neighbours_of(key, asked, nodes):
    kinds = {"query_id": pa.int64(), "part": pa.int32(), "ids": pa.list_(pa.int64())}
    if not asked.num_rows or not nodes.num_rows:
        return pa.table({n: pa.array([], k) for n, k in kinds.items()})
    ids = nodes.column("id").to_numpy()
    order = np.argsort(ids)
    links = nodes.column("links").combine_chunks()
    ends = links.offsets.to_numpy()
    flat = links.values.to_numpy()
    out = []
    for wanted in asked.column("ids").to_pylist():
        at = order[np.searchsorted(ids, wanted, sorter=order)]
        out.append(np.unique(np.concatenate([flat[ends[a] : ends[a + 1]] for a in at])))
    return pa.table(
        {"query_id": asked.column("query_id"), "part": asked.column("part"), "ids": ragged(out, pa.int64())}
    )


def _scores_of(key, asked, nodes):
    kinds = {
        "query_id": pa.int64(), "part": pa.int32(), "ids": pa.list_(pa.int64()),
        "scores": pa.list_(pa.float64()),
    }
    if not asked.num_rows or not nodes.num_rows:
        return pa.table({n: pa.array([], k) for n, k in kinds.items()})
    ids = nodes.column("id").to_numpy()
    order = np.argsort(ids)
    x = matrix(nodes.column("x"))
    q = matrix(asked.column("v"))
    out, scores = [], []
    bars = asked.column("bar").to_numpy(zero_copy_only=False)
    for row, wanted in enumerate(asked.column("ids").to_pylist()):
        at = order[np.searchsorted(ids, wanted, sorter=order)]
        score = (x[at] * q[row]).sum(axis=1)
        good = np.isnan(bars[row]) | (score > bars[row])
        out.append(np.array(wanted, dtype=np.int64)[good])
        scores.append(score[good])
    return pa.table(
        {
            "query_id": asked.column("query_id"),
            "part": asked.column("part"),
            "ids": ragged(out, pa.int64()),
            "scores": ragged(scores, pa.float64()),
        }
    )


def _by_query(table) -> dict[int, list[int]]:
    rows: dict[int, list[int]] = {}
    for row, query in enumerate(table.column("query_id").to_pylist()):
        rows.setdefault(query, []).append(row)
    return rows


def _candidates(key, states, answers):
    """The neighbours that came back, as vectors to score: those not in the beam yet."""
    mine = _by_query(answers)
    got = answers.column("ids").to_pylist()
    ask, bars = [], []
    for query, ids, scores in zip(
        *(states.column(c).to_pylist() for c in ("query_id", "ids", "scores")), strict=True
    ):
        parts = [np.array(got[r], dtype=np.int64) for r in mine.get(query, [])]
        every = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        ask.append(np.setdiff1d(every, np.array(ids, dtype=np.int64), assume_unique=True))
        bars.append(scores[-1] if len(scores) >= BEAM else None)
    return pa.table(
        {
            "query_id": states.column("query_id"),
            "part": states.column("part"),
            "v": states.column("v"),
            "bar": pa.array(bars, pa.float64()),
            "ask": ragged(ask, pa.int64()),
        }
    )


def _better(key, states, answers):
    """The beam with what beats it; newcomers have their neighbours still to be looked at."""
    mine = _by_query(answers)
    got, got_scores = answers.column("ids").to_pylist(), answers.column("scores").to_pylist()
    ids_out, scores_out, done_out = [], [], []
    for query, ids, scores in zip(
        *(states.column(c).to_pylist() for c in ("query_id", "ids", "scores")), strict=True
    ):
        rows = mine.get(query, [])
        every = np.array(ids + [i for r in rows for i in got[r]], dtype=np.int64)
        value = np.array(scores + [s for r in rows for s in got_scores[r]], dtype=np.float64)
        done = np.arange(len(every)) < len(ids)
        at = best_rows(value, every, BEAM)
        ids_out.append(every[at])
        scores_out.append(value[at])
        done_out.append(done[at])
    return pa.table(
        {
            "query_id": states.column("query_id"),
            "v": states.column("v"),
            "part": states.column("part"),
            "ids": ragged(ids_out, pa.int64()),
            "scores": ragged(scores_out, pa.float64()),
            "done": ragged(done_out, pa.bool_()),
        }
    )


def search_graph(
    vectors: DataFrame, graph: DataFrame, shards: int, queries: DataFrame, k: int
) -> DataFrame:
    """query_id, rank, vec_id, score: about the k vectors with the largest inner product.

    Greedy search from a bounded sample of entry vectors; scores are exact. A query does not
    find its own id. Ties go to the smaller id; with fewer vectors than k all that the
    search reaches are given.
    """
    sample = vectors.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(ENTRIES).collect()
    entry_ids = np.array([r["id"] for r in sample], dtype=np.int64)
    entries = np.array([r["v"] for r in sample], dtype=np.float64)
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    links = both_ways(graph)
    nodes = materialise(
        vectors.join(links, "id", "left").join(graph.select("id", "shard"), "id").select(
            "shard",
            "id",
            "v",
            F.coalesce("links", F.array().cast("array<long>")).alias("links"),
        )
    )
    begun = queries.select(
        F.col("id").alias("query_id"), "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    )
    state = materialise(begun.mapInArrow(_started(entry_ids, entries, BEAM), _STATE))
    for _ in range(STEPS):
        open_ = F.transform(
            F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"]), lambda x: x["ids"]
        )
        asking = state.withColumn("ask", open_).withColumn("bar", F.lit(None).cast("double"))
        asking = asking.filter(F.size("ask") > 0)
        if asking.isEmpty():
            break
        wanted = asking.mapInArrow(_asked(shards, True), _ASK)
        near = wanted.groupBy("shard").cogroup(
            nodes.select(F.col("shard").alias("at"), "id", "links").groupBy("at")
        ).applyInArrow(_neighbours_of, "query_id long, part int, ids array<long>")
        candidates = (
            state.groupBy("part").cogroup(near.groupBy("part"))
            .applyInArrow(
                _candidates, "query_id long, part int, v array<double>, bar double, ask array<long>"
            )
        )
        scored = candidates.mapInArrow(_asked(shards, False), _ASK).groupBy("shard").cogroup(
            nodes.select(F.col("shard").alias("at"), "id", F.col("v").alias("x")).groupBy("at")
        ).applyInArrow(_scores_of, "query_id long, part int, ids array<long>, scores array<double>")
        state = written(
            state.groupBy("part").cogroup(scored.groupBy("part")).applyInArrow(_better, _STATE)
        )
    found = state.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "hit"))
    found = found.filter(F.col("hit.ids") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("hit.scores"), "hit.ids")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        "query_id", "rank", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score")
    )


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Build the graph over all of `vectors` and search it; see search_graph for the result.

    Both hold (id long, v array<double>) as vectors.usable makes them. Rows that repeat an id
    count once (with one of their vectors); no vectors or queries give no rows.
    """
    vectors = vectors.dropDuplicates(["id"])
    if vectors.isEmpty() or queries.isEmpty():
        return queries.select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
            F.lit(0.0).alias("score"),
        ).limit(0)
    graph, shards = build_graph(vectors)
    return search_graph(vectors, graph, shards, queries.dropDuplicates(["id"]), k)
