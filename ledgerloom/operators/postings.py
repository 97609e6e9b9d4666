"""An inverted index by word, and BM25 over it that skips what cannot reach the top.

Postings of a word are cut at fixed ranges of index positions, the same for all words, and
lie in folders by a hash of the word. A row holds a word's postings of a range, or a part of it, as arrays
(positions from the start of the range, which pack into few bits, counts, lengths) with their
number, the largest count and the shortest length, which bound the weight of each of them.

A search reads the folders of the asked words only. From the bounds alone it adds up what a
document of a range can score at most, scores the most promising ranges of each query in
full, and then only those ranges that can still beat the k-th score found. Texts are not
read, and what moves are rows of the asked words: those of a range meet in one partition,
where they are opened and added up, so no row per posting and query ever moves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.operators.bm25 import inverse_frequency, query_terms, term_weight, tokenised
from ledgerloom.operators.joins import fits, join_small
from ledgerloom.session import materialise

_KEY = ["query_id", "range"]
RANGE_ROWS = 2_000_000  # pairs of a query and a range, of some 20 bytes, that are broadcast
WORDS_HELD = 4_000_000  # words that a task lists at once
ROWS_OUT = 20_000
CODEC = "zstd"
POSTINGS = (
    "token string, range long, n int, max_tf int, min_len int,"
    " places array<int>, tfs array<int>, lens array<int>"
)


def bucket_of(token: Column, cfg: EngineConfig) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(cfg.index_buckets)).cast("int")


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(ord, doc_len, words, number of words) of the rows that have words."""
    batch = batch.filter(pc.greater(pc.list_value_length(batch.column("toks")), 0))
    toks = batch.column("toks")
    return (
        batch.column("ord").to_numpy(), batch.column("doc_len").to_numpy(), toks.flatten(),
        pc.list_value_length(toks).to_numpy(),
    )


def _grouped(held: list, span: int) -> Iterator[pa.RecordBatch]:
    """The posting rows of some documents."""
    ords, lens, sizes = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3))
    words = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
    by_place = np.argsort(ords, kind="stable")
    place_of = np.empty(len(ords), dtype=np.int64)
    place_of[by_place] = np.arange(len(ords))
    ords, lens = ords[by_place], lens[by_place]
    said = words.indices.to_numpy().astype(np.int64) * len(ords) + np.repeat(place_of, sizes)
    said, tfs = np.unique(said, return_counts=True)
    code, row = np.divmod(said, len(ords))
    ranges = (ords // span)[row]
    starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (ranges[1:] != ranges[:-1])]))
    offsets = np.append(starts, len(said))
    lists = {"places": (ords % span)[row], "tfs": tfs, "lens": lens[row]}
    for i in range(0, len(starts), ROWS_OUT):
        some = starts[i : i + ROWS_OUT]
        cut = slice(some[0], offsets[min(i + ROWS_OUT, len(starts))])
        bounds = pa.array(np.append(some, cut.stop) - cut.start, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                words.dictionary.take(pa.array(code[some])),
                pa.array(ranges[some], pa.int64()),
                pa.array(np.diff(bounds.to_numpy()), pa.int32()),
                pa.array(np.maximum.reduceat(tfs[cut], some - cut.start), pa.int32()),
                pa.array(np.minimum.reduceat(lens[row[cut]], some - cut.start), pa.int32()),
                *(pa.ListArray.from_arrays(bounds, pa.array(x[cut], pa.int32())) for x in lists.values()),
            ],
            names=["token", "range", "n", "max_tf", "min_len", *lists],
        )


def _listed(span: int):
    """Posting rows out of (ord, doc_len, toks): those of a range are put together as far as it
    comes in one piece, and of no more words than may be held."""

    def run(batches):
        held, words, last = [], 0, None
        for batch in batches:
            ords, lens, said, sizes = _opened(batch)
            begins = np.concatenate([[0], np.cumsum(sizes)])
            full = begins // WORDS_HELD
            new = (ords[1:] // span != ords[:-1] // span) | (full[1:-1] != full[:-2])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(ords)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if held and (words >= WORDS_HELD or (words >= WORDS_HELD // 4 and ords[i] // span != last)):
                    yield from _grouped(held, span)
                    held, words = [], 0
                held.append((ords[i:j], lens[i:j], said.slice(begins[i], begins[j] - begins[i]), sizes[i:j]))
                words, last = words + int(begins[j] - begins[i]), ords[i] // span
        if held:
            yield from _grouped(held, span)

    return run


def build_postings(chunks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(bucket, token, range, n, max_tf, min_len, places, tfs, lens) of (ord, content).

    Words are counted and listed in the tasks that read the texts, so no word moves. A range
    that lies in several tasks has a row of a word in each.
    """
    toks = tokenised(chunks.withColumn("doc_key", F.lit(None)).withColumn("ord", F.col("ord").cast("long")))
    listed = toks.select("ord", "doc_len", "toks").mapInArrow(_listed(cfg.posting_range), POSTINGS)
    return listed.select(bucket_of(F.col("token"), cfg).alias("bucket"), "*")


def write_postings(postings: DataFrame, path: str) -> None:
    """Each task writes its rows to the folders of their buckets."""
    rows = postings.sortWithinPartitions("bucket", "token", "range")
    rows.write.partitionBy("bucket").parquet(path, compression=CODEC)


def word_weights(
    queries: DataFrame, df: DataFrame, stats: DataFrame, cfg: EngineConfig
) -> DataFrame:
    """(query_id, token, weight): the query's words with count times inverse frequency."""
    idf = inverse_frequency(df, stats.select("n_docs").scalar(), cfg.bm25_epsilon)
    wanted = query_terms(queries)
    return join_small(
        idf, wanted, ["token"], cfg.broadcast_max_rows, cfg.salt_buckets, ["token"]
    ).select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))


def _decoded(rows: DataFrame) -> DataFrame:
    """One row per posting: query_id, weight, range, place, tf, doc_len."""
    zipped = F.arrays_zip(
        F.col("places").alias("place"), F.col("tfs").alias("tf"), F.col("lens").alias("doc_len")
    )
    exploded_ = rows.select("query_id", "weight", "range", F.explode(zipped).alias("p"))
    return exploded_.select("query_id", "weight", "range", "p.place", "p.tf", "p.doc_len")


def dead_flags(dead: DataFrame, cfg: EngineConfig) -> DataFrame:
    """(range, flags) of positions (ord): per range one bit per position, 64 to a number."""
    span = cfg.posting_range
    place = F.pmod("ord", F.lit(span))
    bits = (
        dead.select(F.floor(F.col("ord") / span).cast("long").alias("range"), place.cast("int").alias("place"))
        .withColumn("at", F.floor(F.col("place") / 64).cast("int"))
        .groupBy("range", "at")
        .agg(F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits"))
    )
    kept = F.map_from_entries(F.collect_list(F.struct("at", "bits")))
    every = F.sequence(F.lit(0), F.lit((span - 1) // 64))
    return bits.groupBy("range").agg(kept.alias("kept")).select(
        "range",
        F.transform(every, lambda at: F.coalesce(F.try_element_at("kept", at), F.lit(0).cast("long"))).alias("flags"),
    )


def has_flag(flags: str, place: Column) -> Column:
    word = F.get(flags, F.floor(place / F.lit(64)).cast("int"))
    return F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0


def _placed(postings: DataFrame, words: DataFrame, dead: DataFrame | None, ranges: int, cfg: EngineConfig) -> DataFrame:
    """(token, range, places, tfs, lens) of the asked words, all words of a range in one
    partition and without dead positions. What moves are the arrays, once each however many
    queries ask for the word."""
    wanted = join_small(
        postings.select("token", "range", "places", "tfs", "lens"), words, ["token"],
        cfg.broadcast_max_rows, cfg.salt_buckets, ["range"], how="left_semi",
    )
    placed = wanted.repartition(ranges, "range")
    if dead is None:
        return placed
    flags = dead_flags(dead, cfg).repartition(ranges, "range")
    marked = placed.join(flags.hint("shuffle_hash"), "range", "left")

    alive = F.transform("places", lambda place: ~has_flag("flags", place))
    cut = [F.filter(c, lambda x, i: F.get("alive", i)).alias(c) for c in ("places", "tfs", "lens")]
    whole = [F.when(F.col("flags").isNull(), F.col(c)).otherwise(x).alias(c) for c, x in zip(("places", "tfs", "lens"), cut, strict=True)]
    return marked.withColumn("alive", alive).select("token", "range", *whole)


def indexed_scores(
    queries: DataFrame,
    postings: DataFrame,
    df: DataFrame,
    stats: DataFrame,
    k: int,
    cfg: EngineConfig,
    dead: DataFrame | None = None,
    also: DataFrame | None = None,
    scan: Sequence[int] | None = None,
) -> DataFrame:
    """(query_id, ord, bm25) of at least the k best documents per query and of those in
    `also` (query_id, ord) that share a word with it; scores are exact.

    postings need no bucket column; `dead` lists positions (ord) that no longer count.
    `scan` receives the number of candidate and of scored ranges, if it is a list.
    """
    weights = materialise(word_weights(queries, df, stats, cfg))
    small = fits(weights, cfg.broadcast_max_rows)
    avg_len = stats.select("avg_len").scalar()
    hits = join_small(
        postings, weights, ["token"], cfg.broadcast_max_rows, cfg.salt_buckets, ["range"], known_small=small
    )
    # What one document of the range can get at most; a negative weight is avoided by
    # documents without the word.
    most = F.greatest(
        F.lit(0.0),
        F.col("weight") * term_weight(F.col("max_tf"), F.col("min_len"), avg_len, cfg),
    )
    step = 10.0**-cfg.score_scale
    bounds = materialise(
        hits.groupBy(*_KEY).agg((F.sum(most) + F.lit(step)).alias("most"), F.sum("n").alias("postings"))
    )

    n_ranges = max(1, bounds.select("range").distinct().count())
    words = weights.select("token").distinct()
    by_range = _placed(postings, words, dead, n_ranges, cfg)

    def scored(ranges: DataFrame) -> DataFrame:
        # All postings of a range are in one partition, so the sums need no further exchange.
        asked = join_small(
            by_range, weights, ["token"], cfg.broadcast_max_rows, cfg.salt_buckets, ["range"], known_small=small
        )
        picked = join_small(asked, ranges.select(*_KEY), _KEY, RANGE_ROWS, 1, ["range"], how="left_semi")
        part = F.col("weight") * term_weight(F.col("tf"), F.col("doc_len"), avg_len, cfg)
        return (
            _decoded(picked)
            .groupBy("query_id", "range", "place")
            .agg(F.round(F.sum(part), cfg.score_scale).alias("bm25"))
            .select("query_id", (F.col("range") * cfg.posting_range + F.col("place")).alias("ord"), "bm25")
        )

    # The most promising ranges first: enough of them to hold k documents.
    order = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "range")
    ranked = bounds.withColumn("_place", F.row_number().over(order))
    first = materialise(ranked.filter(F.col("_place") <= cfg.first_ranges).drop("_place"))
    begun = materialise(scored(first))
    best = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "ord")
    bar = (
        begun.withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") == k)
        .select("query_id", F.col("bm25").alias("bar"))
    )
    open_ = bounds.join(bar, "query_id", "left").filter(F.col("bar").isNull() | (F.col("most") >= F.col("bar")))
    if also is not None:
        place = F.floor(F.col("ord") / cfg.posting_range).cast("long").alias("range")
        asked = also.select("query_id", place).distinct()
        open_ = open_.select(*_KEY).unionAll(bounds.join(asked, _KEY).select(*_KEY)).distinct()
    rest = materialise(open_.select(*_KEY).join(first.select(*_KEY), _KEY, "left_anti"))
    if isinstance(scan, list):
        scan += [bounds.count(), first.count() + rest.count()]
    return begun.unionAll(scored(rest))
