"""Set similarity join of word shingles by size-banded tiles with bitmap signatures.

Two sets that are similar enough share a shingle among the first few of each, in any order
that all sets follow (the prefix bound). Sets that share such a shingle meet in tiles:

* The order puts shingles that many texts have last, so few sets meet in vain. It comes from
  counts over all texts and steers costs only; any order gives the same links.
* A large group is cut into bands of similar size and its bands into blocks. A tile is a
  pair of blocks of one band or of neighbouring ones; bands further apart can't be similar.
* In a tile every set has a bitmap: bit h % bits is the parity of its shingles with that
  hash. Bits in which two bitmaps differ bound the shingles that aren't common from below,
  so the overlap from above. Pairs beyond the bound go; what is left forms clusters.
* Clusters are dealt into tiles again, now with their full sorted arrays, whose exact
  intersection decides. A tile reports how many links each member has and which members
  hang together, not the pairs, so rows grow with members.

A cluster of m sets costs m * m / 2 looks at bitmaps and m / BLOCK copies of its arrays;
that is what counting every link takes. No task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import signed, written
from ledgerloom.llm.components import components
from ledgerloom.llm.shingle_sets import shingle_sets
from ledgerloom.operators.joins import join_small
from ledgerloom.session import spread

LEAST_BITS = 256
BLOCK = 512  # sets in a block
ROOM = 1 << 20  # shingles in a block
WINDOW = 4 << 20  # shingles counted at a time
OFTEN = 3  # texts of a window that have a shingle, for it to be reported as frequent
FREQUENT = 64  # reported texts from which a shingle goes last in the order
MOST_FREQUENT = 1 << 20  # shingles the order knows (12 MB); beyond it the bar above rises
BROADCAST_IDS = 200_000  # ids of 8 bytes
BROADCAST_BANDS = 100_000  # rows of 24 bytes
_KEY = ["id", "twin"]


def _prints(width: int):
    """Per text its id, its number of shingles and their fingerprint; and in the same
    columns with `token`, how many texts of a window have a frequent shingle."""

    def rows(ids, sizes, prints, tokens, counts):
        n, m = len(sizes), len(tokens)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids, pa.nulls(m, pa.int64())]),
                pa.array([*sizes, *counts], pa.int64()),
                pa.array([*prints, *[None] * m], pa.binary()),
                pa.array([*[None] * n, *tokens], pa.int64()),
            ],
            names=["id", "n", "print", "token"],
        )

    def frequent(held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= OFTEN
        nobody = pa.array([], pa.int64())
        return rows(nobody, [], [], signed(tokens[often]).tolist(), counts[often].tolist())

    def run(batches):
        held, size = [], 0
        for batch in batches:
            start = 0
            for flat, sizes in shingle_sets(batch.column(1), width):
                at = np.r_[0, np.cumsum(sizes)]
                prints = [
                    xxhash.xxh3_128_digest(flat[a:b]) if b > a else None
                    for a, b in zip(at[:-1], at[1:], strict=True)
                ]
                yield rows(batch.column(0).slice(start, len(sizes)), sizes, prints, [], [])
                start += len(sizes)
                held.append(flat)
                size += len(flat)
                if size > WINDOW:
                    yield frequent(held)
                    held, size = [], 0
        if held:
            yield frequent(held)

    return run


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in ascending order and how often they were reported. No more than
    MOST_FREQUENT: the bar is the power of two from which they fit."""
    summed = written(counts.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT))
    power = F.floor(F.log2("n")).cast("int").alias("power")
    sizes = {r.power: r["count"] for r in summed.groupBy(power).count().collect()}
    bar, kept = 0, 0
    for p in sorted(sizes, reverse=True):
        kept += sizes[p]
        if kept > MOST_FREQUENT:
            bar = 2 ** (p + 1)
            break
    found = summed.filter(F.col("n") >= bar).toPandas()
    tokens = found["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["n"].to_numpy(dtype=np.int64)[order]


def _required(n, percent: int):
    """The least number of shingles that a set of n has in common with a similar one."""
    return -(-percent * n // 100)


def _half_print(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _arrays(batch, width):
    """(ids, flat, sizes) slice by slice of a batch of texts."""
    start = 0
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for flat, sizes in shingle_sets(batch.column(1), width):
        yield ids[start : start + len(sizes)], flat, sizes
        start += len(sizes)


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: a power of two of bits, as many as shingles and LEAST_BITS at
    least, so that long sets don't look alike."""
    bits = max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(bitmaps: np.ndarray) -> np.ndarray:
    """Bitmaps (last axis) of half as many bits."""
    half = bitmaps.shape[-1] // 2
    return bitmaps[..., :half] ^ bitmaps[..., half:]


def _prefixes(width: int, percent: int, frequent):
    """Per set its first shingles in the common order, rare ones first, and its bitmap."""
    known, often = frequent.value

    def run(batches):
        for batch in batches:
            for ids, flat, sizes in _arrays(batch, width):
                at = np.r_[0, np.cumsum(sizes)]
                weight = np.zeros(len(flat), dtype=np.int64)
                if len(known) and len(flat):
                    near = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    weight = np.where(known[near] == flat, often[near], 0)
                out = ([], [], [], [])
                for k in np.flatnonzero(sizes):
                    a, b = at[k], at[k + 1]
                    first = np.argsort(weight[a:b], kind="stable")
                    first = first[: sizes[k] - _required(sizes[k], percent) + 1] + a
                    out[0].append(ids[k])
                    out[1].append(_half_print(xxhash.xxh3_128_digest(flat[a:b])))
                    out[2].append(_bitmap(flat[a:b]).tobytes())
                    out[3].append(signed(flat[first]))
                ends = pa.array(np.cumsum([0, *map(len, out[3])]).astype(np.int32))
                tokens = pa.array(np.concatenate(out[3]) if out[3] else [], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out[0], pa.int64()),
                        pa.array(out[1], pa.int64()),
                        pa.array(out[2], pa.binary()),
                        pa.ListArray.from_arrays(ends, tokens),
                    ],
                    names=["id", "half", "bits", "tokens"],
                )

    return run


def _band(n: Column, percent: int) -> Column:
    """Sets that can be similar are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(101.0 / percent))).cast("int")


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """rows (grp, id, twin, n, ...) with tile and side: copies for every tile of their group.

    A group that fits one block is one tile, of side -1. Otherwise a tile pairs blocks of
    one band or of two neighbouring ones: sides 0 and 1, or -1 for a block with itself.
    """
    rows = rows.withColumn("band", _band(F.col("n"), percent))
    bands = rows.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    bands = bands.withColumn(
        "blocks", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / ROOM)).cast("int")
    )
    bands = written(bands)
    whole = bands.groupBy("grp").agg(F.sum("m").alias("m"), F.sum("total").alias("total"))
    large = whole.filter(f"m > {BLOCK} or total > {ROOM}").select("grp")
    cut = bands.join(large, "grp", "left_semi").select("grp", "band", "blocks")
    beside = cut
    for step, name in ((1, "above"), (-1, "below")):
        other = cut.select("grp", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
        beside = beside.join(other, ["grp", "band"], "left")
    joined = join_small(rows, written(beside), ["grp", "band"], BROADCAST_BANDS, 16, _KEY, how="left")
    own = F.pmod(F.xxhash64(*_KEY), F.col("blocks")).cast("int")

    def tile(low, i, j, side, high=None):
        return F.struct(
            low.alias("low"),
            (low if high is None else high).alias("high"),
            i.alias("i"),
            j.alias("j"),
            side.cast("int").alias("side"),
        )

    band = F.col("band")

    def others(blocks):
        return F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))

    same = F.transform(
        others(F.col("blocks")),
        lambda o: tile(
            band,
            F.least(own, o),
            F.greatest(own, o),
            F.when(own == o, -1).when(own < o, 0).otherwise(1),
        ),
    )
    above = F.transform(
        others(F.coalesce("above", F.lit(0))), lambda o: tile(band, own, o, F.lit(0), band + 1)
    )
    below = F.transform(
        others(F.coalesce("below", F.lit(0))), lambda o: tile(band - 1, o, own, F.lit(1), band)
    )
    zero = F.lit(0)
    single = F.array(tile(zero, zero, zero, F.lit(-1)))
    every = F.when(F.col("blocks").isNull(), single).otherwise(F.concat(same, above, below))
    dealt = joined.withColumn("tile", F.explode(every))
    place = ["grp", *(F.col(f"tile.{c}") for c in ("low", "high", "i", "j"))]
    return dealt.select(
        F.struct(*place).alias("tile"),
        F.col("tile.side").alias("side"),
        *[c for c in rows.columns if c != "band"],
    )


def _tile_runs(batches, columns: int) -> Iterator[list[pa.Array]]:
    """Columns of whole tiles from rows sorted by tile (column 0); what a batch ends with
    waits for the next one. A tile has two blocks at most, so little ever waits."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column(0).to_numpy()
        start = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if start:
            yield [held.column(c).slice(0, start).combine_chunks() for c in range(columns)]
            held = held.slice(start)
    if held is not None and held.num_rows:
        yield [held.column(c).combine_chunks() for c in range(columns)]


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


class _Tile:
    """Members of one tile by the width of their bitmaps."""

    def __init__(self, side: np.ndarray, n: np.ndarray, bitmaps: list[np.ndarray], percent: int):
        self.side, self.n, self.bitmaps, self.percent = side, n, bitmaps, percent
        widths = np.array([len(b) for b in bitmaps])
        self.at = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
        self.of = {w: np.stack([bitmaps[k] for k in at]) for w, at in self.at.items()}
        self.half = {w: _folded(of) for w, of in self.of.items() if w // 2 in self.of}

    def partners(self, i: int) -> np.ndarray:
        """Members after i whose sizes and bitmaps leave room for enough common shingles."""
        mine = self.bitmaps[i]
        width, found = len(mine), []
        for w, own, their in (
            (width, mine, self.of),
            (2 * width, mine, self.half),
            (width // 2, _folded(mine) if width // 2 in self.of else None, self.of),
        ):
            if w not in their:
                continue
            after = np.searchsorted(self.at[w], i, "right")
            others, bits = self.at[w][after:], their[w][after:]
            n = self.n[others]
            fit = 100 * np.minimum(n, self.n[i]) >= self.percent * np.maximum(n, self.n[i])
            if self.side[i] >= 0:
                fit &= self.side[others] != self.side[i]
            others, n = others[fit], n[fit]
            apart = np.bitwise_count(bits[fit] ^ own).sum(axis=1, dtype=np.int64)
            both = n + self.n[i]
            found.append(others[100 * (both - apart) >= self.percent * (both + apart)])
        return np.concatenate(found)


def _met(percent: int):
    """Edges (a, b) that span what the bitmaps leave in each tile, from rows
    (tile, side, v, n, bits) sorted by tile."""

    def run(batches):
        for tile, side, v, n, bits in _tile_runs(batches, 5):
            side, v, n = (x.to_numpy(zero_copy_only=False) for x in (side, v, n))
            bitmaps = [np.frombuffer(b, dtype=np.uint64) for b in bits.to_pylist()]
            key = tile.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            edges = []
            for start, stop in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                here = _Tile(side[start:stop], n[start:stop], bitmaps[start:stop], percent)
                parent = list(range(stop - start))
                for i in range(len(parent) - 1):
                    for j in here.partners(i).tolist():
                        x, y = _root(parent, i), _root(parent, j)
                        if x != y:
                            parent[y] = x
                            edges.append((v[start + i], v[start + j]))
            both = np.array(edges, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"]
            )

    return run


def _sets(width: int):
    """(id, half, shingles): the sorted shingle hashes of each text as bytes."""

    def run(batches):
        for batch in batches:
            for ids, flat, sizes in _arrays(batch, width):
                at = np.r_[0, np.cumsum(sizes)]
                raw = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
                halves = [_half_print(xxhash.xxh3_128_digest(r)) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[sizes > 0], pa.int64()),
                        pa.array(halves, pa.int64()),
                        pa.array(raw, pa.binary()),
                    ],
                    names=["id", "half", "shingles"],
                )

    return run


def _linked(percent: int):
    """Links of one tile by exact intersection: each linked member with the number of texts
    that it is linked with here and the first member of its part of the tile."""

    def run(key, table):
        side, ids, twins, n, copies = (
            table.column(c).to_numpy() for c in ("side", "id", "twin", "n", "copies")
        )
        sets = [np.frombuffer(b, dtype=np.uint64) for b in table.column("shingles").to_pylist()]
        tile = _Tile(side, n, [_bitmap(s) for s in sets], percent)
        parent, links = list(range(len(ids))), np.zeros(len(ids), dtype=np.int64)
        for i in range(len(ids) - 1):
            js = tile.partners(i)
            if not len(js):
                continue
            theirs = np.concatenate([sets[j] for j in js])
            at = np.minimum(np.searchsorted(sets[i], theirs), len(sets[i]) - 1)
            ends = np.cumsum(n[js])
            common = np.add.reduceat(sets[i][at] == theirs, ends - n[js], dtype=np.int64)
            good = js[100 * common >= percent * (n[i] + n[js] - common)]
            links[i] += copies[good].sum()
            links[good] += copies[i]
            for j in good.tolist():
                parent[max(_root(parent, i), _root(parent, j))] = min(_root(parent, i), _root(parent, j))
        kept = np.flatnonzero(links)
        roots = np.array([_root(parent, int(k)) for k in kept], dtype=np.int64)
        return pa.table(
            {
                "id": pa.array(ids[kept]),
                "twin": pa.array(twins[kept]),
                "links": pa.array(links[kept]),
                "root": pa.array(ids[roots] if len(roots) else np.empty(0, np.int64)),
            }
        )

    return run


def jaccard_join(
    docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5
) -> DataFrame:
    """id, n_shingles, component_id, n_links: one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a text's set holds its distinct
    runs of `width` words, a shorter text is one run. Texts are linked where 100 * common
    shingles >= percent * all of the two; n_links counts the other rows that a row is linked
    with, equal texts among them, and component_id is the smallest id reachable. Texts that
    are null, empty or blank have no set: no links, their own id as component. Rows that
    repeat an id are one document with several texts: the component is that of all of them,
    n_shingles and n_links are the row's own. Rows without an id take no part, with component
    null and no links. Extra columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = spread(docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")))
    scanned = written(
        source.mapInArrow(_prints(width), "id long, n long, print binary, token long")
    )
    rows = scanned.filter("token is null").drop("token")
    frequent = spark.sparkContext.broadcast(_frequent(scanned.filter("token is not null")))
    usable = rows.filter("n > 0 and id is not null")
    sets = usable.groupBy("print").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")
    )
    # An id has several sets only if rows repeat it; the twin tells them apart.
    half = F.conv(F.hex(F.substring("print", 1, 8)), 16, -10).cast("long")
    several = sets.groupBy("id").agg(F.count(F.lit(1)).alias("_sets")).filter("_sets > 1")
    sets = written(
        sets.join(several, "id", "left").select(
            "print", "id", "copies", "n", half.alias("half"),
            F.when(F.col("_sets").isNull(), 0).otherwise(half).alias("twin"),
        )
    )

    first = source.filter("id is not null").mapInArrow(
        _prefixes(width, percent, frequent),
        "id long, half long, bits binary, tokens array<long>",
    )
    lead = sets.select("id", "half", "twin", "n", F.when(F.col("twin") == 0, F.col("id")).otherwise(
        F.xxhash64("id", "twin")).alias("v"))
    first = written(first.join(lead, ["id", "half"]).dropDuplicates(["id", "half"]))
    tokens = first.select(*_KEY, F.explode("tokens").alias("grp"))
    # Shingles with the very same sets say the same; one of them is enough.
    same = [F.bit_xor(F.xxhash64(*_KEY, F.lit(seed))).alias(f"_h{seed}") for seed in (1, 2)]
    shared = tokens.groupBy("grp").agg(F.count(F.lit(1)).alias("_m"), *same).filter("_m > 1")
    shared = shared.groupBy("_m", "_h1", "_h2").agg(F.min("grp").alias("grp")).select("grp")
    shared = tokens.join(shared, "grp")
    met = written(shared.join(first.select(*_KEY, "n", "v", "bits"), _KEY))
    tiles = _tiles(met, percent).select(F.xxhash64("tile").alias("tile"), "side", "v", "n", "bits")
    pairs = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(
        _met(percent), "a long, b long"
    )
    clusters = components(written(pairs.distinct()))

    member = written(
        sets.withColumn("v", F.when(F.col("twin") == 0, F.col("id")).otherwise(F.xxhash64("id", "twin")))
        .join(clusters.select(F.col("vertex").alias("v"), F.col("component").alias("grp")), "v")
        .select("grp", *_KEY, "half", "n", "copies")
    )
    wanted = written(member.select("id").distinct())
    texts = join_small(source, wanted, ["id"], BROADCAST_IDS, 1, ["id"], how="left_semi")
    arrays = texts.mapInArrow(_sets(width), "id long, half long, shingles binary")
    full = written(member.select("id", "half", "twin").join(arrays, ["id", "half"]).dropDuplicates(["id", "half"]))
    dealt = _tiles(member.drop("half"), percent)
    linked = written(
        dealt.join(full.select(*_KEY, "shingles"), _KEY)
        .groupBy("tile")
        .applyInArrow(_linked(percent), "id long, twin long, links long, root long")
    )
    links = linked.groupBy(*_KEY).agg(F.sum("links").alias("links"))
    repeated = usable.join(sets.select("print", F.col("id").alias("lead")), "print")
    repeated = repeated.join(
        usable.groupBy("id").agg(F.min("print").alias("_p"), F.max("print").alias("_q")).filter("_p <> _q"), "id"
    )
    edges = linked.select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(
        repeated.select(F.col("id").alias("a"), F.col("lead").alias("b"))
    )
    found = components(edges)
    known = (
        sets.join(links, _KEY, "left")
        .join(found.select(F.col("vertex").alias("id"), "component"), "id", "left")
        .select(
            "print",
            F.coalesce("component", "id").alias("c"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    return (
        rows.withColumn("_print", F.when(F.col("id").isNotNull(), F.col("print")))
        .join(known.withColumnRenamed("print", "_print"), "_print", "left")
        .select(
            F.col("id").alias(id),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"),
            F.coalesce("links", F.lit(0)).alias("n_links"),
        )
    )
