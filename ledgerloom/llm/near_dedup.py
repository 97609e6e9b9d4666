"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Independent trees branch on it:
a node picks one or two of the set's minwise tokens (by the node's own hash, so all
its members agree; 1 / similarity of them on average, which keeps a pair at the
threshold alive at any depth), and the picked values name its children. Similar sets
meet in common nodes, unlike sets part early.

* Equal sets are one vertex from the start, however many documents have them.
* First, a few rounds hold every member of the top nodes against one leader of them, which
  links large groups of near copies at the cost of a pair per member. They go on while the
  large nodes shrink, and each depth has such a round of its own. A node whose members are
  then all linked to each other has nothing left to say and is dropped.
* Nodes with few members compare all of them. In a large node whose members are linked but
  for a few, those few are held against all others in blocks: members that are linked
  already needn't meet, and the rows don't grow with the square of a group.
* Larger ones branch on. What is still large at the last depth is compared in blocks, so
  nothing is cut.

Pairs pass a test on one-bit minwise sketches, in small nodes another on their smallest
hashes (both 4.8 standard deviations below the threshold), then full sets decide. Links
become components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import mix, shingle_hashes, signed, word_hashes, written
from ledgerloom.llm.components import components
from ledgerloom.operators.joins import join_small
from ledgerloom.session import materialise

TOKENS = 128  # minwise tokens per set
TREES = 16
LEAF = 512
BOTTOM = 256  # smallest hashes of a set that small nodes compare
STARS = 3  # rounds at least in which every member meets one other of its nodes
SHRINK = 0.875  # rounds go on while the members of large nodes fall below this share
DEPTH = 24
BROADCAST_IDS = 200_000  # ids of 8 bytes
_CHUNK = 1024  # shingles ranked at a time

_FACTORS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_ROOM = np.empty((TOKENS, _CHUNK), dtype=np.uint32)  # reused: fresh pages would cost more


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The set's minwise tokens under TOKENS orders: folded hashes of the chosen shingles."""
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    lowest = np.full(TOKENS, np.iinfo(np.uint32).max, dtype=np.uint32)
    chosen = np.zeros(TOKENS, dtype=np.uint64)
    every = np.arange(TOKENS)
    for start in range(0, len(keys), _CHUNK):
        part = keys[start : start + _CHUNK]
        ranks = np.multiply(_FACTORS[:, None], part, out=_ROOM[:, : len(part)])
        at = ranks.argmin(axis=1)
        low = ranks[every, at]
        better = low < lowest if start else np.ones(TOKENS, dtype=bool)
        lowest[better] = low[better]
        chosen[better] = shingles[start + at[better]]
    return (mix(chosen + every.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _signed_sets(width: int):
    def run(batches):
        for batch in batches:
            counts, prints, tokens, low, high = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = np.unique(shingle_hashes(word_hashes(text), width))
                counts.append(len(found))
                if not len(found):
                    prints.append(None), tokens.append(None), low.append(None), high.append(None)
                    continue
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketch = minwise(found)
                bits = np.packbits((sketch & np.uint32(1)).astype(np.uint8)).view(np.int64)
                tokens.append(sketch.tobytes())
                low.append(int(bits[0]))
                high.append(int(bits[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(tokens, pa.binary()),
                    pa.array(low, pa.int64()),
                    pa.array(high, pa.int64()),
                ],
                names=["id", "n", "print", "tokens", "s0", "s1"],
            )

    return run


def _picks(nodes: np.ndarray, similarity: float):
    """Token positions that each node branches on: (row numbers, positions)."""
    mean = 1.0 / similarity
    base = int(mean)
    more = (mix(nodes ^ np.uint64(0xA5A5A5A5)) >> np.uint64(11)) / float(2**53) < mean - base
    first = mix(nodes ^ np.uint64(0x51ED27)) % np.uint64(TOKENS)
    step = np.uint64(2) * (mix(nodes ^ np.uint64(0x2545F491)) % np.uint64(TOKENS // 2)) + np.uint64(1)
    rows, places = [], []
    for k in range(base + 1):
        chosen = np.arange(len(nodes)) if k < base else np.flatnonzero(more)
        rows.append(chosen)  # an odd step over a power of two never repeats a position
        places.append(((first + np.uint64(k) * step) % np.uint64(TOKENS))[chosen].astype(np.int64))
    return np.concatenate(rows), np.concatenate(places)


def _children(similarity: float, roots: np.ndarray | None):
    """(node, id, s0, s1) one depth further down from (node, id, s0, s1, tokens)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = b"".join(batch.column("tokens").to_pylist())
            tokens = np.frombuffer(joined, dtype=np.uint32).reshape(-1, TOKENS)
            if roots is not None:
                nodes = np.tile(roots, batch.num_rows)
                of = np.repeat(np.arange(batch.num_rows), len(roots))
            else:
                nodes = batch.column("node").to_numpy().view(np.uint64)
                of = np.arange(batch.num_rows)
            rows, places = _picks(nodes, similarity)
            of = of[rows]
            values = tokens[of, places].astype(np.uint64)
            nodes = mix(mix(nodes[rows] + places.astype(np.uint64)) + values)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(nodes)), *[batch.column(c).take(take) for c in ("id", "s0", "s1")]],
                names=["node", "id", "s0", "s1"],
            )

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            sets = [
                signed(np.unique(shingle_hashes(word_hashes(t), width)))
                for t in batch.column(1).to_pylist()
            ]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["id", "shingles"])

    return run


def _confirmed(pairs, docs, width, percent):
    """Those of the pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = join_small(docs, materialise(ids), ["id"], BROADCAST_IDS, 1, ["id"], how="left_semi")
    sets = materialise(texts.mapInArrow(_full_sets(width), "id long, shingles array<long>"))
    sets_a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    sets_b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(sets_a, "a").join(sets_b, "b")
    sized = both.select(
        "a",
        "b",
        F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"),
        (F.size("sa") + F.size("sb")).cast("long").alias("both"),
    )
    return sized.filter(f"100 * common >= {percent} * (both - common)").select("a", "b").distinct()


def _labelled(rows, labels):
    """rows with label: the component known so far of each id, itself if none."""
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    known = labels.select(F.col("vertex").alias("id"), F.col("component").alias("_c"))
    joined = join_small(rows, known, ["id"], BROADCAST_IDS, 1, ["id"], how="left")
    return joined.withColumn("label", F.coalesce("_c", "id")).drop("_c")


def _undecided(rows, labels, turn=0):
    """rows of nodes whose members aren't all linked yet, with the number of members, the
    one that comes first in the turn's order, the label of most members and how many have
    another one. Labels are counted before nodes, so that a node is put together from parts."""
    place = (F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))).alias("place")
    first = F.min(F.struct(place, "id", "s0", "s1", "label")).alias("lead")
    rows = _labelled(rows, labels)
    nodes = (
        rows.groupBy("node", "label")
        .agg(F.count(F.lit(1)).alias("n"), first)
        .groupBy("node")
        .agg(
            F.sum("n").alias("n"),
            F.max(F.struct("n", "label")).alias("top"),
            F.min("lead").alias("lead"),
        )
        .filter("top.n < n")
        .select("node", "n", "lead", F.col("top.label").alias("major"), (F.col("n") - F.col("top.n")).alias("rest"))
    )
    return written(rows.join(nodes, "node"))


def _star_pairs(rows, similarity):
    """Each member with one leader of its nodes, the likeliest of those it isn't linked
    with: one pair per member however large the nodes are."""
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("lead.s0"))) + F.bit_count(
        F.col("s1").bitwiseXOR(F.col("lead.s1"))
    )
    met = rows.filter(F.col("label") != F.col("lead.label")).withColumn("apart", apart)
    met = met.filter(F.col("apart") <= _most_apart(similarity))
    first = met.groupBy("id").agg(F.min(F.struct("apart", "lead.place", "lead.id")).alias("lead"))
    return first.select(
        F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")
    )


def _most_apart(similarity):
    """Bits in which the sketches of similar sets differ at most."""
    p = (1 - similarity) / 2
    return int(TOKENS * p + 4.8 * (TOKENS * p * (1 - p)) ** 0.5)


def _near_members(rows, similarity):
    """Members of small nodes whose sketch is near to that of another one they aren't linked
    with, where the two have no other node of these with a smaller number: a pair meets
    once. A list has LEAF members at most, or those of two blocks of a node; members of the
    same side above 0 meet in another block."""
    mine = rows.groupBy("id").agg(F.collect_set("node").alias("nodes"))
    member = F.struct("id", "label", "s0", "s1", "side", "nodes")
    groups = rows.join(mine, "id").groupBy("node", "block").agg(F.collect_list(member).alias("members"))

    def near(x, y):
        apart = F.bit_count(x["s0"].bitwiseXOR(y["s0"])) + F.bit_count(x["s1"].bitwiseXOR(y["s1"]))
        across = (x["side"] != y["side"]) | (x["side"] == 0)
        return (x["label"] != y["label"]) & across & (apart <= _most_apart(similarity))

    def met_before(x, y):
        earlier = F.filter(x["nodes"], lambda n: n < F.col("node"))
        return F.arrays_overlap(earlier, y["nodes"])

    kept = F.filter(
        "members", lambda x: F.exists("members", lambda y: near(x, y) & ~met_before(x, y))
    )
    listed = F.transform(
        kept, lambda x: F.struct(*[x[c].alias(c) for c in ("id", "label", "s0", "s1")])
    )
    return groups.select("node", "block", F.inline(listed))


def _bottoms(width: int):
    """(id, bottom): the BOTTOM smallest shingle hashes of each text, or all of a small set."""

    def run(batches):
        for batch in batches:
            kept = []
            for text in batch.column(1).to_pylist():
                found = np.unique(shingle_hashes(word_hashes(text), width))
                kept.append((len(found) <= BOTTOM, found[:BOTTOM].tobytes()))
            whole, raw = zip(*kept, strict=True) if kept else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(whole, pa.bool_()), pa.array(raw, pa.binary())],
                names=["id", "whole", "bottom"],
            )

    return run


def _compared(similarity: float):
    """Compare all members of a node that may be similar: (a, b) worth a look at full sets.

    Two whole sets are decided here, and what they already connect is not listed again;
    of larger sets, the hashes up to the smaller sketch's end are a fair sample.
    """
    most = _most_apart(similarity)
    floor = similarity - 4.8 * (similarity * (1 - similarity) / BOTTOM) ** 0.5

    def run(key, table):
        ids = table.column("id").to_numpy()
        labels = table.column("label").to_numpy()
        bits = [table.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")]
        whole = table.column("whole").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(b, dtype=np.uint64) for b in table.column("bottom").to_pylist()]
        _, group = np.unique(labels, return_inverse=True)
        parent = list(range(int(group.max()) + 1))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        pairs = []
        for i in range(len(ids)):
            apart = sum(np.bitwise_count(b[i + 1 :] ^ b[i]).astype(np.int32) for b in bits)
            others = i + 1 + np.flatnonzero((apart <= most) & (group[i + 1 :] != group[i]))
            pairs.append(np.column_stack([apart[others - i - 1], np.full(len(others), i), others]))
        found = []
        every = np.concatenate(pairs)
        for _, i, j in every[np.argsort(every[:, 0], kind="stable")].tolist():
            x, y = root(group[i]), root(group[j])
            if x == y or ids[i] == ids[j]:
                continue
            a, b = sets[i], sets[j]
            sure = whole[i] and whole[j]
            if not sure:
                end = min([s[-1] for s, w in ((a, whole[i]), (b, whole[j])) if not w])
                a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            common = int((b[at] == a).sum()) if len(b) else 0
            share = common / max(1, len(a) + len(b) - common)
            if share >= (similarity - 1e-9 if sure else floor):
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                if sure:
                    parent[x] = y
        both = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    return run


def _leaf_pairs(near, docs, width, similarity):
    """Pairs of the members of small nodes that have to be confirmed."""
    ids = materialise(near.select("id").distinct())
    texts = join_small(docs, ids, ["id"], BROADCAST_IDS, 1, ["id"], how="left_semi")
    sketched = texts.mapInArrow(_bottoms(width), "id long, whole boolean, bottom binary")
    joined = near.join(sketched, "id")
    return joined.groupBy("node", "block").applyInArrow(_compared(similarity), "a long, b long")


_MEMBER = ["node", "id", "s0", "s1", "label", "block", "side"]


def _whole(rows):
    """Small nodes: one block in which all members meet."""
    return rows.withColumn("block", F.lit(0).cast("long")).withColumn("side", F.lit(0)).select(*_MEMBER)


def _rest_blocks(rows, leaf):
    """Large nodes with few members outside the largest label: blocks of about `leaf` members
    of that label, and in each of them all the others."""
    blocks = F.ceil((F.col("n") - F.col("rest")) / leaf).cast("int")
    major = F.col("label") == F.col("major")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    into = F.when(major, F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))
    dealt = rows.withColumn("block", F.explode(into)).withColumn("block", F.col("block").cast("long"))
    side = F.when(major, 1).when(F.col("block") == 0, 0).otherwise(2)
    return dealt.withColumn("side", side).select(*_MEMBER)


def _blocks(rows, leaf):
    """Large nodes as pairs of blocks of about `leaf` members, so that all members meet."""
    blocks = F.ceil(F.col("n") / leaf).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    low, high = F.least("own", "other"), F.greatest("own", "other")
    block = low.cast("long") * (1 << 32) + high
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    return dealt.withColumn("block", block).withColumn("side", side).select(*_MEMBER)


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    percent: int = 75,
    width: int = 5,
    trees: int = TREES,
    leaf: int = LEAF,
    depth: int = DEPTH,
) -> DataFrame:
    """id, n_shingles, component_id, kept: one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a text's set holds its runs
    of `width` words, a shorter text is one run. Documents are linked where the
    common shingles are at least `percent` % of all; component_id is the smallest id
    reachable and kept tells that it is the row's own. Texts that are null, empty or
    blank have no set and stay alone. Rows that repeat an id are told apart by their
    sets; rows without an id get component null and are kept. Extra columns are not
    read; an empty table gives an empty result.
    """
    similarity = percent / 100
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed_rows = materialise(
        source.mapInArrow(
            _signed_sets(width), "id long, n long, print binary, tokens binary, s0 long, s1 long"
        )
    )
    sets = signed_rows.filter("n > 0 and id is not null").groupBy("print").agg(
        F.min_by(F.struct("id", "tokens", "s0", "s1"), "id").alias("s")
    )
    sets = materialise(sets.select("print", "s.*"))
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64))
    schema = "node long, id long, s0 long, s1 long"
    here = source.filter("id is not null")
    labels, edges = None, None

    def link(pairs):
        nonlocal labels, edges
        pairs = materialise(pairs.distinct())
        if pairs.isEmpty():
            return False
        linked = written(_confirmed(pairs, here, width, percent))
        if linked.isEmpty():
            return False
        edges = linked if edges is None else edges.unionAll(linked)
        labels = components(edges)
        return True

    plain = ["node", "id", "s0", "s1"]
    small = F.col("n") <= leaf
    settled = ~small & (F.col("rest") <= leaf)
    large = ~small & ~settled
    rows = sets.select("id", "s0", "s1", "tokens").mapInArrow(_children(similarity, roots), schema)
    turn, before = 0, None
    while True:
        rows = _undecided(rows.select(*plain), labels, turn)
        if turn >= STARS - 1:
            now = rows.filter(large).count()
            if turn >= STARS and (not now or now > SHRINK * before):
                break
            before = now
        link(_star_pairs(rows if turn < STARS else rows.filter(large), similarity))
        turn += 1
    compared, at = _whole(rows.filter(small)).unionAll(_rest_blocks(rows.filter(settled), leaf)), 1
    many = rows.filter(large)
    while at < depth and not many.isEmpty():
        deeper = many.select(*plain).join(sets.select("id", "tokens"), "id")
        # kept, since nodes are counted and then joined with their members
        rows = _undecided(written(deeper.mapInArrow(_children(similarity, None), schema)), labels, at)
        if link(_star_pairs(rows.filter(large), similarity)):
            rows = _undecided(rows.select(*plain), labels)
        compared = compared.unionAll(_whole(rows.filter(small))).unionAll(_rest_blocks(rows.filter(settled), leaf))
        many, at = rows.filter(large), at + 1
    compared = compared.unionAll(_blocks(many, leaf))
    near = materialise(_near_members(compared, similarity))
    link(_leaf_pairs(near, here, width, similarity))
    known = _labelled(sets.select("print", "id"), labels).select("print", F.col("label").alias("c"))
    return (
        signed_rows.select("id", "n", "print")
        .join(known, "print", "left")
        .select(
            F.col("id").alias(id),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(True)).alias("kept"),
        )
    )
