"""N-gram language-model scores from a weighted backoff automaton.

States are histories, an arc is a token that was seen after the history and carries its
smoothed log-probability, and a failure arc leads to the next shorter history at the
price of the mass that smoothing set aside. Probabilities are smoothed with Dirichlet
priors: (count + strength * shorter) / (history + strength), so a token that was not
seen costs strength / (history + strength) times its shorter probability, which is
just what the failure arc weighs. A text is read once from left to right: from the state an
arc for the token leads on, or failure arcs lead down until there is one; the weights on the
way add up. The strength is the one of STRENGTHS under which the training tokens, each left
out of the counts in turn, are likeliest.

The model grows with the corpus and is never in one place. Documents lie in blocks; a
block sends each n-gram that it holds once, with its count, to the bucket of the
n-gram's hash; the bucket adds up and answers every block in the order it asked. A block
thus gets the part of the automaton that its texts can reach, builds it and reads its texts,
all of them side by side, long ones in segments that begin with the tokens of one history. Texts are shuffled once (both steps read the same exchange), n-grams
once, and answers once, as packed arrays. Only the number of tokens and of distinct
words is known beforehand, from a first pass that moves each task's distinct words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import mix, word_hashes
from ledgerloom.session import materialise

_HELD = 4_000_000  # hashes that a task of the first pass holds at most, about
BLOCK_BYTES = 8 << 20  # text of a block; more saves shuffle, less saves memory
STRENGTHS = (2.0, 8.0, 32.0, 128.0, 512.0, 2048.0)
_BEGIN, _END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4A1B2C3D5)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TOGETHER = 100_000  # arcs weighed at a time
SEGMENT = 256  # tokens of a text that are read in a row


def _tokens(texts: list[str | None]):
    """(token hashes of all texts, each with its end, and the start of every text)."""
    parts = []
    for text in texts:
        parts += [word_hashes(text), np.array([_END], dtype=np.uint64)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64).reshape(-1, 2).sum(axis=1)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def _grams(tokens: np.ndarray, bounds: np.ndarray, order: int):
    """Per level 1 to order: (places whose n-gram exists, its hashes there)."""
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    level = mix(tokens)
    found = [(np.arange(len(tokens)), level)]
    for n in range(2, order + 1):
        before = np.empty_like(level)
        before[1:] = level[:-1]
        before[place == 0] = _BEGIN
        level = mix(before * _FACTOR + tokens + np.uint64(n))
        found.append((np.flatnonzero(place >= n - 2), level))
    return [(at, hashes[at]) for at, hashes in found]


def _edges(buckets: int) -> np.ndarray:
    """Smallest hash of each bucket but the first; buckets are ranges of hashes."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)


def _packed(hashes: np.ndarray) -> bytes:
    """Ascending hashes as first value and steps, in six bytes each where that is enough."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    if len(steps) > 1 and steps[1:].max() < np.uint64(1 << 48):
        short = np.ascontiguousarray(steps[1:]).view(np.uint8).reshape(-1, 8)[:, :6]
        return b"s" + steps[:1].tobytes() + short.tobytes()
    return b"l" + steps.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    first = np.frombuffer(packed[1:9], dtype=np.uint64)
    if packed[:1] == b"s":
        wide = np.zeros(((len(packed) - 9) // 6, 8), dtype=np.uint8)
        wide[:, :6] = np.frombuffer(packed[9:], dtype=np.uint8).reshape(-1, 6)
        steps = np.concatenate([first, wide.reshape(-1).view(np.uint64)])
    else:
        steps = np.frombuffer(packed[1:], dtype=np.uint64)
    return np.cumsum(steps, dtype=np.uint64)


def _distinct_words(buckets: int):
    """(bucket, hashes, tokens): the distinct tokens of a task's learning texts."""
    edges = _edges(buckets)

    def emit(parts, n):
        words = np.unique(np.concatenate(parts))
        cuts = [0, *np.searchsorted(words, edges).tolist(), len(words)]
        rows = [(k, _packed(words[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        ks, packed = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ks, pa.int32()),
                pa.array(packed, pa.binary()),
                pa.array([n] + [0] * (len(rows) - 1), pa.int64()),
            ],
            names=["bucket", "hashes", "tokens"],
        )

    def run(batches):
        parts, n, held = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(start, 512).to_pylist()
                tokens, _ = _tokens(texts)
                n += len(tokens)
                parts.append(np.unique(mix(tokens)))
                held += len(parts[-1])
                if held > _HELD:
                    parts = [np.unique(np.concatenate(parts))]
                    held = len(parts[0])
                    if held > _HELD // 2:
                        yield emit(parts, n)
                        parts, n, held = [], 0, 0
        if parts:
            yield emit(parts, n)

    return run


def _counted(key, table):
    kinds = np.unique(np.concatenate([_unpacked(h) for h in table.column("hashes").to_pylist()]))
    n = sum(table.column("tokens").to_pylist())
    return pa.table({"n": pa.array([n], pa.int64()), "v": pa.array([len(kinds)], pa.int64())})


def _requests(order: int, buckets: int):
    edges = _edges(buckets)

    def run(key, table):
        tokens, bounds = _tokens(table.column("text").to_pylist())
        learns = np.repeat(table.column("learn").to_numpy(), np.diff(bounds))
        rows = []
        for n, (at, hashes) in enumerate(_grams(tokens, bounds, order), 1):
            asked, which = np.unique(hashes, return_inverse=True)
            counts = np.bincount(which, weights=learns[at], minlength=len(asked)).astype(np.uint32)
            cuts = [0, *np.searchsorted(asked, edges).tolist(), len(asked)]
            for bucket in range(buckets):
                a, b = cuts[bucket], cuts[bucket + 1]
                if a < b:
                    packed = zlib.compress(counts[a:b].tobytes(), 1)
                    rows.append((bucket, n, _packed(asked[a:b]), packed))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        block = pa.array([key[0].as_py()] * len(rows), pa.int32())
        return pa.table([block, *columns], names=["block", "bucket", "level", "hashes", "counts"])

    return run


def _answers(key, table):
    """The sums over all blocks, to every block that asked and in its order."""
    asked = [_unpacked(h) for h in table.column("hashes").to_pylist()]
    counts = [
        np.frombuffer(zlib.decompress(c), dtype=np.uint32) for c in table.column("counts").to_pylist()
    ]
    distinct, which = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.zeros(len(distinct), dtype=np.uint64)
    np.add.at(totals, which, np.concatenate(counts).astype(np.uint64))
    packed, start = [], 0
    for part in asked:
        mine = totals[which[start : start + len(part)]]
        width = np.uint32 if mine.max(initial=0) < 1 << 32 else np.uint64
        packed.append(width().itemsize.to_bytes() + zlib.compress(mine.astype(width).tobytes(), 1))
        start += len(part)
    n = len(asked)
    return pa.table(
        {
            "to": table.column("block"),
            "bucket": pa.array([key[0].as_py()] * n, pa.int32()),
            "level": pa.array([key[1].as_py()] * n, pa.int32()),
            "counts": pa.array(packed, pa.binary()),
        }
    )


def _received(packed: bytes) -> np.ndarray:
    width = {4: np.uint32, 8: np.uint64}[packed[0]]
    return np.frombuffer(zlib.decompress(packed[1:]), dtype=width).astype(np.uint64)


def interpolated(seen: list[np.ndarray], history: list[np.ndarray], unigram: np.ndarray, strength: float):
    """log10 probability of every token by the smoothing alone, for counts that differ from
    token to token, as when each is left out of its own counts. seen[k] and history[k] are
    the counts of a token's (k+2)-gram and of its history."""
    shorter = unigram
    for count, before in zip(seen, history, strict=True):
        shorter = (count + strength * shorter) / (before + strength)
    return np.log10(shorter)


class Automaton:
    """The part of the model that some texts can reach, as arrays of states and arcs.

    State 0 is the empty history, state 1 the beginning of a text; further ones are the
    seen n-grams of up to order - 1 tokens. Arcs are sorted by (state, token). Weights are
    log10, one column per strength. Known histories have known suffixes, so a state is
    always the longest known history of what was read.
    """

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray], begins: np.ndarray,
                 texts_seen: int, bottom: float, strengths=STRENGTHS):
        """grams[n - 1]: per place the number of its n-gram (-1 if it has none), counts[n - 1]
        how often each n-gram was seen, begins: whether a text begins at the place."""
        order, kinds = len(grams), len(counts[0])
        strength = np.array(strengths)[None, :]
        states, known = [], 2
        for n in range(1, order):
            of = np.where(counts[n - 1] > 0, np.cumsum(counts[n - 1] > 0) - 1 + known, -1)
            known += int((counts[n - 1] > 0).sum())
            states.append(of)
        self.fails = np.zeros(known, dtype=np.int64)
        history = np.zeros(known)
        history[1] = texts_seen
        keys, targets, levels = [], [], []
        for n in range(1, order + 1):
            gram, count = grams[n - 1], counts[n - 1]
            place = np.zeros(len(count), dtype=np.int64)  # one place where each n-gram stands
            there = np.flatnonzero(gram >= 0)
            place[gram[there]] = there
            arcs = np.arange(len(count)) if n == 1 else np.flatnonzero(count > 0)
            at = place[arcs]
            start = np.zeros(len(arcs), dtype=np.int64)
            if n > 1:
                start = np.where(begins[at], 1, states[n - 2][grams[n - 2][at - 1]])
            keys.append(start * kinds + grams[0][at])
            if order == 1:
                targets.append(np.zeros(len(arcs), dtype=np.int64))
            else:
                last = min(n, order - 1)
                targets.append(np.maximum(states[last - 1][grams[last - 1][at]], 0))
            levels.append((arcs, at, start))
            if n < order:
                mine = states[n - 1][count > 0]
                history[mine] = count[count > 0]
                if n > 1:
                    self.fails[mine] = states[n - 2][grams[n - 2][place[count > 0]]]
        self.keys, self.kinds, self.order = np.concatenate(keys), kinds, order
        by_key = np.argsort(self.keys)
        self.keys = self.keys[by_key]
        self.targets = np.concatenate(targets)[by_key]
        rank = np.empty(len(by_key), dtype=np.int64)
        rank[by_key] = np.arange(len(by_key))
        self.weights = np.empty((len(rank), strength.shape[1]))
        done, below = 0, None  # below: row of the weights of each n-gram of the level before
        for n, (arcs, at, start) in enumerate(levels, 1):
            rows = rank[done : done + len(arcs)]
            for part in range(0, len(arcs), _TOGETHER):
                some = slice(part, part + _TOGETHER)
                count = counts[n - 1][arcs[some]].astype(float)[:, None]
                if n == 1:
                    odds = np.repeat((count + 1) / bottom, strength.shape[1], axis=1)
                else:
                    shorter = 10.0 ** self.weights[below[grams[n - 2][at[some]]]]
                    odds = (count + strength * shorter) / (history[start[some]][:, None] + strength)
                self.weights[rows[some]] = np.log10(odds)
            below = np.zeros(len(counts[n - 1]), dtype=np.int64)
            below[arcs] = rows
            done += len(arcs)
        self.failing = np.log10(strength / (history[:, None] + strength))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, weights) after one token each."""
        state, total = state.copy(), np.zeros((len(state), self.weights.shape[1]))
        left = np.arange(len(state))
        while len(left):
            wanted = state[left] * self.kinds + token[left]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            met = self.keys[arc] == wanted
            total[left[met]] += self.weights[arc[met]]
            state[left[met]] = self.targets[arc[met]]
            left = left[~met]
            total[left] += self.failing[state[left]]
            state[left] = self.fails[state[left]]
        return state, total

    def read(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of every text (tokens[bounds[k]:bounds[k + 1]]), per strength.

        Segments of a text are read side by side. One that doesn't begin the text first
        reads the order - 1 tokens before it, from the empty history and at no cost, which
        leaves it in the state that reading from the beginning would."""
        sizes = np.diff(bounds)
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = bounds[text] + nth * SEGMENT
        stop = np.minimum(start + SEGMENT, bounds[text + 1])
        at = np.where(nth > 0, start - (self.order - 1), start)
        state = np.where((at == bounds[text]) & (self.order > 1), 1, 0)
        sums = np.zeros((len(text), self.weights.shape[1]))
        active = np.arange(len(text))
        while len(active):
            here = at[active]
            state[active], weight = self.step(state[active], tokens[here])
            counted = here >= start[active]
            sums[active[counted]] += weight[counted]
            at[active] += 1
            active = active[at[active] < stop[active]]
        return np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0)


def _scores(order: int, tokens_seen: int, kinds: int, texts_seen: int):
    bottom = float(tokens_seen + kinds + 1)

    def run(key, answers, docs):
        tokens, bounds = _tokens(docs.column("text").to_pylist())
        learns = docs.column("learn").to_numpy()
        by_level: dict[int, list] = {}
        for level, bucket, counts in zip(
            *(answers.column(c).to_pylist() for c in ("level", "bucket", "counts")), strict=True
        ):
            by_level.setdefault(level, []).append((bucket, counts))
        per_token, grams, known = [], [], []
        for n, (at, hashes) in enumerate(_grams(tokens, bounds, order), 1):
            asked, which = np.unique(hashes, return_inverse=True)
            got = np.concatenate([_received(c) for _, c in sorted(by_level[n])])
            del by_level[n]
            if len(got) != len(asked):
                raise RuntimeError("the answers do not fit the block's n-grams")
            counts = np.zeros(len(tokens))
            counts[at] = got[which]
            per_token.append(counts)
            gram = np.full(len(tokens), -1, dtype=np.int64)
            gram[at] = which
            grams.append(gram)
            known.append(got)
        first = np.zeros(len(tokens), dtype=bool)
        first[bounds[:-1]] = True
        history = []
        for level in per_token[:-1]:
            before = np.empty_like(level)
            before[1:] = level[:-1]
            before[first] = texts_seen if not history else 0.0
            history.append(before)
        base = np.log10((per_token[0] + 1) / bottom)
        mine = np.repeat(learns, np.diff(bounds)).astype(float)
        own = (np.maximum(per_token[0] - mine, 0) + 1) / bottom
        left_seen = [np.maximum(c - mine, 0) for c in per_token[1:]]
        left_history = [np.maximum(h - mine, 0) for h in history]
        starts = bounds[:-1]
        left_out = [
            np.add.reduceat(interpolated(left_seen, left_history, own, strength), starts)
            for strength in STRENGTHS
        ]
        base, known_words = np.add.reduceat(base, starts), np.add.reduceat((per_token[0] > 0).astype(np.int64), starts)
        del per_token, history, own, mine, left_seen, left_history  # before the arcs take their room
        scores = Automaton(grams, known, first, texts_seen, bottom).read(grams[0], bounds)
        lists = pa.list_(pa.float64())
        return pa.table(
            {
                "id": docs.column("id"),
                "learn": docs.column("learn"),
                "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                "n_known": pa.array(known_words),
                "base_score": pa.array(base),
                "scores": pa.array(scores.tolist(), lists),
                "left_out": pa.array(np.array(left_out).T.tolist(), lists),
            }
        )

    return run


def score_texts(
    docs: DataFrame,
    learn: Column,
    id: str = "doc_id",
    text: str = "text",
    order: int = 2,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """id, learn, n_tokens, n_known, train_tokens, base_score, score, strength per row of docs.

    The model learns from rows where `learn` holds (null counts as true). Tokens are the
    words [^\\x20\\x09-\\x0D]+ with A-Z in lower case and one end per text. base_score sums
    log10((c + 1) / (N + V + 1)); score is the automaton's log10 probability of the
    whole text. Null and empty texts are their end alone. Repeated rows are scored alike and
    learnt from as often as they occur; extra columns are not read.
    """
    body = F.col(text).cast("string")
    rows = docs.select(
        F.col(id).alias("id"), body.alias("text"), F.coalesce(learn, F.lit(True)).alias("learn")
    )
    sums = rows.agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("bytes"),
        F.sum(F.col("learn").cast("long")).alias("texts"),
    ).first()
    blocks = max(1, -(-(sums["bytes"] or 0) // block_bytes))
    placed = rows.withColumn(
        "block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")
    )
    asked = placed.groupBy("block").applyInArrow(
        _requests(order, blocks), "block int, bucket int, level int, hashes binary, counts binary"
    )
    answered = asked.groupBy("bucket", "level").applyInArrow(
        _answers, "to int, bucket int, level int, counts binary"
    )
    whole = (
        rows.filter("learn")
        .select("text")
        .mapInArrow(_distinct_words(blocks), "bucket int, hashes binary, tokens long")
        .groupBy("bucket")
        .applyInArrow(_counted, "n long, v long")
        .agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        .first()
    )
    n, v = int(whole["n"] or 0), int(whole["v"] or 0)
    scored = materialise(
        answered.groupBy("to")
        .cogroup(placed.groupBy("block"))
        .applyInArrow(
            _scores(order, n, v, int(sums["texts"] or 0)),
            "id {}, learn boolean, n_tokens long, n_known long, base_score double, "
            "scores array<double>, left_out array<double>".format(
                docs.schema[id].dataType.simpleString()
            ),
        )
    )
    likely = scored.filter("learn").agg(
        *[F.sum(F.col("left_out")[k]).alias(str(k)) for k in range(len(STRENGTHS))]
    ).first()
    best = max(range(len(STRENGTHS)), key=lambda k: (likely[k] if likely[k] is not None else 0.0, -k))
    return scored.select(
        F.col("id").alias(id),
        "learn",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        F.col("scores")[best].alias("score"),
        F.lit(STRENGTHS[best]).alias("strength"),
    )
