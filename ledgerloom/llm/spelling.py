"""Spelling variants: words one edit apart, found with a bidirectional FM-index.

A word and a near one share the first half of the word exactly or the second half, so two
search schemes find every near word: match one half exactly, go on across the other and
allow one inserted, deleted or replaced letter on the way. The index is a pair of suffix
rank tables of the delimited vocabulary, one of the words and one of the mirrored words; a
search narrows an interval of suffix ranks letter by letter, starting at a delimiter. The
right half is matched in the first table, the left half in the mirrored one.

Halves have at least three letters, so a scheme needs to look only among words with the same
last (first) three letters: the vocabulary is dealt by them, a large group into blocks, and a
task indexes one block of words at a time and searches it for another block's words. Tasks
give back one row per word they found something for, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import ascii_lower, written
from ledgerloom.operators.joins import join_small
from ledgerloom.session import spread

RUNS = "[A-Za-zÀ-ÿ]+"
SHORTEST = 6  # code points of a word; its halves have three at least
LEAST = 5  # occurrences of a word, and how many times as often its form occurs
BLOCK = 20_000  # words indexed at a time
TOGETHER = 1_000  # words searched at a time
HALF = 3
BROADCAST_GROUPS = 200_000  # rows of 24 bytes


def vocabulary(
    docs: DataFrame, id: str = "doc_id", text: str = "text", slips: int | None = None,
    shortest: int = SHORTEST, least: int = LEAST,
) -> DataFrame:
    """word, n: the words of all whole texts and how often they occur.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of at least
    `shortest` code points and `least` occurrences. With `slips`, a run for which it divides
    the crc32 of `id:run` first loses the letter at that checksum modulo the run's length (a
    null id is empty there). Null texts have no words.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col(text).cast("string")), F.lit(RUNS), 0)
    long = F.filter(runs, lambda w: F.length(w) >= shortest)
    name = F.coalesce(F.col(id).cast("string"), F.lit(""))
    words = spread(docs.select(F.col(id), F.col(text))).select(name.alias("id"), F.explode(long).alias("word"))
    if slips is not None:
        sum_ = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (sum_ % F.length("word")).cast("int")
        cut = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
        words = words.withColumns({"sum": sum_, "at": at})
        words = words.select(F.when(F.col("sum") % slips == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= shortest) & (F.col("n") >= least))


def suffix_ranks(letters: np.ndarray, longest: int) -> np.ndarray:
    """Start of each suffix in order, by prefix doubling; a delimiter (0) ends a suffix, and
    earlier delimiters come first."""
    ends = letters == 0
    rank = letters.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    done = 1
    while True:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-done] = rank[done:] + 1
        ahead[ends] = 0  # unique already
        key = rank * (len(rank) + int(letters.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        if done > longest:
            return order
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = new
        done *= 2


class Half:
    """One of the two tables: backward search over delimited words, given as arrays of
    letters (1 and up)."""

    def __init__(self, words: list[np.ndarray]):
        sizes = np.array([len(w) for w in words])
        text = np.concatenate([np.r_[w, 0] for w in words])
        order = suffix_ranks(text, int(sizes.max()) + 1)
        self.before = text[order - 1]  # the text is a ring
        self.word = np.repeat(np.arange(len(words)), sizes + 1)[order]
        self.size = len(text)
        self.letters = np.unique(text[text > 0])
        self.delimiters = len(words)
        rows = np.argsort(self.before, kind="stable")
        self.keys = self.before[rows].astype(np.int64) * self.size + rows
        self.rows = rows

    def step(self, letter, low, high):
        """Intervals of the suffixes that have `letter` before those of the intervals."""
        base = letter.astype(np.int64) * self.size
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def letters_before(self, low, high):
        """(number of an interval, letter) for the letters that stand before its suffixes,
        or for all letters there are where the interval has more suffixes than that."""
        wide = np.flatnonzero(high - low > len(self.letters))
        every = np.repeat(wide, len(self.letters)), np.tile(self.letters, len(wide))
        slim = np.flatnonzero(high - low <= len(self.letters))
        spans = (high - low)[slim]
        of = np.repeat(slim, spans)
        row = np.arange(len(of)) - np.repeat(np.cumsum(spans) - spans, spans) + low[of]
        seen = np.unique(of * (1 << 20) + self.before[row])
        of, letter = seen >> 20, seen & ((1 << 20) - 1)
        kept = letter > 0
        return np.r_[of[kept], every[0]], np.r_[letter[kept], every[1]]

    def found(self, low, high):
        """Of intervals, which hold a whole word, and its number: a delimiter stands before."""
        at = np.searchsorted(self.keys, low)
        whole = at < np.searchsorted(self.keys, high)
        return whole, self.word[self.rows[np.minimum(at, self.size - 1)]]


def one_error(index: Half, words: np.ndarray, sizes: np.ndarray, exact: np.ndarray):
    """(query, number of a word in the index) for every word with exactly one edit beyond the
    last `exact` letters of the query. `words` are the queries' letters, one row each, padded
    with 0 in front."""
    n, width = words.shape
    query = np.arange(n)
    low, high = np.zeros(n, np.int64), np.full(n, index.delimiters, np.int64)
    # Open branches: (query, letters taken from its end, interval); clean ones have no edit yet.
    taken = np.zeros(n, np.int64)
    found_q, found_w = [], []
    edited = [np.empty(0, np.int64)] * 4

    def letter(q, t):
        return words[q, width - 1 - t]

    while len(query) or len(edited[0]):
        # Branches with their edit behind them go on exactly; those at the end may be words.
        q, t, lo, hi = edited
        over = t == sizes[q]
        whole, word = index.found(lo[over], hi[over])
        found_q.append(q[over][whole])
        found_w.append(word[whole])
        q, t, lo, hi = q[~over], t[~over], lo[~over], hi[~over]
        lo, hi = index.step(letter(q, t), lo, hi)
        alive = lo < hi
        edited = [x[alive] for x in (q, t + 1, lo, hi)]
        # Clean branches beyond their exact half fork into every edit.
        fork = taken >= exact[query]
        q, t, lo, hi = (x[fork] for x in (query, taken, low, high))
        more = t < sizes[q]
        edited = [np.r_[a, b] for a, b in zip(edited, (q[more], t[more] + 1, lo[more], hi[more]), strict=True)]
        of, other = index.letters_before(lo, hi)
        l2, h2 = index.step(other, lo[of], hi[of])
        alive = l2 < h2
        of, other, l2, h2 = of[alive], other[alive], l2[alive], h2[alive]
        edited = [np.r_[a, b] for a, b in zip(edited, (q[of], t[of], l2, h2), strict=True)]  # inserted
        swap = more[of]
        swap[swap] = letter(q[of[swap]], t[of[swap]]) != other[swap]
        replaced = (q[of[swap]], t[of[swap]] + 1, l2[swap], h2[swap])
        edited = [np.r_[a, b] for a, b in zip(edited, replaced, strict=True)]
        # Clean branches take their next letter.
        go = taken < sizes[query]
        query, taken, low, high = (x[go] for x in (query, taken, low, high))
        if len(query):
            low, high = index.step(letter(query, taken), low, high)
            alive = low < high
            query, taken, low, high = query[alive], taken[alive] + 1, low[alive], high[alive]
    pairs = np.unique(np.concatenate(found_q) * np.int64(len(index.word) + 1) + np.concatenate(found_w))
    return pairs // (len(index.word) + 1), pairs % (len(index.word) + 1)


def _letters(words: list[str], mirrored: bool) -> list[np.ndarray]:
    raw = [np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) for w in words]
    return [w[::-1] for w in raw] if mirrored else raw


def _near(key, table):
    """Near words of one block's words in another block: per word their number and the most
    frequent, of a scheme: 0 matches the left half exactly, 1 the right half."""
    mirrored = key[0].as_py() == 0
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    role = table.column("role").to_numpy()  # 0: index and query, 1: index only, 2: query only
    inside, asked = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    if not len(inside) or not len(asked):
        return pa.table(
            {"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()),
             "form": pa.array([], pa.string()), "form_n": pa.array([], pa.int64())}
        )
    letters = _letters(words, mirrored)
    index = Half([letters[k] for k in inside])
    sizes = np.array([len(letters[k]) for k in asked])
    padded = np.zeros((len(asked), sizes.max()), dtype=np.int64)
    for row, k in enumerate(asked):
        padded[row, len(padded[row]) - sizes[row] :] = letters[k]
    left = sizes // 2
    exact = left if mirrored else sizes - left
    best: dict[int, list] = {}

    def note(a, b):
        mine, other = words[asked[a]], words[inside[b]]
        if not mirrored and mine[: left[a]] == other[: left[a]]:
            return  # the other scheme has it
        n = int(counts[inside[b]])
        held = best.setdefault(a, [0, -1, ""])
        held[0] += 1
        if n > held[1] or (n == held[1] and other < held[2]):
            held[1:] = n, other

    for start in range(0, len(asked), TOGETHER):
        some = slice(start, start + TOGETHER)
        q, w = one_error(index, padded[some], sizes[some], exact[some])
        for a, b in zip((q + start).tolist(), w.tolist(), strict=True):
            note(a, b)
    return pa.table(
        {
            "word": pa.array([words[asked[a]] for a in best], pa.string()),
            "n_near": pa.array([x[0] for x in best.values()], pa.int64()),
            "form": pa.array([x[2] for x in best.values()], pa.string()),
            "form_n": pa.array([x[1] for x in best.values()], pa.int64()),
        }
    )


def _block_pairs(words: DataFrame, block: int) -> DataFrame:
    """(scheme, pack, i, j, role, word, n): each word for both schemes, in every pair of
    blocks of its group; small groups share packs."""
    ends = F.array(
        F.struct(F.lit(0).alias("scheme"), F.substring("word", 1, HALF).alias("end")),
        F.struct(F.lit(1).alias("scheme"), F.expr(f"right(word, {HALF})").alias("end")),
    )
    rows = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.*")
    sizes = rows.groupBy("scheme", "end").agg(F.count(F.lit(1)).alias("m"))
    total = sizes.agg(F.max("m"), F.sum("m")).first()
    packs = max(1, -(-(total[1] or 0) // block))  # about a block of words in each
    large = written(sizes.filter(F.col("m") > block).withColumn("blocks", F.ceil(F.col("m") / block).cast("int")))
    dealt = join_small(rows, large, ["scheme", "end"], BROADCAST_GROUPS, 16, ["word"], how="left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    pack = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("end"), F.lit(packs)).cast("string"))
    dealt = dealt.select(
        "scheme", "word", "n", F.coalesce(pack, F.concat(F.lit("="), "end")).alias("pack"),
        own.alias("own"), F.coalesce("blocks", F.lit(1)).alias("blocks"),
    )
    every = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.col("own").alias("i"), o.alias("j"), F.when(o == F.col("own"), 0).otherwise(1).alias("role")),
    )
    asked = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own")),
        lambda o: F.struct(o.alias("i"), F.col("own").alias("j"), F.lit(2).alias("role")),
    )
    return dealt.select("scheme", "pack", "word", "n", F.explode(F.concat(every, asked)).alias("p")).select(
        "scheme", "pack", "p.*", "word", "n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms (word, form) ends. Forms occur several times as
    often, so ways are short and each turn doubles the steps."""
    up = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = written(
            up.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next")
        )
        up = further.select("word", "root")
        if further.filter("_next is not null").isEmpty():
            return up


def spelling_variants(words: DataFrame, times: int = LEAST, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n from distinct words (word, n) of at least six code
    points: one row per word.

    Words are near if one inserted, deleted or replaced code point makes them equal; n_near
    counts near words. A word's form is the most frequent near word (ties: the smallest in
    code-point order) if that occurs at least `times` (above 1) as often, else null; form_n
    is its count, root the end of the way along forms, the word itself if it has none. Rows
    with a null word or count are left out. Extra columns are not read; an empty table gives
    an empty result.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")).dropna())
    near = _block_pairs(words, block).groupBy("scheme", "pack", "i", "j").applyInArrow(
        _near, "word string, n_near long, form string, form_n long"
    )
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form"))
    merged = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    known = written(
        words.join(merged, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("b.form_n") >= times * F.col("n"), F.col("b")).alias("b"),
        )
    ).select("word", "n", "n_near", F.col("b.form").alias("form"), F.col("b.form_n").alias("form_n"))
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
