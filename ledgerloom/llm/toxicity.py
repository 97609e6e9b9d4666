"""Toxic passages as maximum-scoring segments of token log-odds.

Fitting counts, over a bounded sample of labelled documents, how many toxic and clean
documents hold each word; log-odds with an informative Dirichlet prior (the pooled
frequencies) weigh the words, and those that stand out become the lexicon. Any
other word costs a small constant, so a clean text drifts downwards.

Scoring finds all maximal scoring segments of a text in one left-to-right scan. The
best score of chance text grows like the logarithm of its length (an extreme-value
law); its two constants come from the clean documents of the sample and turn every
segment's score into a significance that holds for any length. The document's
probability is a logistic function of the significant segments.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import ddl
from ledgerloom.session import materialise

SAMPLE_PER_CLASS = 20_000  # labelled documents of each class that fitting reads at most
LEXICON = 50_000  # words kept at most, by the size of their z value
LEAST_DOCS = 5  # documents of the sample that must hold a word
LEAST_Z = 3.0
PRIOR_SHARE = 0.05  # weight of the pooled frequencies against the counts themselves
DRIFT = 0.08  # what a word outside the lexicon costs
SIGNIFICANT = 0.01
SCALES = tuple(0.05 * 1.15**k for k in range(30))  # tried for the extreme-value law

_NOT_WORD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
    for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_NOT_WORD).split() if text else []


@dataclass(frozen=True)
class ToxicModel:
    weights: dict[bytes, float]
    drift: float
    scale: float  # of the extreme-value law
    shift: float
    logistic: tuple[float, ...]

    def significance(self, score: float, n_words: int) -> float:
        """Nats by which a segment's score beats what a clean text of n words offers."""
        return self.scale * score - self.shift - math.log(max(n_words, 1))


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in text order.

    hits holds the positions that carry a weight; every other position scores -drift.
    A candidate remembers the running total before it and up to its end. A new
    positive word joins with the nearest earlier candidate that starts lower, if what it
    reaches is higher than that candidate's end; candidates in between go with it.
    """
    kept: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # per candidate: nearest earlier one that starts lower, -1 if none
    total, at = 0.0, 0
    for place, weight in hits:
        total -= drift * (place - at)
        at = place + 1
        before, total = total, total + weight
        if weight <= 0:
            continue
        first, last, low, high = place, place, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = lower[j]
            if j < 0 or kept[j][3] >= high:
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:], lower[j:]
        kept.append((first, last, low, high))
        lower.append(j)
    return [(a, b, high - low) for a, b, low, high in kept]


def _found(text: str | None, model: ToxicModel):
    found = plain_words(text)
    get = model.weights.get
    hits = [(i, w) for i, w in enumerate(map(get, found)) if w is not None]
    return len(found), segments(hits, model.drift)


def _features(n: int, found, model: ToxicModel) -> tuple[float, float, float]:
    nats = [model.significance(s, n) for _, _, s in found]
    best = max(nats, default=-20.0)
    above = [x for x in nats if x > 0]
    return max(best, -20.0) / 10, math.log1p(sum(above)), math.log1p(len(above))


def _sample(labels: DataFrame, id: str, label: str, per_class: int) -> DataFrame:
    """At most per_class ids of each class, chosen by hash; an id with both labels is toxic."""
    one = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(id).alias("id")
    ).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    parts = [
        one.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(per_class)
        for k in (0, 1)
    ]
    return materialise(parts[0].unionAll(parts[1]))


def _counted(batches):
    toxic, clean, texts = Counter(), Counter(), [0, 0]
    for batch in batches:
        for text, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts[flag] += 1
            (toxic if flag else clean).update(set(plain_words(text)))
    every = list(toxic.keys() | clean.keys())
    for start in range(0, len(every), 50_000):
        part = every[start : start + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.binary()),
                pa.array([toxic[w] for w in part], pa.int64()),
                pa.array([clean[w] for w in part], pa.int64()),
            ],
            names=["word", "toxic", "clean"],
        )


def _lexicon(sample: DataFrame) -> dict[bytes, float]:
    counts = materialise(
        sample.mapInArrow(_counted, "word binary, toxic long, clean long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    sums = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not sums["t"] or not sums["c"]:
        return {}
    n_t, n_c = float(sums["t"]), float(sums["c"])
    mass = PRIOR_SHARE * (n_t + n_c)
    prior = F.lit(PRIOR_SHARE) * (F.col("toxic") + F.col("clean"))
    y_t, y_c = F.col("toxic") + prior, F.col("clean") + prior
    odds_t = F.log(y_t / (F.lit(n_t + mass) - y_t))
    odds_c = F.log(y_c / (F.lit(n_c + mass) - y_c))
    weighed = (
        counts.filter(F.col("toxic") + F.col("clean") >= LEAST_DOCS)
        .select("word", (odds_t - odds_c).alias("w"), F.sqrt(1 / y_t + 1 / y_c).alias("sd"))
        .filter(F.abs(F.col("w")) >= LEAST_Z * F.col("sd"))
        .orderBy(F.desc(F.abs(F.col("w") / F.col("sd"))), "word")
        .limit(LEXICON)  # bounded, so it can be sent to every task
    )
    return {bytes(r["word"]): float(r["w"]) for r in weighed.collect()}


def _law(best: np.ndarray, lengths: np.ndarray, growth: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of the law P(best > s) = 1 - exp(-n exp(shift - scale s)) for clean texts.

    scale is where the mean of exp(scale * word score) over clean words reaches 1; growth
    holds the sums of that per clean text for each value of SCALES. shift makes the law
    agree with the share of clean texts whose best score is above their 95 % quantile.
    """
    if not len(best) or not lengths.sum():
        return SCALES[-1], 0.0
    means = growth.sum(axis=0) / lengths.sum()
    above = np.flatnonzero(means >= 1)
    scale = SCALES[int(above[0])] if len(above) else SCALES[-1]
    edge = float(np.quantile(best, 0.95))
    beyond = int((best > edge).sum()) + 1
    return scale, math.log(beyond / lengths.sum()) + scale * edge


def _fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression with a weak ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = SAMPLE_PER_CLASS,
) -> ToxicModel:
    """Learn from the labelled documents, at most per_class of each class.

    The sample bounds all that reaches the driver: the lexicon and four numbers per
    sampled document. Labels without a document, null labels and null ids are left out;
    without toxic and clean examples the model has no words and gives the rate of the
    label (0 without any).
    """
    chosen = _sample(labels, id, label, per_class)
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("text", "toxic")  # 2 x per_class ids
    sizes = {
        r["toxic"]: r["n"]
        for r in labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(label).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    base = ToxicModel(_lexicon(sample), DRIFT, 1.0, 0.0, ())
    if not base.weights:
        rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return ToxicModel({}, DRIFT, 1.0, 0.0, (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0))

    def measured(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = [_found(t, base) for t in texts]
            grown = []
            for text, (n, _) in zip(texts, rows, strict=True):
                hits = [w for w in map(base.weights.get, plain_words(text)) if w is not None]
                rest = (n - len(hits)) * np.exp(-base.drift * np.array(SCALES))
                grown.append((np.exp(np.outer(SCALES, hits)).sum(axis=1) + rest).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([[s for _, _, s in f] for _, f in rows], pa.list_(pa.float64())),
                    batch.column(1).cast(pa.int32()),
                    pa.array(grown, pa.list_(pa.float64())),
                ],
                names=["n", "scores", "toxic", "grown"],
            )

    kinds = "n long, scores array<double>, toxic int, grown array<double>"
    rows = sample.mapInArrow(measured, kinds).collect()
    clean = [r for r in rows if not r["toxic"]]
    scale, shift = _law(
        np.array([max(r["scores"], default=0.0) for r in clean]),
        np.array([r["n"] for r in clean], float),
        np.array([r["grown"] for r in clean]).reshape(len(clean), len(SCALES)),
    )
    law = ToxicModel(base.weights, DRIFT, scale, shift, ())
    x = np.array([_features(r["n"], [(0, 0, s) for s in r["scores"]], law) for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    share = {k: sizes.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return ToxicModel(base.weights, DRIFT, scale, shift, _fit_logistic(x, y, weight / weight.mean()))


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """docs plus toxicity (0 to 1) and passages: the significant toxic segments of the
    whole text as (first_word, last_word, score, p).

    Null and empty texts have no passages and get the score of a text without any.
    Input columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most LEXICON words
    base = docs.drop("toxicity", "passages")
    passage = pa.struct(
        [("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]
    )

    def run(batches):
        known = shared.value
        beta = known.logistic
        for batch in batches:
            scores, spans = [], []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                n, found = _found(value, known)
                x = _features(n, found, known)
                z = beta[0] + sum(b * v for b, v in zip(beta[1:], x, strict=True))
                scores.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
                marked = []
                for a, b, s in found:
                    p = -math.expm1(-math.exp(min(-known.significance(s, n), 30.0)))
                    if p <= SIGNIFICANT:
                        marked.append({"first_word": a, "last_word": b, "score": s, "p": p})
                spans.append(marked)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, pa.list_(passage))],
                names=[*batch.schema.names, "toxicity", "passages"],
            )

    spans = "array<struct<first_word:int,last_word:int,score:double,p:double>>"
    return base.mapInArrow(run, ddl(base, f"toxicity double, passages {spans}"))
