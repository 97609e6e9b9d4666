"""Numeric verification of answers against evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.numbers import close, extract_numbers, is_year, money_numbers, unmatched
from ledgerloom.operators.joins import fits, join_hot
from ledgerloom.session import materialise

# Rollup messages.
ALL_VERIFIED = "All numbers verified"
NO_NUMBERS = "No numbers in answer"
DISABLED = "Verification disabled"
NOT_FOUND = " numbers not found in evidence"
GROUP_SLOTS = 64  # targets of a block are counted by slots of groups, which bounds each group's


def _bucket(value: Column, absolute: float, relative: float | None) -> Column:
    """Monotone bucket number, so narrow that numbers in one bucket always match:
    even steps near zero, geometric steps where the relative tolerance is wider."""
    size = F.abs(value)
    step = absolute / 2
    if relative is None:
        steps = F.floor(size / step)
    else:
        turn = absolute / relative
        growth = math.log1p(relative / 2)
        log_part = F.floor(F.lit(turn / step) + F.ln(size / turn) / F.lit(growth))
        steps = F.when(size <= turn, F.floor(size / step)).otherwise(log_part)
    return F.when(value < 0, -steps).otherwise(steps).cast("bigint")


def _reach(relative: float | None) -> int:
    """How many buckets away a match can lie."""
    if relative is None:
        return 3
    return 2 + math.ceil(-math.log1p(-relative) / math.log1p(relative / 2))


def _block(bucket: Column, reach: int) -> Column:
    """Wide block of a bucket; four reaches wide, so few buckets lie near an edge."""
    return F.floor(bucket / F.lit(4 * reach)).cast("bigint")


def _blocks(
    candidates: DataFrame, group: str, absolute: float, relative: float | None, asked: DataFrame | None
) -> DataFrame:
    """Per (group, block) the (low, high) ranges of all candidates that can match a
    target of the block, for blocks in `asked` only if it is given (few enough to
    broadcast). A block has a fixed number of buckets and every bucket one range, so the
    lists are bounded however many candidates there are."""
    reach = _reach(relative)
    touched = F.sequence(
        _block(F.col("bucket") - reach, reach), _block(F.col("bucket") + reach, reach)
    )
    placed = (
        candidates.select(group, "number")
        .withColumn("bucket", _bucket(F.col("number"), absolute, relative))
        .withColumn("block", F.explode_outer(touched))
    )
    if asked is not None:
        placed = placed.join(F.broadcast(asked), "block", "left_semi")
    return (
        placed.groupBy(group, "block", "bucket")
        .agg(F.min("number").alias("low"), F.max("number").alias("high"))
        .groupBy(group, "block")
        .agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    )


def mark_matches(
    targets: DataFrame,
    candidates: DataFrame,
    group: str,
    absolute: float,
    relative: float | None = None,
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """targets (group, number, …) with `found`: whether a candidate of the group is close.

    Numbers close to a target form one interval around it. Candidates in no block of any
    target are left out where they are read, as the blocks of all groups are few; the others
    are reduced to one range per narrow bucket, by aggregation that combines before it
    shuffles, and the few ranges of a block of buckets are looked up once per target. A
    group that holds a large part of all rows becomes many keys, no target-candidate pairs
    are formed, and a block that is itself frequent among the targets is spread.
    """
    reach = _reach(relative)
    bucket = _bucket(F.col("number"), absolute, relative)
    placed = targets.withColumn("block", _block(bucket, reach))
    slot = F.pmod(F.xxhash64(group), F.lit(GROUP_SLOTS))
    counted = materialise(placed.groupBy("block", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")))
    asked = counted.select("block").distinct()
    few = fits(asked, cfg.broadcast_max_rows)
    near = _blocks(candidates, group, absolute, relative, asked if few else None)
    number = F.col("number")
    hit = F.exists(
        "ranges",
        lambda r: number.between(r["low"], r["high"])
        | close(number, r["low"], absolute, relative)
        | close(number, r["high"], absolute, relative),
    )
    if counted.filter(F.col("n") > cfg.hot_rows).isEmpty():
        looked_up = placed.join(near, [group, "block"], "left")
    else:
        looked_up = join_hot(placed, near, [group, "block"], "left", cfg.hot_rows, cfg.salt_buckets)
    return looked_up.withColumn("found", F.coalesce(hit, F.lit(False))).select(*targets.columns, "found")


def each_number(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(*keep, number), one row per number that extract_numbers finds, repeats kept. The outer
    form keeps the optimizer from adding a size filter, which would search every text a
    second time."""
    numbers = F.explode_outer(money_numbers(F.col(text))).alias("number")
    return rows.select(*keep, numbers).filter(F.col("number").isNotNull() & ~is_year(F.col("number")))


def answer_numbers(answers: DataFrame, group: str, text: str) -> DataFrame:
    """(answer_id, group, number), one row per number in the answer, repeats kept."""
    return each_number(answers, ["answer_id", group], text)


def verify_answers(
    answers: DataFrame,
    evidence: DataFrame,
    group: str,
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """(answer_id, n_numbers, n_unverified, verified, message) of many answers.

    answers: (answer_id, group, answer); evidence: (group, content). Evidence may
    be of any size per group.
    """
    if not cfg.verify_numbers:
        return answers.select(
            "answer_id",
            F.lit(0).cast("bigint").alias("n_numbers"),
            F.lit(0).cast("bigint").alias("n_unverified"),
            F.lit(True).alias("verified"),
            F.lit(DISABLED).alias("message"),
        )
    claimed = answer_numbers(answers, group, "answer")
    known = each_number(evidence, [group], "content")
    tolerance = cfg.verify_tolerance
    per_answer = (
        mark_matches(claimed, known, group, tolerance, tolerance, cfg)
        .groupBy("answer_id")
        .agg(
            F.count(F.lit(1)).alias("n_numbers"),
            F.count_if(~F.col("found")).alias("n_unverified"),
        )
    )
    total = F.coalesce("n_numbers", F.lit(0))
    missing = F.coalesce("n_unverified", F.lit(0))
    return answers.select("answer_id").join(per_answer, "answer_id", "left").select(
        "answer_id",
        total.alias("n_numbers"),
        missing.alias("n_unverified"),
        (missing == 0).alias("verified"),
        F.when(total == 0, F.lit(NO_NUMBERS))
        .when(missing == 0, F.lit(ALL_VERIFIED))
        .otherwise(F.concat(missing.cast("string"), F.lit(NOT_FOUND)))
        .alias("message"),
    )


def hallucination_rate(checked: DataFrame) -> DataFrame:
    """One row: share of all answer numbers that no evidence supports."""
    return checked.agg(
        F.coalesce(F.sum("n_numbers"), F.lit(0)).alias("total_numbers"),
        F.coalesce(F.sum("n_unverified"), F.lit(0)).alias("hallucinated_numbers"),
        F.coalesce(
            F.try_divide(F.sum("n_unverified").cast("double"), F.sum("n_numbers")), F.lit(0.0)
        ).alias("hallucination_rate"),
    )


def verification(answer: Column, evidence: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """The same rollup as one struct, for an answer with a bounded list of evidence
    texts (the top k of a retrieval). No shuffle."""
    if not cfg.verify_numbers:
        numbers = known = missing = F.array().cast("array<double>")
    else:
        numbers = extract_numbers(answer)
        known = F.array_distinct(F.flatten(F.transform(evidence, extract_numbers)))
        missing = unmatched(numbers, known, cfg.verify_tolerance, cfg.verify_tolerance)
    message = (
        F.when(F.lit(not cfg.verify_numbers), F.lit(DISABLED))
        .when(F.size(numbers) == 0, F.lit(NO_NUMBERS))
        .when(F.size(missing) == 0, F.lit(ALL_VERIFIED))
        .otherwise(F.concat(F.size(missing).cast("string"), F.lit(NOT_FOUND)))
    )
    return F.struct(
        (F.size(missing) == 0).alias("verified"),
        numbers.alias("answer_numbers"),
        known.alias("evidence_numbers"),
        missing.alias("unverified_numbers"),
        message.alias("message"),
    )


def missing_program_numbers(
    program: Column, available: Column, cfg: EngineConfig = EngineConfig()
) -> Column:
    """Numbers of a program text that are not close to any available number."""
    return unmatched(
        extract_numbers(program), available, cfg.verify_tolerance, cfg.verify_tolerance
    )
