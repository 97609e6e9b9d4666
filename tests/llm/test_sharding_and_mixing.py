import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import mixing, queries, sharding


def test_shards_cover_awkward_rows(awkward):
    rows = sharding.shard_by_bytes(awkward, 4).collect()
    texts = [r["text"] for r in awkward.collect()]
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 16 for t in texts)
    crcs = [zlib.crc32(t.encode()) if t is not None else None for t in texts]
    assert sorted((r["text_crc32"] for r in rows), key=str) == sorted(crcs, key=str)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    keyed = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in keyed] == sorted(r["doc_id"] for r in keyed)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_balance_does_not_depend_on_partitions_or_hot_keys(spark, partitions):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"),
    )
    rows = sharding.shard_by_bytes(docs, 10, partitions=partitions).collect()
    sums = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(10)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in rows)
    assert len(rows) == 3000


def test_fewer_rows_than_shards_and_none(spark, nothing):
    assert sharding.shard_by_bytes(nothing, 4).count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert 0 <= sharding.shard_by_bytes(one, 40).first()["shard"] < 40


def targets(spark, **given):
    return {
        c: spark.createDataFrame(list(v.items()), "value string, target double") for c, v in given.items()
    }


def test_raking_meets_both_marginals(spark):
    cells = spark.createDataFrame(
        [("a", "x", 90), ("a", "y", 10), ("b", "x", 20), ("b", "y", 5), ("c", "x", 0)],
        "source string, lang string, tokens long",
    )
    wanted = targets(spark, source={"a": 1.0, "b": 1.0, "z": 9.0}, lang={"x": 3.0, "y": 1.0})
    rows = mixing.rake(cells, wanted).collect()
    weight = {(r["source"], r["lang"]): r["factor"] * r["tokens"] for r in rows}
    assert sum(v for (s, _), v in weight.items() if s == "a") == pytest.approx(62.5, rel=1e-6)
    assert sum(v for (_, g), v in weight.items() if g == "x") == pytest.approx(93.75, rel=1e-6)
    odds = weight["a", "x"] * weight["b", "y"] / (weight["a", "y"] * weight["b", "x"])
    assert odds == pytest.approx(90 * 5 / (10 * 20), rel=1e-6)  # raking keeps odds ratios


def test_copies_follow_the_factor_and_awkward_rows_stay(awkward, nothing):
    rows = queries.mixed(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["copies"] in (int(r["factor"]), int(r["factor"]) + 1)
        assert r["probability"] == min(1.0, r["factor"])
        assert (r["tokens"] == 0) == (not (r["text"] or "").strip(" \t\n\r\v\f"))
    assert queries.mixed(nothing).count() == 0


def test_mean_number_of_copies(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"),
        F.lit(10).cast("long").alias("tokens"),
    )
    cells = mixing.cell_table(docs, ["source"])
    wanted = targets(docs.sparkSession, source={"a": 1.0, "b": 1.0})
    mixed = mixing.mix_sources(docs, ["source"], wanted, cells)
    means = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.avg("copies")).collect()}
    assert means["a"] == pytest.approx(2.0, abs=1e-9) and means["b"] == pytest.approx(2 / 3, abs=0.02)


def test_the_mixed_corpus_meets_its_targets(spark):
    rows = [
        (i, ("one | two" if i % 5 == 0 else "one two three") + " four five", "en" if i % 7 else "de",
         "rare" if i % 50 == 0 else "some" if i % 6 == 0 else "most")
        for i in range(6000)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    before = queries.mixed(docs).select(*docs.columns, "topic", "tokens")
    after = queries.mixed(corpus_pipeline.mix(spark, docs, "")).select(*docs.columns, "topic", "tokens")
    tempers = (queries.SOURCE_TEMPER, queries.LANG_TEMPER, queries.TOPIC_TEMPER)
    for column, exponent in zip(queries.RAKED, tempers, strict=True):
        sums = [
            {r[0]: r[1] for r in df.groupBy(column).agg(F.sum("tokens")).collect()} for df in (before, after)
        ]
        raised = {k: n**exponent for k, n in sums[0].items()}
        for value, n in sums[1].items():
            share = raised[value] / sum(raised.values())
            assert n / sum(sums[1].values()) == pytest.approx(share, rel=0.04), value
