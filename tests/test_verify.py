import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.operators import facts, metrics, verify, vote

CFG = EngineConfig()


def test_answers_with_and_without_grounds(one):
    """Three numbers of which one is nowhere, one is within the tolerance and one exact."""
    evidence = F.array(F.lit("wells: 14, of these 3 dry"), F.lit("depth 800 ft (2004)"), F.lit(""))
    mixed, near, none = one(
        verify.verification(F.lit("14 wells go down 806 feet and cost 55 each"), evidence),
        verify.verification(F.lit("In 2004 the 3 dry ones had 803 feet"), evidence),
        verify.verification(F.lit("all were dug in 1988"), evidence),
    )
    assert not mixed.verified and mixed.unverified_numbers == [55.0]
    assert mixed.answer_numbers == [14.0, 806.0, 55.0]
    assert mixed.message == "1 numbers not found in evidence"
    assert near.verified and near.message == "All numbers verified"
    assert none.verified and none.message == "No numbers in answer" and none.answer_numbers == []
    off = one(verify.verification(F.lit("x 5"), evidence, CFG.replace(verify_numbers=False)))
    assert off.verified and off.message == "Verification disabled"


def test_program_numbers(one):
    missing = one(verify.missing_program_numbers(F.lit("x = add(5, 7)"), F.array(F.lit(5.01))))
    assert missing == [7.0]


NEAR = st.one_of(
    st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3)),
    st.integers(-300, 300).map(lambda i: i / 100),
    st.integers(1, 60).map(lambda i: 1.005**i),
    st.floats(1e9, 1e15),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(targets=st.lists(NEAR, min_size=10, max_size=60), known=st.lists(NEAR, min_size=1, max_size=60), relative=st.sampled_from([None, 0.01, 0.2]))
def test_matching_against_all_pairs(spark, targets, known, relative):
    targets = targets + [k * 1.0099 for k in known] + [k * 0.9901 for k in known] + [k + 0.0099 for k in known]
    left = spark.createDataFrame([("g", t) for t in targets], "g string, number double")
    right = spark.createDataFrame([("g", k) for k in known] + [("other", t) for t in targets], "g string, number double")
    cfg = CFG.replace(hot_rows=2, salt_buckets=3)
    marked = verify.mark_matches(left, right, "g", 0.01, relative, cfg).collect()
    assert len(marked) == len(targets)
    got = {r.number: r.found for r in marked}
    for t in targets:
        expected = any(
            abs(t - k) < 0.01 or (relative and k != 0 and abs(t - k) / abs(k) < relative) for k in known
        )
        assert got[t] == bool(expected), t


def test_one_hot_group_becomes_many_keys(spark):
    hot = spark.range(20000).select(F.lit("hot").alias("g"), (F.col("id") % 5000 / 7).alias("number"))
    matched = verify.mark_matches(hot, hot, "g", 0.01, 0.01, CFG.replace(hot_rows=50))
    assert matched.count() == 20000 and matched.filter("not found").isEmpty()


def test_answers_with_repeats(spark):
    answers = spark.createDataFrame([(1, "g", "5 and 5 and 9"), (2, "h", "5"), (3, "g", "none")], "answer_id int, g string, answer string")
    evidence = spark.createDataFrame([("g", "4.999"), ("g", "7")], "g string, content string")
    got = {r.answer_id: r for r in verify.verify_answers(answers, evidence, "g").collect()}
    assert (got[1].n_numbers, got[1].n_unverified) == (3, 1)
    assert got[2].message == "1 numbers not found in evidence" and got[3].verified
    rate = verify.hallucination_rate(verify.verify_answers(answers, evidence, "g")).first()
    assert (rate.total_numbers, rate.hallucinated_numbers, rate.hallucination_rate) == (4, 2, 0.5)


def test_texts_are_searched_once_and_far_numbers_left_out(spark):
    """No size filter repeats the search of a text, and without a frequent key no join is
    salted; numbers in no block of a target change nothing."""
    answers = spark.createDataFrame([(1, "g", "5 or 7000"), (2, "h", "-$5")], "answer_id int, g string, answer string")
    evidence = spark.createDataFrame([("g", "90 91 92 7001"), ("h", "5 8.5% 1e9"), ("h", None)], "g string, content string")
    checked = verify.verify_answers(answers, evidence, "g")
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan and "_salt" not in plan
    assert {r.answer_id: r.n_unverified for r in checked.collect()} == {1: 1, 2: 1}
    far = verify._blocks(evidence.selectExpr("g", "90.0D as number"), "g", 0.01, 0.01, spark.createDataFrame([(0,)], "block long"))
    assert far.isEmpty()


def test_facts(spark):
    reported = spark.createDataFrame(
        [("e", "Revenues", 1e8), ("e", "NetIncomeLoss", 2e7), ("e", "Assets", 5e8), ("e", "AssetsCurrent", 6e8), ("e", "Other", 0.0)],
        "entity string, tag string, value double",
    )
    claims = spark.createDataFrame(
        [("e", "revenue", 1e8), ("e", "Net Income", 20000500.0), ("e", "total_assets", 6e8), ("e", "cash", 1.0), ("e", "Other", 3.0)],
        "entity string, metric string, claimed double",
    )
    checked = facts.check_facts(claims, reported)
    got = {r.metric: r for r in checked.collect()}
    assert got["revenue"].verified and got["Net Income"].verified
    assert got["total_assets"].diff == 1e8 and got["total_assets"].diff_pct == pytest.approx(20.0)
    assert got["cash"].reason == facts.MISSING and got["Other"].diff_pct == float("inf")
    total = facts.facts_rollup(checked).first()
    assert not total.verified and total.discrepancies == ["Other", "total_assets"] and total.n_missing == 1
    assert facts.verify_facts(claims, reported).first().message == facts.DISABLED
    on = CFG.replace(verify_facts=True)
    assert facts.verify_facts(claims, reported, on).first() == total
    only_missing = facts.facts_rollup(checked.filter("metric in ('cash', 'revenue')")).first()
    assert only_missing.verified and only_missing.message == "All values verified"


def test_variant_facts(spark):
    rows = spark.createDataFrame([("5",), ('{"value": 6}',), ('{"amount": "7"}',), ('{"x": 1}',)], "j string")
    got = [r[0] for r in rows.select(facts.fact_value(F.parse_json("j"))).collect()]
    assert got == [5.0, 6.0, 7.0, None]


RUNS = "question_id string, sample_no int, program string, reasoning string, answer double, success boolean, error string"


def test_vote_tie_goes_to_the_first_seen(spark):
    rows = [("q", i, f"p{i}", "", a, True, None) for i, a in enumerate([2.0, 3.0, 3.0000000001, 2.0], 1)]
    rows += [("bad", 1, "", "", None, False, "first"), ("bad", 2, "", "", None, False, "last")]
    rows += [("one", 1, "x", "", None, False, "e"), ("one", 2, "p", "", 7.0, True, None)]
    got = {r.question_id: r for r in vote.majority_vote(spark.createDataFrame(rows, RUNS)).collect()}
    assert (got["q"].answer, got["q"].program, got["q"].votes) == (2.0, "p1", 2)
    assert got["bad"].answer is None and got["bad"].error == "last"
    assert got["one"].answer == 7.0 and got["one"].error is None and got["one"].n_runs == 2


PREDICTIONS = "question_id string, predicted_answer double, gold_answer string, execution_success boolean, evidence_numbers array<double>, program_numbers array<double>"


def test_metric_denominators(spark):
    rows = [
        ("a", 5.0, "5", True, [5.0], [5.0, 8.0]),
        ("b", 7.0, "7%", True, None, [7.0]),
        ("c", None, "yes", True, [1.0], [1.0]),
        ("d", None, "9", False, [1.0], []),
    ]
    scored = metrics.score_predictions(spark.createDataFrame(rows, PREDICTIONS))
    got = metrics.evaluation_metrics(scored).first()
    assert got.exact_match == 0.5 and got.execution_success_rate == 0.5
    assert got.evidence_precision == 0.5 and got.n_skipped == 1
    assert (got.hallucination_count, got.total_numbers) == (2, 3)
    empty = metrics.evaluation_metrics(scored.limit(0)).first()
    assert empty.exact_match == 0.0 and empty.hallucination_rate == 0.0


def test_comparison(spark):
    columns = list(metrics.COMPARED)
    base = spark.createDataFrame([(0.4, 0.0, 0.5, 0.5, 0.4)], columns)
    new = spark.createDataFrame([(0.5, 0.3, 0.5, 0.4, 0.3)], columns)
    got = {r.metric: r for r in metrics.compare_metrics(base, new).collect()}
    assert got["exact_match"].percentage == pytest.approx(25)
    assert got["hallucination_rate"].percentage == pytest.approx(25)
    assert got["numerical_accuracy"].percentage == 0.0
    assert got["numerical_accuracy"].absolute == pytest.approx(0.3)
