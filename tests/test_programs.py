import math
import re
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.programs import (
    execute_program,
    first_unknown_literal,
    program_literals,
    split_response,
)

CHAIN = "\n".join(
    [
        "a = multiply(6, 7)",
        "b = subtract(a, 2.5)",
        "c = max([a, b, 40])",
        "d = diff(c, b)",
        "answer = d",
    ]
)


def run(one, text, strict=False):
    return one(execute_program(F.col("t"), strict), t=text)


def test_names_as_answers(one):
    """An answer that is a bare name is taken, unless programs are strict."""
    result = run(one, CHAIN)
    assert result.final_answer == 2.5
    assert result.variables["a"] == 42.0 and result.variables["b"] == 39.5 and result.variables["c"] == 42.0
    strict = run(one, CHAIN, strict=True)
    assert strict.error == "Error executing line 'answer = d': Invalid expression: d"
    assert strict.final_answer is None and strict.variables["d"] == 2.5


def test_documented_growth_program(one):
    text = "const_0 = 394.3  # new\nconst_1 = 334.67  # old\nchange = subtract(const_0, const_1)\nanswer = percent(change, const_1)"
    assert run(one, text).final_answer == pytest.approx((394.3 - 334.67) / 334.67 * 100)
    assert run(one, text, strict=True).error.startswith("Error executing line 'const_0 = 394.3  # new'")


def run_all(spark, texts, strict=False):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    run_ = execute_program(F.col("t"), strict)
    return [r.r for r in rows.select("i", run_.alias("r")).orderBy("i").collect()]


def test_values(spark):
    cases = [
        ("x = divide(1, 0)", float("inf")),
        ("x = percent(-1, 0)", float("inf")),
        ("x = avg(1, 2)", 0.0),
        ("x = avg([1, 2])", 1.5),
        ("x = diff(1, 4)", 3.0),
        ("x = max([1, 5, 3])\ny = min(x, 2)", 2.0),
        ("x = sum(1, 2, 3)", 6.0),
        ("answer = 5\nx = 6", 5.0),
        ("x = 1\nx = add(x, 1)\nx = multiply(x, 3)", 6.0),
        ("x = 1_000", 1000.0),
        ("# note\nREASONING text = 4\nPROGRAM:\n\nno assignment here\nx = 3", 3.0),
        ("x = add(1, 2) # and (3)", 3.0),
        ("", None),
    ]
    results = run_all(spark, [text for text, _ in cases])
    assert [r.final_answer for r in results] == [answer for _, answer in cases]


def test_errors_stop_the_program(spark):
    cases = [
        ("x = avg([])", "Error executing line 'x = avg([])': Invalid list item: "),
        ("x = foo(1)", "Error executing line 'x = foo(1)': Unknown operation: foo"),
        ("x = add(q, 1)", "Error executing line 'x = add(q, 1)': Invalid argument: q"),
        ("x = what", "Error executing line 'x = what': Invalid expression: what"),
        ("x = 1d", "Error executing line 'x = 1d': Invalid expression: 1d"),
        ("x = add(1)", "Error executing line 'x = add(1)': Wrong number of arguments: add"),
    ]
    results = run_all(spark, ["first = 1\n" + text + "\nlast = 2" for text, _ in cases])
    for result, (_, error) in zip(results, cases):
        assert result.error == error and result.final_answer is None
        assert result.variables == {"first": 1.0}


def worked_out(op, a, b):
    """Exact fractions instead of the floats under test; a zero divisor gives infinity."""
    x, y = Fraction(a), Fraction(b)
    if op in ("divide", "percent"):
        return float(x / y * (100 if op == "percent" else 1)) if y else float("inf")
    return float({"add": x + y, "subtract": x - y, "multiply": x * y, "diff": max(x, y) - min(x, y)}[op])


OPERATIONS = ("add", "diff", "divide", "multiply", "percent", "subtract")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    programs=st.lists(
        st.lists(
            st.tuples(
                st.sampled_from(OPERATIONS),
                st.one_of(st.integers(-50, 50), st.integers(0, 9).map(lambda i: f"v{i}")),
                st.one_of(st.integers(-50, 50), st.integers(0, 9).map(lambda i: f"v{i}")),
            ),
            min_size=1, max_size=6,
        ),
        min_size=5, max_size=20,
    )
)
def test_fold_agrees_with_a_plain_interpreter(spark, programs):
    texts, answers = [], []
    for steps in programs:
        env, answer, failed = {}, None, False
        lines = []
        for i, (op, a, b) in enumerate(steps):
            lines.append(f"v{i} = {op}({a}, {b})")
            if failed or any(isinstance(x, str) and x not in env for x in (a, b)):
                failed = True
                continue
            x, y = (env[x] if isinstance(x, str) else float(x) for x in (a, b))
            if not (math.isfinite(x) and math.isfinite(y)):
                failed, answer = None, None  # beyond fractions; other tests have infinities
                break
            answer = worked_out(op, x, y)
            env[f"v{i}"] = answer
        if failed is None:
            continue
        texts.append("\n".join(lines))
        answers.append(None if failed else answer)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.a for r in rows.select("i", execute_program(F.col("t"))["final_answer"].alias("a")).collect()}
    for i, expected in enumerate(answers):
        assert got[i] == pytest.approx(expected), texts[i]


def test_literals(one):
    text = "const_0 = 5.5\nx2 = add(const_0, -3)"
    assert one(program_literals(F.col("t")), t=text) == [5.5, -3.0]
    assert one(program_literals(F.col("t"), True), t=text) == [
        float(n) for n in re.findall(r"-?\d+\.?\d*", text)
    ]


def test_unknown_literal(one):
    known = F.array(F.lit(5.5), F.lit(-3.0000001))
    assert one(first_unknown_literal(F.col("t"), known), t="a = 5.5\nb = add(a, -3)") is None
    assert one(first_unknown_literal(F.col("t"), known), t="a = 5.5\nb = add(a, 4)\nc = 9") == 4.0


@pytest.mark.parametrize(
    "response, reasoning, program",
    [
        ("REASONING: why\nPROGRAM:\nx = 1\nPROGRAM: y", "why", "x = 1"),
        ("PROGRAM: x = 1", "", "x = 1"),
        (" x = 1 ", "", "x = 1"),
    ],
)
def test_response_parts(one, response, reasoning, program):
    parts = one(split_response(F.col("t")), t=response)
    assert (parts.reasoning, parts.program) == (reasoning, program)
