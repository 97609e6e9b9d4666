import math
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as X

def test_years_are_not_numbers(one):
    """Whole numbers from 1900 to 2100 go, their neighbours and fractions between stay."""
    text = "Built 1900, 14 wells by 1987; depth 1899 and 2101 feet, 1950.5 below, -3% since 2100"
    assert one(N.extract_numbers(F.col("t")), t=text) == [14.0, 1899.0, 2101.0, -3.0]


def test_number_pattern_corner_cases(one):
    assert one(N.extract_numbers(F.col("t")), t="10-K 2022-2023 $-5 -$5 5. ") == [
        10.0, -2023.0, -5.0, -5.0, 5.0,
    ]


def test_evidence_numbers_keep_first_occurrences_and_drop_huge_values(one):
    text = "1,000 then 5 then 1000 then 20000000000 then -3.5 in 2020"
    assert one(N.evidence_numbers(F.col("t")), t=text) == [1000.0, 5.0, -3.5, 2020.0]


def test_plain_numbers_do_not_join_thousands(one):
    assert one(N.plain_numbers(F.col("t")), t="1,000 and 2.5") == [1.0, 0.0, 2.5]


@pytest.mark.parametrize(
    "cell, value",
    [("(1,234.5)", -1234.5), ("$5%", 5.0), ("$100M", 100.0), ("n/a", None), ("1 2", 1.0), ("", None)],
)
def test_accounting_cells(one, cell, value):
    assert one(N.parse_cell(F.col("t")), t=cell) == value


@pytest.mark.parametrize("cell, flag", [("$ 1,2%", True), ("(5)", True), ("$100M", False), ("", False)])
def test_numeric_cells(one, cell, flag):
    assert one(N.is_numeric_cell(F.col("t")), t=cell) is flag


@pytest.mark.parametrize(
    "text, value",
    [("1,234%", 1234.0), ("about 5.5 or 6", 5.5), ("none", None), ("1,200 dollars", 1.0), ("", None)],
)
def test_gold_answers(one, text, value):
    assert one(N.parse_gold(F.col("t")), t=text) == value


def test_claims_split_at_every_stop(one):
    claims = one(N.numeric_claims(F.col("t")), t="Up 5% today! No change. It was 1.5 then?")
    assert [(c.sentence, c.numbers) for c in claims] == [
        ("Up 5% today", [5.0]), ("It was 1", [1.0]), ("5 then", [5.0]),
    ]


@pytest.mark.parametrize("text", ["1_000", " 5 ", "1d", "1e5", ".5", "5.", "-inf", "nan", "1__0", "+3", "0x1", "1f", ""])
def test_parse_float_accepts_what_python_accepts(one, text):
    try:
        expected = float(text)
    except ValueError:
        expected = None
    got = one(N.parse_float(F.col("t")), t=text)
    assert got == expected or (math.isnan(got) and math.isnan(expected))


FLOATS = st.floats(allow_nan=False, width=64)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(FLOATS, min_size=20, max_size=60))
def test_float_text_is_python_repr(spark, values):
    values = values + [1e16, 1e15, 1e-4, 9.9e-5, 12345678.0, 123456789.125]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for row in rows.select("v", N.float_text(F.col("v")).alias("t")).collect():
        assert float(row.t) == row.v
        # both must choose the same notation
        assert ("e" in row.t) == ("e" in repr(row.v)), (row.t, row.v)


def test_tokens_split_on_unicode_space(one):
    assert one(X.tokens(F.col("t")), t="A B c\x1fd  E ") == ["a", "b", "c", "d", "e"]


def test_clean_markdown_order(one):
    text = "a\n\n\n\nb  \n \n \nc<!-- x\ny --> d​\n|a|  b|\n"
    expected = re.sub(r"\n{3,}", "\n\n", text)
    expected = "\n".join(line.rstrip() for line in expected.split("\n"))
    expected = expected.replace("|a|  b|", "| a | b |").replace("<!-- x\ny -->", "")
    expected = expected.replace(" ", " ").replace("​", "").strip()
    assert one(X.clean_markdown(F.col("t")), t=text) == expected


def test_clean_cell(one):
    assert one(X.clean_cell(F.col("t")), t=" a  b\n​c ") == "a b c"


def test_undecodable_bytes_are_dropped(spark):
    row = spark.createDataFrame([(bytearray(b"ab\xff\xc3\xa9"),)], "b binary")
    assert row.select(X.decode_bytes(F.col("b"))).first()[0] == "abé"


@pytest.mark.parametrize(
    "claimed, fact, same",
    [(1.0, 1.0, True), (100.0, 100.009, True), (20000500.0, 20000000.0, True), (6e8, 5e8, False), (0.005, 0.0, True), (1.0, 0.0, False)],
)
def test_facts_match(spark, claimed, fact, same):
    row = spark.createDataFrame([(claimed, fact)], "a double, b double")
    assert row.select(N.facts_match(F.col("a"), F.col("b"))).first()[0] is same
