"""Numbers in text: parsing, extraction and tolerance matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import let, strip

# Number patterns and filter bounds that define the results.
SIGNED_NUMBER = r"-?\d+\.?\d*"
YEAR_FIRST, YEAR_LAST = 1900, 2100
EVIDENCE_LIMIT = 1e10

_FLOAT_TEXT = (
    r"^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)"
    r"(?:[eE][+-]?\d+(?:_\d+)*)?|(?i:inf|infinity|nan))$"
)


def parse_float(text: Column) -> Column:
    """Double for anything Python's float() accepts, otherwise NULL."""
    return parse_stripped(strip(text))


def parse_stripped(body: Column) -> Column:
    """The same of text without blanks around it."""
    return F.when(
        body.rlike(_FLOAT_TEXT), F.replace(body, F.lit("_"), F.lit("")).try_cast("double")
    )


def float_text(value: Column) -> Column:
    """A double written the way Python's repr writes it (5.0, 12345678.0, 1e+16)."""
    raw = value.cast("string")
    plain = F.when(F.isnan(value), F.lit("nan")).when(
        F.abs(value) == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    ).when(~raw.contains("E"), raw)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    mantissa = F.split_part(F.ltrim(raw, F.lit("-")), F.lit("E"), F.lit(1))
    exponent = F.split_part(raw, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"0+$", "")
    count = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    whole = F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - count), F.lit(".0"))
    mixed = F.concat(
        F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2)
    )
    fraction = F.when(count > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    scientific = F.concat(
        F.substr(digits, F.lit(1), F.lit(1)),
        fraction,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(exponent).cast("string"),
    )
    return F.coalesce(
        plain,
        F.concat(
            sign,
            F.when((exponent < -4) | (exponent >= 16), scientific)
            .when(exponent < 0, small)
            .when(exponent + 1 >= count, whole)
            .otherwise(mixed),
        ),
    )


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def is_year(value: Column) -> Column:
    return value.between(YEAR_FIRST, YEAR_LAST)


def money_numbers(text: Column) -> Column:
    """Every number of a text, thousands separators joined. A dollar sign may stand between
    a minus sign and its number; it goes first, so that numbers are cast as one array."""
    plain = F.replace(_without(text, ","), F.lit("-$"), F.lit("-"))
    return _found(plain, SIGNED_NUMBER).try_cast("array<double>")


def extract_numbers(text: Column) -> Column:
    """Numbers of a claim or its evidence; values that look like years are left out."""
    return F.filter(money_numbers(text), lambda v: ~is_year(v))


def evidence_numbers(text: Column) -> Column:
    """Numbers a program may use, first occurrences in order."""
    found = _found(_without(text, ","), SIGNED_NUMBER)
    values = F.transform(found, lambda m: m.try_cast("double"))
    return F.array_distinct(F.filter(values, lambda v: v < EVIDENCE_LIMIT))


def plain_numbers(text: Column) -> Column:
    """Every number of running text, thousands separators not joined."""
    return F.transform(_found(text, SIGNED_NUMBER), lambda m: m.try_cast("double"))


def cell_numbers(cell: Column) -> Column:
    """A table cell as one number, else every number inside it."""
    whole = parse_float(cell)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(plain_numbers(_without(cell, ",")))


def first_number(text: Column) -> Column:
    hit = F.regexp_extract(text, f"({SIGNED_NUMBER})", 1)
    return F.when(hit != "", hit.try_cast("double"))


def parse_cell(cell: Column) -> Column:
    """Accounting cell to double: currency and percent marks dropped, an opening
    bracket is a minus sign; otherwise the first number in it."""
    return let(
        strip(F.translate(cell, "($,)%", "-")),
        lambda c: F.coalesce(parse_float(c), first_number(c)),
    )


def is_numeric_cell(cell: Column) -> Column:
    return parse_float(F.regexp_replace(cell, r"(?U)[$,\s%()]", "")).isNotNull()


def parse_gold(answer: Column) -> Column:
    """Reference answer as double: the whole text, else its first number, else NULL."""
    return F.coalesce(parse_float(_without(answer, ",%")), first_number(answer))


def numeric_claims(text: Column) -> Column:
    """Sentences that hold numbers. Splitting on the full stop also cuts decimals."""
    sentences = F.transform(
        F.split(text, r"[.!?]+"),
        lambda s: F.struct(strip(s).alias("sentence"), extract_numbers(s).alias("numbers")),
    )
    return F.filter(sentences, lambda c: F.size(c["numbers"]) > 0)


def close(target: Column, candidate: Column, absolute: float, relative: float | None) -> Column:
    gap = F.abs(target - candidate)
    if relative is None:
        return gap < absolute
    share = F.try_divide(gap, F.abs(candidate))
    return (gap < absolute) | F.coalesce(share < relative, F.lit(False))


def has_match(target: Column, candidates: Column, absolute: float, relative=None) -> Column:
    """Whether an array of bounded length holds a number close to the target."""
    return F.exists(candidates, lambda c: close(target, c, absolute, relative))


def unmatched(targets: Column, candidates: Column, absolute: float, relative=None) -> Column:
    return F.filter(targets, lambda t: ~has_match(t, candidates, absolute, relative))


def facts_match(claimed: Column, fact: Column) -> Column:
    """Equal, within a cent, or within 0.1 % of the fact."""
    gap = F.abs(claimed - fact)
    share = F.try_divide(gap, F.abs(fact))
    return (claimed == fact) | (gap < 0.01) | F.coalesce(share < 0.001, F.lit(False))
