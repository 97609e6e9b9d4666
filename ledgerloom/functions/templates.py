"""Prompt texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.numbers import float_text
from ledgerloom.functions.programs import OPERATIONS, PROGRAM_MARK, REASONING_MARK

WRITE_PROGRAM = f"""Work out the answer to a finance question as a short calculation.
Allowed operations: {", ".join(OPERATIONS)}. Write one step per line as
name = operation(first, second); max, min, sum and avg also take a list [a, b, c].
Take every number from the evidence and name the result `answer`.
Reply with {REASONING_MARK} and your reasoning, then {PROGRAM_MARK} and the steps.

EVIDENCE
{{evidence}}

QUESTION
{{question}}
"""

REPAIR_PROGRAM = f"""This calculation does not work. Problem: {{error}}

CALCULATION
{{program}}

EVIDENCE
{{evidence}}

QUESTION
{{question}}

Write it again with numbers from the evidence and valid operations only.
Reply with {REASONING_MARK} and {PROGRAM_MARK} as before.

USABLE NUMBERS
{{numbers}}
"""

EXPLAIN_PROGRAM = """Explain step by step why this calculation fails.

CALCULATION
{program}

PROBLEM
{error}

QUESTION
{question}
"""

ANSWER_FILING = """Answer from the filing excerpts only and name the filing for every figure.
Say so if the excerpts do not hold the answer.

EXCERPTS
{evidence}

QUESTION
{question}
"""

ANSWER_FILING_TABLES = """Answer from the filing excerpts and tables only. Prefer table figures
and name the filing for each one.

EXCERPTS
{evidence}

TABLES
{tables}

QUESTION
{question}
"""

CHECK_NUMBERS = """Does the evidence support every figure in the answer? Start your reply with
PASS if it does and FAIL if not, then list unsupported figures.

ANSWER
{answer}

EVIDENCE
{evidence}
"""

SUMMARISE_TABLE = """Describe this financial table in two or three sentences: topic, periods,
main figures.

{table}
"""

JUDGE_RELEVANCE = """Rate from 0 to 10 how much this passage helps to answer the question.

QUESTION
{question}

PASSAGE
{evidence}
"""

CHECK_FACTS = """Compare the claimed values with the reported facts and list differences.

CLAIMED
{claims}

REPORTED
{facts}
"""


def fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced; inserted text is not expanded again."""
    parts, rest = [], template
    while values:
        places = {rest.find("{" + n + "}"): n for n in values if "{" + n + "}" in rest}
        if not places:
            break
        at = min(places)
        name = places[at]
        parts += [F.lit(rest[:at]), F.coalesce(values[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))


def with_context(prompt: Column, context: Column) -> Column:
    """A prompt preceded by its context."""
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\n"), prompt)


def evidence_text(evidence: Column) -> Column:
    """Numbered evidence with scores, of array<struct<content, score, doc_type, …>>."""
    return F.array_join(
        F.transform(
            evidence,
            lambda e, i: F.concat(
                F.format_string("[Evidence %d] (score: %.3f)\n", i + 1, e["score"]),
                F.lit("Type: "),
                e["doc_type"],
                F.lit("\nContent: "),
                e["content"],
                F.lit("\n"),
            ),
        ),
        "\n",
    )


def numbered_text(texts: Column) -> Column:
    return F.array_join(
        F.transform(
            texts,
            lambda t, i: F.concat(F.format_string("[Evidence %d]\n", i + 1), t),
        ),
        "\n\n",
    )


def _cited(evidence: Column, head) -> Column:
    return F.array_join(F.transform(evidence, lambda e: F.concat(head(e), e["content"])), "\n\n")


def _or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _day(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit(""))


def filing_text(evidence: Column) -> Column:
    return _cited(
        evidence,
        lambda e: F.concat(
            F.lit("["),
            F.concat_ws(
                " - ", _or_empty(e["ticker"]), _or_empty(e["filing_type"]), _day(e["filing_date"])
            ),
            F.lit("]\n"),
        ),
    )


def filing_tables(evidence: Column) -> Column:
    return _cited(
        evidence,
        lambda e: F.concat(
            F.lit("[Table from "),
            F.concat_ws(" ", _or_empty(e["filing_type"]), _day(e["filing_date"])),
            F.lit("]\n"),
        ),
    )


def number_list(numbers: Column, limit: int) -> Column:
    return F.array_join(F.transform(F.slice(numbers, 1, limit), float_text), ", ")
