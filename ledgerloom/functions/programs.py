"""The arithmetic program language, evaluated inside Catalyst expressions.

A program is text, one statement per line:

    name = 5.2
    name = operation(a, b)        operation([a, b, c])

Lines are parsed with array functions and folded into
struct<final_answer, steps, variables, error>. `strict` rejects two forms that
documented programs use anyway: plain aliases (`answer = result_1`) and
trailing `# comments`.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.numbers import SIGNED_NUMBER, has_match, parse_stripped
from ledgerloom.functions.text import let, strip
from ledgerloom.schema import PROGRAM_STEP

# Operation names, ignored line starts, markers and messages.
OPERATIONS = [
    "add", "subtract", "multiply", "divide", "percent",
    "diff", "max", "min", "sum", "avg",
]
IGNORED_STARTS = ["#", "REASONING", "PROGRAM"]
REASONING_MARK, PROGRAM_MARK = "REASONING:", "PROGRAM:"
CALL = r"^(\w+)\((.*)\)"
LIST = r"^\[(.*)\]"
ALL_VERIFIED = "All numbers verified"

_BINARY = ["add", "subtract", "multiply", "divide", "percent", "diff"]
_STATE = f"struct<variables:map<string,double>,steps:array<{PROGRAM_STEP}>,error:string>"


def program_lines(text: Column) -> Column:
    # one plain character: Spark compiles any other pattern again for every split
    lines = F.transform(F.split(text, "\n"), strip)

    def counted(line: Column) -> Column:
        keep = line != ""
        for start in IGNORED_STARTS:
            keep = keep & ~line.startswith(start)
        return keep

    return F.filter(lines, counted)


def _statements(text: Column, strict: bool) -> Column:
    """array<struct<line, name, body, constant, operation, is_list, items, literals>>;
    lines without '=' are dropped. Literals are parsed here, outside the fold."""
    assigned = F.filter(program_lines(text), lambda s: s.contains("="))

    def name_and_body(line: Column) -> Column:
        body = F.substr(line, F.instr(line, "=") + 1)
        if not strict:
            body = F.substring_index(body, "#", 1)
        name = F.substring_index(line, "=", 1)
        return F.struct(line.alias("line"), strip(name).alias("name"), strip(body).alias("body"))

    def with_call(s: Column) -> Column:
        return F.struct(
            s["line"].alias("line"),
            s["name"].alias("name"),
            s["body"].alias("body"),
            F.when(s["body"].contains("("), F.regexp_extract(s["body"], CALL, 1)).otherwise("").alias("operation"),
            F.when(s["body"].contains("("), strip(F.regexp_extract(s["body"], CALL, 2))).otherwise("").alias("arguments"),
        )

    def with_items(s: Column) -> Column:
        is_call = s["operation"] != ""
        is_list = s["arguments"].startswith("[") & s["arguments"].rlike(LIST)
        inner = F.when(is_list, F.regexp_extract(s["arguments"], LIST, 1)).otherwise(s["arguments"])
        return F.struct(
            s["line"].alias("line"),
            s["name"].alias("name"),
            s["body"].alias("body"),
            F.when(~is_call, parse_stripped(s["body"])).alias("constant"),
            F.when(is_call, s["operation"]).alias("operation"),
            is_list.alias("is_list"),
            F.when(is_call, F.transform(F.split(inner, ","), strip)).alias("items"),
        )

    def with_literals(s: Column) -> Column:
        return s.withField("literals", F.transform(s["items"], parse_stripped))

    return F.transform(
        F.transform(F.transform(F.transform(assigned, name_and_body), with_call), with_items),
        with_literals,
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _apply(operation: Column, values: Column, is_list: Column) -> Column:
    a, b = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    infinite = F.lit(float("inf"))
    quotient = F.when(b == 0, infinite).otherwise(F.try_divide(a, b))
    return (
        F.when(operation == "add", a + b)
        .when(operation == "subtract", a - b)
        .when(operation == "multiply", a * b)
        .when(operation == "divide", quotient)
        .when(operation == "percent", F.when(b == 0, infinite).otherwise(quotient * 100))
        .when(operation == "diff", F.abs(a - b))
        .when(operation == "max", F.array_max(values))
        .when(operation == "min", F.array_min(values))
        .when(operation == "sum", _total(values))
        .when(operation == "avg", F.when(is_list, _total(values) / F.size(values)).otherwise(0.0))
    )


def _values(state: Column, s: Column, strict: bool) -> Column:
    """Arguments of a statement as numbers; NULL where a name is unknown."""
    variables = state["variables"]
    constant = s["constant"]
    if not strict:
        constant = F.coalesce(constant, F.try_element_at(variables, s["body"]))
    return F.when(s["operation"].isNull(), F.array(constant)).otherwise(
        F.transform(
            s["items"],
            lambda name, i: F.coalesce(
                F.try_element_at(variables, name), F.get(s["literals"], i)
            ),
        )
    )


def _evaluate(values: Column, s: Column) -> Column:
    """struct<operation, arguments, result, problem> of one statement."""
    is_call = s["operation"].isNotNull()
    gap = F.array_position(F.transform(values, lambda v: v.isNull()), F.lit(True))
    wrong_count = s["operation"].isin(_BINARY) & (s["is_list"] | (F.size(s["items"]) != 2))
    problem = (
        F.when(~is_call & (gap > 0), F.concat(F.lit("Invalid expression: "), s["body"]))
        .when(
            ~s["operation"].isin(OPERATIONS),
            F.concat(F.lit("Unknown operation: "), s["operation"]),
        )
        .when(
            gap > 0,
            F.concat(
                F.when(s["is_list"], F.lit("Invalid list item: ")).otherwise(
                    F.lit("Invalid argument: ")
                ),
                F.get(s["items"], (gap - 1).cast("int")),
            ),
        )
        .when(
            is_call & wrong_count,
            F.concat(F.lit("Wrong number of arguments: "), s["operation"]),
        )
    )
    return let(
        problem,
        lambda p: F.struct(
            F.coalesce(s["operation"], F.lit("const")).alias("operation"),
            values.alias("arguments"),
            F.when(
                p.isNull(),
                F.when(is_call, _apply(s["operation"], values, s["is_list"])).otherwise(
                    F.get(values, F.lit(0))
                ),
            ).alias("result"),
            p.alias("problem"),
        ),
    )


def _advance(state: Column, s: Column, strict: bool) -> Column:
    def record(step: Column) -> Column:
        failed = step["problem"].isNotNull()
        reassigned = F.map_contains_key(state["variables"], s["name"])
        kept = F.when(
            reassigned, F.map_filter(state["variables"], lambda k, _: k != s["name"])
        ).otherwise(state["variables"])
        return F.struct(
            F.when(failed, state["variables"])
            .otherwise(F.map_concat(kept, F.create_map(s["name"], step["result"])))
            .alias("variables"),
            F.when(failed, state["steps"])
            .otherwise(
                F.array_append(
                    state["steps"],
                    F.struct(
                        step["operation"].alias("operation"),
                        step["arguments"].alias("arguments"),
                        step["result"].alias("result"),
                    ),
                )
            )
            .alias("steps"),
            F.when(
                failed,
                F.concat(
                    F.lit("Error executing line '"), s["line"], F.lit("': "), step["problem"]
                ),
            ).alias("error"),
        )

    return F.when(state["error"].isNotNull(), state).otherwise(
        let(let(_values(state, s, strict), lambda v: _evaluate(v, s)), record)
    )


def execute_program(text: Column, strict: bool = False) -> Column:
    """struct<final_answer, steps, variables, error>. The answer is the variable
    `answer`, else the last step; the first failing line stops the program."""
    start = F.struct(
        F.create_map().cast("map<string,double>").alias("variables"),
        F.array().cast(f"array<{PROGRAM_STEP}>").alias("steps"),
        F.lit(None).cast("string").alias("error"),
    ).cast(_STATE)
    state = F.aggregate(
        _statements(text, strict), start, lambda acc, s: _advance(acc, s, strict)
    )
    return let(
        state,
        lambda s: F.struct(
            F.when(
                s["error"].isNull(),
                F.coalesce(
                    F.try_element_at(s["variables"], F.lit("answer")),
                    F.try_element_at(s["steps"], F.lit(-1))["result"],
                ),
            ).alias("final_answer"),
            s["steps"].alias("steps"),
            s["variables"].alias("variables"),
            s["error"].alias("error"),
        ),
    )


def program_literals(text: Column, strict: bool = False) -> Column:
    """Numbers written in a program. Unless strict, digits that belong to a name
    such as const_0 are not numbers."""
    code = F.array_join(program_lines(text), "\n")
    if not strict:
        code = F.regexp_replace(code, r"[A-Za-z_]\w*", " ")
    found = F.regexp_extract_all(code, F.lit(f"({SIGNED_NUMBER})"), F.lit(1))
    return F.transform(found, lambda m: m.try_cast("double"))


def first_unknown_literal(
    text: Column, available: Column, tolerance: float = 1e-6, strict: bool = False
) -> Column:
    """First number of the program that the evidence does not hold, or NULL."""
    return F.get(
        F.filter(
            program_literals(text, strict), lambda n: ~has_match(n, available, tolerance)
        ),
        F.lit(0),
    )


def split_response(response: Column) -> Column:
    """struct<reasoning, program> of a model response."""
    program = F.when(
        response.contains(PROGRAM_MARK),
        strip(F.split_part(response, F.lit(PROGRAM_MARK), F.lit(2))),
    ).otherwise(strip(response))
    reasoning = F.when(
        response.contains(PROGRAM_MARK) & response.contains(REASONING_MARK),
        strip(
            F.replace(
                F.split_part(response, F.lit(PROGRAM_MARK), F.lit(1)),
                F.lit(REASONING_MARK),
                F.lit(""),
            )
        ),
    ).otherwise(F.lit(""))
    return F.struct(reasoning.alias("reasoning"), program.alias("program"))
