"""Question sets: JSON files with one array of examples per split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.numbers import cell_numbers, plain_numbers
from ledgerloom.session import materialise
from ledgerloom.sources.json_array import read_json_array

SPLITS = ("train", "validation", "test")

# Program and gold evidence may sit beside or inside `qa`; programs may be text or
# a list of lines. VARIANT keeps whatever is there.
_RAW = """id string, uid string, pre_text array<string>, post_text array<string>,
       table array<array<string>>, program variant, gold_inds map<string,string>,
       qa struct<question:string,answer:string,program:variant,gold_inds:map<string,string>>"""


def _program_text(program: Column) -> Column:
    listed = F.try_variant_get(program, "$", "array<string>")
    return F.coalesce(
        F.array_join(listed, "\n"), F.try_variant_get(program, "$", "string")
    )


def load_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Examples of one split with their `place` in the file; raises if the file is missing
    or is no array of objects. The file is read in as many tasks as it has ranges. An example without id and uid is numbered by its place."""
    parsed = F.from_json("value", _RAW)
    raw = read_json_array(spark, f"{root}/{split}.json").select(parsed.alias("_e"), "place")
    raw = raw.select("_e.*", "place")
    empty = F.array().cast("array<string>")
    return raw.select(
        F.coalesce("id", "uid", F.col("place").cast("string")).alias("id"),
        F.coalesce("qa.question", F.lit("")).alias("question"),
        F.coalesce("pre_text", empty).alias("pre_text"),
        F.coalesce("post_text", empty).alias("post_text"),
        F.coalesce("table", F.array().cast("array<array<string>>")).alias("table"),
        F.coalesce("qa.answer", F.lit("")).alias("answer"),
        F.coalesce(_program_text(F.col("qa.program")), _program_text(F.col("program"))).alias(
            "program"
        ),
        F.coalesce("gold_inds", "qa.gold_inds").alias("gold_inds"),
        "place",
    )


def load_all_splits(spark: SparkSession, root: str) -> DataFrame:
    """All splits that exist, with a `split` column."""
    found = None
    for split in SPLITS:
        try:
            part = load_split(spark, root, split).withColumn("split", F.lit(split))
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise FileNotFoundError(f"no split of {', '.join(SPLITS)} under {root}")
    return found


def example_by_id(examples: DataFrame, example_id: str) -> DataFrame:
    """The first example with the id; raises ValueError if there is none."""
    hit = examples.filter(F.col("id") == example_id).limit(1)
    if hit.isEmpty():
        raise ValueError(f"Example {example_id} not found")
    return hit


def first_examples(examples: DataFrame, n: int) -> DataFrame:
    """The first n examples in file order, computed once so that every reader of the result
    has the same ones."""
    order = ["place", "id"] if "place" in examples.columns else ["id"]
    return materialise(examples.orderBy(*order).limit(n))


def example_numbers(examples: DataFrame) -> DataFrame:
    """(id, numbers): every number of an example's texts, then of its table."""
    texts = F.flatten(F.transform(F.concat("pre_text", "post_text"), plain_numbers))
    cells = F.flatten(F.transform(F.flatten("table"), cell_numbers))
    return examples.select("id", F.concat(texts, cells).alias("numbers"))
