"""Arrays of JSON objects, cut at byte ranges that fall anywhere."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.json_array import read_json_array

AWKWARD = ["}", "{", "\\", '"', '\\"', "},{", "]", "[", "{}", "é€𝄞", "\n", "\t", "", ",", '"}', "\\\\}"]


def nested(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return "".join(rng.choice(AWKWARD) for _ in range(rng.randrange(6)))
    if kind == 1:
        return rng.choice([None, True, False, 0, -1.5, 10**12])
    if kind == 2:
        return {}
    if kind == 3:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(AWKWARD) + str(k): nested(rng, depth + 1) for k in range(rng.randrange(4))}


@pytest.fixture()
def small_ranges(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "211")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(folder, text):
    path = folder / "array.json"
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_objects_come_back_in_order(spark, small_ranges, tmp_path, layout):
    rng = random.Random(str(layout))
    items = [{"n": k, "body": nested(rng), "long": "x{" * rng.randrange(200)} for k in range(60)]
    path = write(tmp_path, json.dumps(items, **layout))
    read = read_json_array(spark, path)
    rows = sorted(read.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(60))
    assert [json.loads(r["value"]) for r in rows] == items
    raw = open(path, "rb").read()
    for r in rows:
        assert raw[r["offset"] :].lstrip(b"[, \n").startswith(r["value"].encode())
    tasks = spark.read.option("lineSep", "}").text(path).select(F.spark_partition_id()).distinct()
    assert tasks.count() > 8


def test_empty_arrays(spark, tmp_path):
    assert read_json_array(spark, write(tmp_path, " [ ]\n")).count() == 0
    assert read_json_array(spark, write(tmp_path, "")).count() == 0


@pytest.mark.parametrize(
    "text, offset",
    [
        ('[{"a": 1}, {"a": }, {"a": 2}]', 9),
        ('[{"a": 1} {"a": 2}]', 9),
        ('[{"a": 1}, 7, {"a": 2}]', 9),
        ('[{"a": 1}, {"a": 2}', 9),
        ('[{"a": 1}, {"a": {"b": 2}', 9),
        ('[{"a": 1}, {"a": "2}]', 9),
        ('[{"a": 1}] {"a": 2}', 9),
        ('[{"a": 1}, ]', 9),
        ('{"a": 1}', 0),
        ("[1, 2]", 0),
        ("hello", 0),
    ],
)
def test_what_is_broken_raises_with_its_offset(spark, tmp_path, text, offset):
    with pytest.raises(Exception, match=f"see byte {offset}"):
        read_json_array(spark, write(tmp_path, text)).collect()
