"""JSON arrays read in splits against the reader that takes a file whole."""

import json
import random

import pytest

from clauselake import schemas
from clauselake.sources import arrays, readers

SCHEMA = "a int, b string, c struct<x: int, y: array<struct<z: string>>>, d map<string, string>"


def objects(n):
    rng = random.Random(6)
    odd = ['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "\\\\", '\\"', "}}", "x" * 40, "", '"}', '{"']
    out = []
    for i in range(n):
        text = "".join(rng.choices(odd, k=rng.randrange(8)))
        out.append({"a": i, "b": text, "c": {"x": i, "y": [{"z": text[::-1]} for _ in range(rng.randrange(3))]},
                    "d": {text: "{", "}": text}} if i % 4 else {"b": None, "a": i})
    return out


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", ["37b", "500b", "64m"])
def test_equals_the_whole_file_reader(spark, tmp_path, indent, split):
    for f in range(3):
        (tmp_path / f"{f}.json").write_text(json.dumps(objects(60 + f), indent=indent, ensure_ascii=f == 1) + "\n" * f)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        got = arrays.read_json_array(spark, str(tmp_path), SCHEMA)
        rows = sorted(map(repr, got.collect()))
    finally:
        spark.conf.set(key, before)
    want = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    assert rows == sorted(map(repr, want.collect())) and len(rows) == 183


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(objects(500)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2k")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert arrays.read_json_array(spark, str(tmp_path), SCHEMA).count() == 500
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("text, n", [("", 0), ("[]", 0), (" [\n] ", 0), ('[{"a": 1}', 1), ('[{"a": 1}, {"a": 2, "b": "x', 1), ('{"a": 7}', 1),
                                     ('﻿[{"a": 1}]', 1), ('[{"a": 1},\n\n{"a": "no number"}]', 2)])
def test_odd_files(spark, tmp_path, text, n):
    path = tmp_path / "a.json"
    path.write_text(text)
    assert arrays.read_json_array(spark, str(path), SCHEMA).count() == n


def test_analysis_log_as_before(spark, tmp_path):
    path = tmp_path / "analyses.json"
    rows = [{"id": str(i), "domain": f"d{i}.com", "timestamp": "2024-01-01T00:00:00.000Z", "success": True, "score": i, "error": "}{" * i}
            for i in range(20)]
    path.write_text(json.dumps(rows, indent=1))
    got = readers.read_analysis_log(spark, str(path))
    want = spark.read.schema(schemas.ANALYSIS_LOG).option("multiLine", True).json(str(path))
    assert sorted(map(tuple, got.select("id", "timestamp", "error").collect())) == sorted(map(tuple, want.select("id", "timestamp", "error").collect()))
