"""Flat token files whatever the session says about file sizes."""

from __future__ import annotations

from clauselake.llm import tokencounts
from clauselake.llm.common import table

SF = "/root/testdata/sf0.001"


def test_a_limit_of_records_per_file_changes_nothing(spark):
    docs, key = table(spark, SF, "documents"), "spark.sql.files.maxRecordsPerFile"
    want = sorted(map(tuple, tokencounts.token_counts(docs).collect()))
    spark.conf.set(key, 7)
    try:
        got = sorted(map(tuple, tokencounts.token_counts(docs).collect()))
    finally:
        spark.conf.unset(key)
    assert got == want and len({n for _, n in want}) > 50
