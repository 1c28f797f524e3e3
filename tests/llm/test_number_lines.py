"""Rows of numbers are content, not templates."""

from __future__ import annotations

import random

from clauselake.llm import lines


def cut(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.text, r.lines_cut) for r in lines.drop_recurring_lines(df).collect()}


def test_rows_of_different_numbers_stay(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(str(rng.randrange(10, 99)) for _ in range(8)) for _ in range(3))) for i in range(5)]
    rows += [(10 + i, " ".join(str(rng.randrange(10, 99)) for _ in range(4))) for i in range(12)]
    rows += [(30 + i, f"total {i} of {i + 1} 7 8 9 {i}0 {i}1") for i in range(5)]
    assert cut(spark, rows) == {i: (t, 0) for i, t in rows}


def test_equal_rows_of_numbers_go(spark):
    table = "12 34 56 78 90 11 22 33"
    rows = [(i, f"own {'abc'[i]} line\n{table}") for i in range(3)]
    assert cut(spark, rows) == {0: (rows[0][1], 0), 1: ("own b line", 1), 2: ("own c line", 1)}


def test_half_of_a_line_must_be_constant(spark):
    rows = [(1, "request 17 took 20 ms on 8 node"), (2, "request 18 took 25 ms on 9 node"),
            (3, "a 1 b 2 c 3 4 5 6 7"), (4, "a 2 b 3 c 4 5 6 7 8"), (5, "one 2 3 4 5 6 7 8"), (6, "one 3 4 5 6 7 8 9")]
    got = cut(spark, rows)
    assert got[1][1] == 0 and got[2] == ("", 1) and all(got[i][1] == 0 for i in (3, 4, 5, 6))


def test_white_space_between_numbers_does_not_matter(spark):
    rows = [(1, "12 34 56 78 90 11 22 33"), (2, "12\t34 56  78 90 11 22 33 ")]
    assert cut(spark, rows)[2] == ("", 1)


def test_cuts_are_written_before_the_texts_are_shuffled(spark):
    """The written lines are free to go: the result reads the cut places alone, not every line again."""
    docs = spark.createDataFrame([(i, f"own {i} words\nthe very same line of eight words here") for i in range(6)], "doc_id long, text string")
    out = lines.drop_recurring_lines(docs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
    assert [r.lines_cut for r in out.orderBy("doc_id").collect()] == [0, 1, 1, 1, 1, 1]
