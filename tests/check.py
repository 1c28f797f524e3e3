"""Run queries against their SQL: ``python -m tests.check [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

import __spark_entry__
from clauselake.session import recommended_conf
from tests.oracle import compare, connect


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    names = sys.argv[2:]
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.driver.memory", "12g"
    ).config("spark.ui.showConsoleProgress", "false")
    for k, v in recommended_conf(8).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    con = connect(f"/root/testdata/{sf}")
    bad = 0
    for name in names or found:
        start = time.time()
        try:
            df = found[name](spark, f"/root/testdata/{sf}")
            if name in sql:
                said = compare(df, con, sql[name]) or "ok"
                n = ""
            else:
                said, n = "rows only", df.count()
        except Exception as e:  # noqa: BLE001
            said, n = f"{type(e).__name__}: {str(e)[:700]}", ""
        bad += said not in ("ok", "rows only")
        print(f"{name:32s} {time.time() - start:6.1f}s {n} {said}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
