"""Run every registered query against its SQL: python tests/check_all.py [sf_dir] [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.oracle import connect, differences

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sql:
                diff = differences(query(spark, sf), con, sql[name])
            else:
                diff = [] if query(spark, sf).count() else ["no rows"]
        except Exception as error:
            diff = [f"{type(error).__name__}: {str(error)[:1500]}"]
        print("ok  " if not diff else "FAIL", name, round(time.time() - start, 2), flush=True)
        for line in diff:
            print("     ", line)
        bad += [name] if diff else []
    print("failed:", bad)
