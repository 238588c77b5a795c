"""Compares queries with their DuckDB SQL: python tests/oracle.py SF_DIR [NAME...]."""

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(float(r[i]), 6) if isinstance(r[i], float) else int(r[i]) if isinstance(r[i], bool) else str(r[i]) if r[i].__class__.__name__ == "Decimal" else r[i] for i in order) for r in rows)


def compare(spark, sf_dir, name, run, sql):
    df = run(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.execute(sql)
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns), (name, columns, df.columns)
    want, got = rows_of(columns, res.fetchall()), rows_of(df.columns, df.collect())
    assert got == want, (name, sum(got.values()), sum(want.values()), list((got - want).items())[:2], list((want - got).items())[:2])
    return sum(got.values())


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sqls:
        began = time.time()
        try:
            print(name, compare(spark, sys.argv[1], name, queries[name], sqls[name]), "rows equal", round(time.time() - began, 1), flush=True)
        except Exception as e:
            print("DIFFERENT", name, str(e)[:600], flush=True)
