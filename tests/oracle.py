"""Runs every query with SQL on both engines and compares rows: python tests/oracle.py [sf] [name ...]."""

import os
import sys
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted((tuple(sorted((k, round(v, 6) if isinstance(v, float) else str(v)) for k, v in zip(df[0], r, strict=True))) for r in df[1]), key=str)


def compare(spark, sf_dir, name, f, sql):
    df = f(spark, sf_dir)
    got = (df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"{len(got[1])} rows"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.sql(sql)
    want = (res.columns, res.fetchall())
    a, b = rows(got), rows(want)
    if a != b:
        both = set(map(str, a)) ^ set(map(str, b))
        raise AssertionError(f"{name}: {len(a)} and {len(b)} rows; differ: {sorted(both)[:4]}")
    kinds = [(n, t) for n, t in df.dtypes]
    return f"{len(a)} rows equal {kinds} {list(map(str, res.types))}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import kgraph.plans.queries as Q

    os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1])
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file:///tmp/oracle-shared").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, *names = sys.argv[1:] or ["sf0.01"]
    for name, f in Q.queries().items():
        if not names or name in names:
            try:
                print("ok ", name, compare(spark, f"/root/testdata/{sf}", name, f, Q.oracle_sql().get(name)), flush=True)
            except Exception as e:
                print("BAD", name, (str(e) or traceback.format_exc())[:700].replace("\n", " "), flush=True)
