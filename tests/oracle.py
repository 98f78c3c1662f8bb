"""Compares queries with their SQL on a scale: python tests/oracle.py [sf_dir] [name...]"""

import os
import sys

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sf_dir, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db.sql(sql).df()


def normal(df):
    rows = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted((tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows.itertuples(index=False)))


def differs(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), expected(sf_dir, sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    return None if a == b else f"{len(a)} rows, {len(b)} expected; {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    for name, sql in entry.oracle_sql().items():
        if not sys.argv[2:] or name in sys.argv[2:]:
            try:
                print(name, differs(spark, sf, entry.queries()[name], sql) or "ok", flush=True)
            except Exception as e:
                print(name, "ERROR", str(e)[:600], flush=True)
