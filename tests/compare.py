"""Compare catalog queries with their SQL counterparts: python tests/compare.py SF [name…]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


DIGITS = "EXACT" not in os.environ


def normal(value):
    if isinstance(value, float):
        return float(f"{value:.12g}") if DIGITS else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(normal(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r),
    )


def differences(spark, con, name, query, sql, sf_dir):
    """None if both engines agree, else a short description."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows / {len(theirs)} rows"
    types = dict(df.dtypes)
    other = dict(zip(columns, [str(d[1]) for d in result.description]))
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for c, t in types.items():
        if kinds.get(t) != other[c]:
            return f"type of {c}: {t} / {other[c]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} / {b}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = oracle_sql()
    names = sys.argv[2:] or list(queries())
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                bad = differences(spark, con, name, queries()[name], sqls[name], sf_dir)
                outcome = bad and f"DIFF {str(bad)[:600]}" or "ok"
            else:
                outcome = f"rows only: {queries()[name](spark, sf_dir).count()}"
        except Exception as e:
            outcome = f"ERROR {type(e).__name__} {str(e)[:700]}"
        print(f"{name:40s} {time.time() - start:6.2f}s {outcome}", flush=True)
