"""Compare registered queries with their SQL in DuckDB, as the driver does: python tests/compare.py SF NAME..."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return str(v)
        return "NULL" if pd.isna(v) else f"{v:.15g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def difference(spark, con, sf_dir, make, sql):
    """None if equal, else what differs."""
    ours, theirs = make(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if a == b:
        return None
    in_a, in_b = set(a), set(b)
    left, right = [x for x in a if x not in in_b], [x for x in b if x not in in_a]
    return f"{len(a)} and {len(b)} rows; only ours {len(left)}: {left[:3]}; only theirs {len(right)}: {right[:3]}"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    con, q, o = connect(sf_dir), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or q:
        began = time.time()
        try:
            said = difference(spark, con, sf_dir, q[name], o[name]) if name in o else f"{q[name](spark, sf_dir).toPandas().shape} rows only"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {str(x)[:1500]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
