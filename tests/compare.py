"""Run registered queries against their SQL twins.

    python -m tests.compare [sf or folder] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanery-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return f"{type(value).__name__}:{value}"


def compare(spark, con, sf_dir, fn, sql) -> str:
    """Empty when the results agree, else what differs."""
    df = fn(spark, sf_dir)
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    gi = sorted(range(len(got_cols)), key=lambda i: got_cols[i])
    wi = sorted(range(len(want_cols)), key=lambda i: want_cols[i])
    a = Counter(tuple(_plain(r[i]) for i in gi) for r in got)
    b = Counter(tuple(_plain(r[i]) for i in wi) for r in want)
    if a != b:
        return f"{sorted(got_cols)}\n      rows {len(got)} vs {len(want)}; spark only {list((a - b).items())[:3]}; sql only {list((b - a).items())[:3]}"
    return "" if got else "no rows"


def main(argv: list[str]) -> int:
    from gleanery.queries import all_oracles, all_queries

    sf = argv[0] if argv else "0.01"
    sf_dir = sf if "/" in sf else f"/root/testdata/sf{sf}"
    spark, con = session(), oracle(sf_dir)
    bad = 0
    oracles = all_oracles()
    for name, fn in all_queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, con, sf_dir, fn, oracles[name])
            else:
                verdict = "" if fn(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(verdict)
        mark = "FAIL" if verdict else ("ok" if name in oracles else "ok (rows only)")
        print(f"{name:40s} {mark:15s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
