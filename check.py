"""Run registered queries next to their SQL equivalents: ``python check.py [--sf 0.01] [names...]``.

Prints rows, seconds and agreement per query.
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from digestry.catalog import ORACLES, QUERIES
from digestry.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(df, sf_dir: str, sql: str) -> str:
    start = time.time()
    rows = [tuple(r) for r in df.collect()]
    middle = time.time()
    names, expected = oracle_rows(sf_dir, sql)
    took = f"(spark {middle - start:.1f}s sql {time.time() - middle:.1f}s)"
    if sorted(df.columns) != sorted(names):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"

    def canon(columns, data):
        at = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(tuple(plain(row[i]) for i in at) for row in data)

    mine, theirs = canon(df.columns, rows), canon(names, expected)
    if mine == theirs:
        return f"ok {len(rows)} {took}"
    missing = [r for r in theirs if r not in set(mine)][:2]
    extra = [r for r in mine if r not in set(theirs)][:2]
    return f"DIFF {len(rows)} vs {len(expected)} spark={str(extra)[:600]} sql={str(missing)[:600]}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in args.names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                outcome = compare(df, sf_dir, ORACLES[name])
            else:
                outcome = f"rows {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            outcome = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:20s} {time.time() - start:6.1f}s {outcome}", flush=True)


if __name__ == "__main__":
    main()
