"""Run registered queries and their SQL side by side and compare the values."""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        values = frame[name]
        if pd.api.types.is_bool_dtype(values):
            frame[name] = values.map(lambda v: str(bool(v)))
        elif pd.api.types.is_float_dtype(values):
            frame[name] = values.map(lambda v: "null" if pd.isna(v) else repr(float(v) + 0.0))
        else:
            frame[name] = values.map(lambda v: "null" if v is None or v is pd.NA or v != v else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(spark, connection, name: str, function, sql: str, folder: str) -> tuple[bool, str]:
    start = time.time()
    ours = function(spark, folder).toPandas()
    middle = time.time()
    theirs = connection.execute(sql).df()
    took = f"spark {middle - start:.1f}s sql {time.time() - middle:.1f}s rows {len(ours)}"
    if sorted(ours.columns) != sorted(theirs.columns):
        return False, f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return False, f"{len(ours)} rows != {len(theirs)} rows; {took}"
    for column in ours.columns:  # integral floats (nullable ints) compare as integers
        for frame, other in ((ours, theirs), (theirs, ours)):
            if pd.api.types.is_float_dtype(frame[column]) and pd.api.types.is_integer_dtype(other[column]):
                frame[column] = frame[column].astype("Int64")
    left, right = normal(ours), normal(theirs)
    different = (left != right).any(axis=1)
    if different.any():
        at = int(different.values.argmax())
        return False, (f"{int(different.sum())} of {len(left)} rows differ; {took}\n"
                       f"  ours   {left.iloc[at].to_dict()}\n  theirs {right.iloc[at].to_dict()}")
    return True, took


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from crossmer.oracles import oracle_queries
    from crossmer.queries import all_queries

    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sqls, registered = oracle_queries(), all_queries()
    link = connect(args.dir)
    for name in args.names or registered:
        if name not in sqls:
            start = time.time()
            rows = registered[name](spark, args.dir).count()
            print(f"ROWS {name}: {rows} rows {time.time() - start:.1f}s", flush=True)
            continue
        try:
            ok, text = compare(spark, link, name, registered[name], sqls[name], args.dir)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {text}", flush=True)
