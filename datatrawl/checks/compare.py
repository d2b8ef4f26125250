"""Run a query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from datatrawl.checks.oracles import ORACLES
from datatrawl.checks.queries import QUERIES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[int, list[str]]:
    """Number of rows and what differs (nothing, if all is well)."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(tuple(r) for r in df.select(*columns).collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return sum(ours.values()), [f"columns {columns} / {sorted(names)}"]
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    found = []
    if sum(ours.values()) != sum(theirs.values()):
        found.append(f"rows {sum(ours.values())} / {sum(theirs.values())}")
    found += [f"only Spark {r} x{n}" for r, n in list((ours - theirs).items())[:3]]
    found += [f"only SQL {r} x{n}" for r, n in list((theirs - ours).items())[:3]]
    return sum(ours.values()), found
