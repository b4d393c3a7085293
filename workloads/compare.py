"""Run the queries beside their SQL: `python -m workloads.compare [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time

from pyspark.sql import SparkSession

from workloads.oracles import ORACLES
from workloads.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def duckdb_on(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """None when the query and its SQL agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if name not in ORACLES:
        return None
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if TYPES.get(kind) != types[field.name]:
            return f"{field.name}: {kind} against {types[field.name]}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a!r}\n   against {b!r}"
    return None


def main() -> None:
    from kermesse.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), duckdb_on(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # keep going: this is a report
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("   " + problem[:1500], flush=True)


if __name__ == "__main__":
    main()
