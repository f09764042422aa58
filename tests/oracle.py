"""Run a query on Spark and its SQL twin on DuckDB, and compare schema and values.

Usable as a script: ``python tests/oracle.py [folder] [query ...]``.
"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from panelkit.queries import QUERIES, SQL  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def _rows(columns, names, rows):
    order = [names.index(c) for c in columns]
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    df = QUERIES[name](spark, folder)
    theirs = con.execute(SQL[name])
    types = {d[0]: str(d[1]) for d in theirs.description}
    expected = theirs.fetchall()
    problems = []
    mine = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in df.schema.fields}
    if mine != types and sorted(mine.items()) != sorted(types.items()):
        problems.append(f"schema: {mine} != {types}")
    if sorted(mine) != sorted(types):
        return problems
    columns = sorted(mine)
    a = _rows(columns, df.columns, df.collect())
    b = _rows(columns, list(types), expected)
    if a != b:
        problems.append(f"rows: {sum(a.values())} and {sum(b.values())}, "
                        f"only here {list((a - b))[:3]}, only there {list((b - a))[:3]}")
    return problems


def main() -> None:
    from panelkit.runtime import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        started = time.perf_counter()
        try:
            if name in SQL:
                problems = compare(spark, con, name, folder)
            else:
                problems = [] if QUERIES[name](spark, folder).count() >= 0 else ["no rows"]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.perf_counter() - started:.2f}s")
        for p in problems:
            print("     ", p[:2500])
    print("failed:", failed)


if __name__ == "__main__":
    main()
