"""Run registered queries in Spark and their SQL in DuckDB, compare columns, types and every value.

    python tests/compare.py [scale] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime):
        return value.isoformat()
    return repr(value)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences, empty when the results are equal as multisets."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    for field in spark_df.schema:
        wanted = KINDS.get(kinds[field.name], kinds[field.name])
        if field.dataType.simpleString() != wanted:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} != {kinds[field.name]}")
    order = sorted(names)
    place = [names.index(n) for n in order]
    want = sorted(tuple(cell(r[i]) for i in place) for r in expected)
    have = sorted(tuple(cell(r[n]) for n in order) for r in spark_df.collect())
    if len(want) != len(have):
        problems.append(f"{len(have)} rows != {len(want)}")
    if want != have:
        only = [r for r in have if r not in set(want)][:2], [r for r in want if r not in set(have)][:2]
        problems.append(f"values over {order}: spark {only[0]} duckdb {only[1]}")
    return problems


def main() -> int:
    import __spark_entry__ as contract
    from wayfare.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    chosen = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{scale}"
    spark, con = local_session(8), connect(sf_dir)
    oracles, bad, done = contract.oracle_sql(), 0, 0
    for name, run in contract.queries().items():
        if name not in oracles or (chosen and name not in chosen):
            continue
        start = time.time()
        try:
            problems = compare(run(spark, sf_dir), con, oracles[name])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        done += 1
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} {time.time() - start:5.2f}s {' | '.join(problems)}", flush=True)
    missing = [n for n in oracles if n not in contract.queries()]
    print(f"{done - bad} of {done} equal; oracles without a query: {missing}")
    return 1 if bad or missing else 0


if __name__ == "__main__":
    sys.exit(main())
