"""Compare every query with its SQL on one data folder: ``python -m pulsewake.plans.check DIR [name …]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from pulsewake.plans import catalogue
from pulsewake.plans.inputs import TABLES
from pulsewake.runtime import build_session


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(round(float(value), 9) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((str([plain(row[i]) for i in order]) for row in rows))


def compare(spark, con, folder: str, name: str) -> str:
    df = catalogue.QUERIES[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    if name not in catalogue.ORACLES:
        return f"rows only ({len(got)})"
    result = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} <> {sorted(names)}"
    odd = [f"{n}:{k}" for n, k in zip(names, kinds) if k in ("HUGEINT", "UHUGEINT") or k.startswith("DECIMAL")]
    if odd:
        return f"TYPES {odd}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"VALUES {len(got)} rows, wanted {len(want)}\n   got    {str(extra)[:900]}\n   wanted {str(missing)[:900]}"
    return f"ok ({len(got)})"


def main() -> int:
    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = build_session("check", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in catalogue.QUERIES:
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        begin = time.time()
        try:
            verdict = compare(spark, con, folder, name)
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        wrong = not verdict.startswith(("ok", "rows only"))
        bad += wrong
        print(f"{'!!' if wrong else '  '} {name:45s} {time.time() - begin:6.2f}s {verdict}", flush=True)
    print(f"{bad} wrong of {len(catalogue.QUERIES)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
