"""Run every registered query against its SQL: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import math
import signal
import sys
import time
from collections import Counter

import duckdb

from agora.session import local_session

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


LIMIT_SECONDS = 100


def _too_slow(*_):
    raise TimeoutError(f"more than {LIMIT_SECONDS} s")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{v:.6g}") if isinstance(v, float) and abs(v) >= 1e9 else v


def compare(spark, con, name: str, run, sql: str | None, folder: str) -> tuple[bool, str]:
    df = run(spark, folder)
    names = sorted(df.columns)
    rows = Counter(tuple(_value(r[c]) for c in names) for r in df.collect())
    total = sum(rows.values())
    if sql is None:
        return True, f"{total} rows, no SQL"
    result = con.execute(sql)
    order = [d[0] for d in result.description]
    if sorted(order) != names:
        return False, f"columns {names} against {sorted(order)}"
    at = [order.index(c) for c in names]
    expected = Counter(tuple(_value(r[i]) for i in at) for r in result.fetchall())
    if rows == expected:
        return True, f"{total} rows"
    only_spark = list((rows - expected).elements())[:3]
    only_sql = list((expected - rows).elements())[:3]
    cut = lambda rs: [tuple(str(x)[:60] for x in r) for r in rs]
    return False, (
        f"{total} rows against {sum(expected.values())}; {names}\n    spark {cut(only_spark)}\n    sql   {cut(only_sql)}"
    )


def main(folder: str, wanted: list[str]) -> int:
    from checks import ORACLES, QUERIES

    spark, con = local_session(), connect(folder)
    failed = 0
    signal.signal(signal.SIGALRM, _too_slow)
    for name, run in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.monotonic()
        signal.alarm(LIMIT_SECONDS)
        try:
            ok, note = compare(spark, con, name, run, ORACLES.get(name), folder)
        except Exception as error:  # noqa: BLE001 - reported per query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        signal.alarm(0)
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.monotonic() - started:.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    place = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(min(main(place, args), 1))
