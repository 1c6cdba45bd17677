"""Run a registered query and its SQL side by side.

``python -m tests.compare FOLDER [name…]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return "nan" if v != v else v
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def _kind(name: str) -> str:
    """Type families of both engines under one name."""
    name = name.lower().split("(")[0]
    return {
        "bigint": "long", "integer": "int", "varchar": "string", "timestamp_ntz": "timestamp", "long": "long",
        "timestamp without time zone": "timestamp",
    }.get(name, name)


def differences(spark, con, folder: str, fn, sql: str) -> str | None:
    """None when names, types and all values agree; otherwise what differs."""
    got = fn(spark, folder)
    expected = con.execute(sql)
    want_names = [d[0] for d in expected.description]
    want_types = {d[0]: _kind(str(d[1])) for d in expected.description}
    want = expected.fetchall()
    if sorted(got.columns) != sorted(want_names):
        return f"columns {sorted(got.columns)} against {sorted(want_names)}"
    types = {f.name: _kind(f.dataType.simpleString()) for f in got.schema.fields}
    have = [tuple(r) for r in got.collect()]
    a, b = _rows(got.columns, have), _rows(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        only_a, only_b = [x for x in a if x not in set(b)], [y for y in b if y not in set(a)]
        return f"{len(wrong)} rows differ; here {only_a[:2]} there {only_b[:2]}"
    off = {c: (types[c], want_types[c]) for c in types if types[c] != want_types[c]}
    return f"types {off}" if off else None


def main() -> None:
    from gleanframe.registry import ORACLES, QUERIES
    from gleanframe.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                problem = differences(spark, con, folder, QUERIES[name], ORACLES[name])
            else:
                problem = None if QUERIES[name](spark, folder).collect() is not None else "nothing"
        except Exception as e:  # noqa: BLE001  (the report goes on with the next query)
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} fail")


if __name__ == "__main__":
    main()
