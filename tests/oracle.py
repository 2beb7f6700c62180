"""Runs registered queries beside DuckDB and compares row counts, column names and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is not None, str(type(x).__name__) if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in row)


def rows_of(pdf_cols, records):
    order = sorted(range(len(pdf_cols)), key=lambda i: pdf_cols[i])
    return [pdf_cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in records), key=_key)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def type_differences(spark_df, con, sql):
    """Columns whose DuckDB type is not the counterpart of the Spark type."""
    want = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    return [f"{n}: {t} / {want.get(n)}" for n, t in spark_df.dtypes if TYPES.get(t, t) != want.get(n)]


def compare(name, spark_df, con, sql):
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = rows_of(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not _same(g, w)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. spark {bad[0][0]} duckdb {bad[0][1]} cols {got_cols}"
    return None if got else "no rows"


def _same(g, w):
    for a, b in zip(g, w):
        if isinstance(a, float) or isinstance(b, float):
            if (a is None) != (b is None) or (a is not None and abs(a - b) > 2e-6 * max(1, abs(a))):
                return False
            if type(a) is not type(b):
                return False
        elif isinstance(a, tuple) and isinstance(b, tuple):
            if len(a) != len(b) or not _same(a, b):
                return False
        elif a != b or type(a) is not type(b):
            return False
    return True


def main(argv):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from boxlens.session import build_session

    folder = argv[0]
    picks = argv[1:]
    spark = build_session("8")
    con = duck(folder)
    qs, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problem = compare(name, df, con, oracles[name])
                odd = type_differences(df, con, oracles[name])
                if odd:
                    print(f"types {name} {odd}", flush=True)
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as exc:  # report every query, then fail
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        tag = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        print(f"{tag} {name} {time.time() - t0:.1f}s{'' if name in oracles else ' (rows only)'}{'' if problem is None else ' ' + problem}", flush=True)
    print(f"failed {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
