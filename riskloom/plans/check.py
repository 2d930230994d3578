"""Local oracle check: run a registered query on Spark and its SQL on DuckDB over the same
parquet files and compare row count, column names and values (order-insensitive)."""

from __future__ import annotations

import math

from riskloom.sources.tables import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, entry, sf_dir: str) -> dict:
    sp = entry.fn(spark, sf_dir).toPandas()
    dk = con.execute(entry.sql).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dk)
    res = {"name": entry.name, "rows_spark": len(r1), "rows_sql": len(r2),
           "columns_match": c1 == c2, "values_match": c1 == c2 and r1 == r2}
    if not res["values_match"]:
        res["columns"] = (c1, c2)
        diff = [(a, b) for a, b in zip(r1, r2) if a != b][:3]
        res["first_diffs"] = diff
    return res


def main(argv=None) -> int:
    """``python -m riskloom.plans.check [SF_DIR] [name,name,...] [--sql-only]``: run the
    registered queries (all, or the named ones) and compare each with its oracle SQL;
    queries without SQL are run and counted. Exit status 1 on any mismatch or error."""
    import sys
    import time

    from riskloom.plans.registry import load_all
    from riskloom.session import get_spark

    args = [a for a in (argv if argv is not None else sys.argv[1:]) if not a.startswith("--")]
    sql_only = "--sql-only" in (argv if argv is not None else sys.argv[1:])
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = set(args[1].split(",")) if len(args) > 1 else None
    spark = get_spark()
    con = duckdb_connection(sf_dir)
    bad = 0
    for name, entry in load_all().items():
        if names and name not in names:
            continue
        if entry.sql is None and sql_only:
            continue
        t0 = time.time()
        try:
            if entry.sql is None:
                n = entry.fn(spark, sf_dir).count()
                print(f"{name:32s} rows-only {n} {time.time() - t0:.1f}s", flush=True)
                continue
            r = compare(spark, con, entry, sf_dir)
            ok = r["values_match"] and r["rows_spark"] == r["rows_sql"]
            bad += not ok
            print(f"{name:32s} {'OK ' if ok else 'BAD'} rows={r['rows_spark']}/{r['rows_sql']} "
                  f"{time.time() - t0:.1f}s" + ("" if ok else f" {r.get('first_diffs')}"), flush=True)
        except Exception as ex:  # report and continue with the next query
            bad += 1
            print(f"{name:32s} ERROR {type(ex).__name__}: {str(ex)[:300]}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
