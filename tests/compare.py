"""Run registered queries and their SQL twins on the same folder and compare all rows.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
INTEGER_TYPES = {"byte", "short", "int", "long"}


def oracle_rows(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    order = sorted(names)
    rows = [tuple(r[names.index(n)] for n in order) for r in result.fetchall()]
    con.close()
    return order, types, rows


def spark_rows(df):
    order = sorted(df.columns)
    return order, {f.name: f.dataType.simpleString() for f in df.schema.fields}, [
        tuple(r[n] for n in order) for r in df.collect()]


def key(row):
    return tuple((v is None, str(v)) for v in row)


DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, folder, sql) -> str | None:
    names, types, got = spark_rows(df)
    want_names, want_types, want = oracle_rows(folder, sql)
    if names != want_names:
        return f"columns {names} against {want_names}"
    wrong = [(n, types[n], want_types[n]) for n in names if DUCK.get(types[n]) != want_types[n]]
    got, want = sorted(got, key=key), sorted(want, key=key)
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} rows against {len(want)}; first differences {bad}"
    if wrong:
        return f"types differ: {wrong}"
    return None


def main(argv):
    from spanloom.session import local_session

    import __spark_entry__ as entry

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("compare", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                problem = differences(df, folder, oracle[name])
                status = "ok" if problem is None else "DIFFERENT " + str(problem)[:1500]
            else:
                status = f"rows {df.count()}"
        except Exception as e:  # report and go on
            status = f"ERROR {str(e)[:1500]}"
        if status.startswith(("DIFF", "ERR")):
            failed.append(name)
        print(f"{name:32s} {time.time() - start:6.1f}s  {status}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
