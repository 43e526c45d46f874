"""Run the registered queries beside their SQL: ``python tests/check_suite.py [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from pagewright.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def main(names, folder="/root/testdata/sf0.01"):
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - t0
            if name not in checks:
                print(f"rows-only {name}: {len(got[1])} rows {took:.1f}s", flush=True)
                continue
            cursor = db.execute(checks[name])
            want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
            ok = got == want
            kinds = {f.name: f.dataType.simpleString() for f in df.schema}
            same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
            odd = {d[0]: (kinds.get(d[0]), str(d[1])) for d in cursor.description
                   if same.get(kinds.get(d[0])) != str(d[1])}
            if odd:
                print("   types", odd)
            print(f"{'ok ' if ok else 'BAD'} {name}: {len(got[1])} rows spark {took:.1f}s sql {time.time() - t0 - took:.1f}s",
                  flush=True)
            if not ok:
                bad += 1
                print("   columns", got[0], want[0], len(want[1]))
                for a, b in zip(got[1], want[1]):
                    if a != b:
                        print("   spark", repr(a)[:700])
                        print("   sql  ", repr(b)[:700])
                        break
        except Exception as reason:
            bad += 1
            print(f"ERR {name}: {str(reason)[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
