"""Compare registered queries with their SQL twins in DuckDB: names, row counts, values."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        if value != value:
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(cell(v) for v in value.values()) + "}"
    try:
        return repr(float(value)) if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    """Returns (ok, message)."""
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return bool(rows), f"rows-only {len(rows)} rows {took:.1f}s"
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want_types = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} vs {sorted(want_names)}"
    a, b = canonical(df.columns, rows), canonical(want_names, want)
    types = {c: t for c, t in df.dtypes}
    note = ""
    for c in df.columns:
        s, d = types[c], want_types[c]
        good = {"bigint": ["BIGINT"], "int": ["INTEGER"], "double": ["DOUBLE"], "string": ["VARCHAR", "STRING"],
                "boolean": ["BOOLEAN", "bool"]}.get(s)
        if good and d not in good:
            note += f" type[{c}: {s} vs {d}]"
    if a == b:
        return not note, f"{len(rows)} rows {took:.1f}s{note}"
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return False, f"{len(a)} vs {len(b)} rows\n   cols {sorted(df.columns)}\n   spark {only_a}\n   duck  {only_b}"


def main(argv):
    sys.path.insert(0, "/root/repo")
    sf = "0.01"
    if argv and argv[0].startswith("sf"):
        sf = argv.pop(0)[2:]
    import __spark_entry__ as entry
    from scorespark.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("FATAL" if "-v" not in argv else "ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            ok, message = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # report and go on
            ok, message = False, "".join(traceback.format_exception_only(exc)).strip()[:1500]
            if "-v" in argv:
                traceback.print_exc()
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, message, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
