"""Run registered queries against their DuckDB SQL:  python -m tests.compare [sf_dir] [name ...]"""

import math
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
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("0.0" if v == 0 else repr(v))
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        if hasattr(v, "asDict"):
            return plain(v.asDict())
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [names[i] for i in order]


def family(name):
    name = str(name).lower()
    for kind, words in {
        "list": ("array", "[]", "list"), "bool": ("bool",), "int": ("int", "long", "short"), "decimal": ("decimal",), "float": ("double", "float"),
        "text": ("string", "varchar"), "time": ("timestamp", "date"),
    }.items():
        if any(w in name for w in words):
            return kind
    return name


def type_notes(df, description):
    want = {d[0]: family(d[1]) for d in description}
    return {n: f"{family(t)}/{want[n]}" for n, t in df.dtypes if n in want and family(t) != want[n]}


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, got_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, want_names = rows_of(names, cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}: {got[:2]} | {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    notes = type_notes(df, cur.description)
    if notes:
        print("types differ:", notes)
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, first: {bad[0][0]} | {bad[0][1]}"
    return None


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir, argv = argv[0], argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        t = time.time()
        try:
            if name in oracles:
                err = compare(spark, con, fn, oracles[name], sf_dir)
                note = "ok" if err is None else f"DIFF {err[:1200]}"
                bad += err is not None
            else:
                note = f"rows only: {len(fn(spark, sf_dir).collect())}"
        except Exception as e:  # report and go on with the next query
            bad += 1
            note = "ERROR " + str(e)[:1200]
            if len(argv) == 1:
                traceback.print_exc()
        print(f"{name:40s} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"queries {len(queries)} oracles {len(oracles)} bad {bad}")
    missing = set(oracles) - set(queries)
    if missing:
        print("oracle without query", missing)


if __name__ == "__main__":
    main(sys.argv[1:])
