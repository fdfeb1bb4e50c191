"""Runs llm queries against their DuckDB text on one data folder (also a script)."""

from __future__ import annotations

import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark " \
         "labels conversations".split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            glob = path + "/*.parquet" if os.path.isdir(path) else path
            con.execute(f"create view {t} as select * from read_parquet('{glob}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, sf_dir: str) -> tuple[list[tuple], list[tuple]]:
    from actlens.llm import queries as Q
    df = Q.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = duck(sf_dir).execute(Q.ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    return got, want


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from actlens.session import build_session
    from actlens.llm import queries as Q
    s = build_session("local[8]", 8, extra={"spark.driver.memory": "8g"})
    for q in sys.argv[2:]:
        t = time.time()
        if q in Q.ORACLES:
            g, w = compare(s, q, sys.argv[1])
            print(q, "equal" if g == w else "DIFFERENT", len(g), len(w), round(time.time() - t, 1))
            if g != w:
                print([x for x in g if x not in set(w)][:4], [x for x in w if x not in set(g)][:4], sep="\n")
        else:
            df = Q.QUERIES[q](s, sys.argv[1])
            rows = df.collect()
            print(q, len(rows), df.columns, rows[:3], round(time.time() - t, 1))
