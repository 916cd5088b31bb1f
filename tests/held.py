"""Holds queries against their SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def differences(spark, query, sql: str, sf_dir: str) -> list:
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    ours = sorted(repr(tuple(r[c] for c in names)) for r in frame.collect())
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    rows = con.execute(sql)
    there = [x[0] for x in rows.description]
    assert sorted(there) == names
    theirs = sorted(repr(tuple(r[there.index(c)] for c in names)) for r in rows.fetchall())
    return [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b] or ([] if len(ours) == len(theirs) else [(len(ours), len(theirs))])
