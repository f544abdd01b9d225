"""Run every query beside its SQL twin and compare rows, columns and values."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = (tuple(_plain(r[i]) for i in order) for r in rows)
    return [names[i] for i in order], sorted(plain, key=repr)


def compare(df, db, sql):
    """None when equal, else what differs."""
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    want_names, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{got_names}: {str(g)[:300]} != {str(w)[:300]}"
    if got and [type(x) for x in got[0]] != [type(x) for x in want[0]]:
        return f"types {got[0]} vs {want[0]}"[:300]
    return None
