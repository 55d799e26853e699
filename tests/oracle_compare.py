"""Run a registered query and its SQL counterpart on the same tables and compare all values."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, statement: str) -> str:
    """Empty text when equal, else the first difference."""
    left_cols, left = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(statement)
    right_cols, right = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} against {right_cols}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}: {left[:2]} {right[:2]}"
    for a, b in zip(left, right):
        if repr(a) != repr(b):
            return f"{a} against {b}"
    if not left:
        return "both empty"
    return ""
