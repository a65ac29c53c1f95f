"""Compare a registered query with its DuckDB SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(frame, columns):
    def cell(v):
        if v is None or v != v:
            return (0, 0.0, "")
        if hasattr(v, "item"):
            v = v.item()
        return (1, round(float(v), 7), "") if isinstance(v, (int, float)) else (2, 0.0, str(v))

    return sorted(tuple(cell(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def assert_same(spark, con, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(rows(got, columns), rows(want, columns), strict=True):
        assert len(a) == len(b)
        for (ka, na, sa), (kb, nb, sb) in zip(a, b, strict=True):
            assert ka == kb and sa == sb and abs(na - nb) <= 2e-6 * max(1, abs(nb))
