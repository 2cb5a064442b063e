"""Comparing results whatever the order of rows and the engines' types."""

import math


def canonical(rows, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(float(v) + 0.0)
        return str(v).removesuffix(" 00:00:00")

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(rel.fetchall(), names)
