"""Rows of a DataFrame and of DuckDB SQL in one form."""


def spark_rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect())


def duck_rows(con, sql):
    rel = con.sql(sql)
    return sorted(rel.columns), sorted(tuple(map(str, r)) for r in rel.project(",".join(f'"{c}"' for c in sorted(rel.columns))).fetchall())
