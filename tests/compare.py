"""Order-free comparison of a Spark result with a DuckDB result."""


def cell(x):
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return "NULL" if x != x else str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(round(x, 9) + 0.0)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return str(x.tolist() if hasattr(x, "tolist") else x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
