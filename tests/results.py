"""Comparable forms of query results."""


def rows(df, *order):
    """Rows as sorted tuples, columns by name."""
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(columns).collect()))
