"""What several test modules share."""


def rows(df, *order):
    """All rows as tuples, sorted by the named columns or as they come."""
    found = df.orderBy(*order).collect() if order else df.collect()
    return [tuple(r) for r in found]
