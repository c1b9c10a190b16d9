"""Small helpers of the tests."""


def rows(df, *columns):
    """Sorted plain tuples of the named columns."""
    picked = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(picked, key=lambda t: tuple((v is not None, v) for v in t))
