def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)
