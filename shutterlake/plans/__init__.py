"""Named queries: every plan takes (spark, directory) and returns a DataFrame."""
