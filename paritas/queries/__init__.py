"""The query catalogue: callables of (spark, directory) and their SQL twins."""
