"""mlode: a Spark-first engine for queries in the M formula language."""
