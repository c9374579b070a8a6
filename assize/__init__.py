"""assize: search, statistics and data preparation for paragraph-level decisions on Apache Spark."""
