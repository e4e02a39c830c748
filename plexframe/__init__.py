"""plexframe: a Spark-first engine for interval, signal and sequence analytics."""
