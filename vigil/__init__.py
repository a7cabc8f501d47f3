"""vigil: security-log analytics as Spark jobs (DataFrames in, lazy DataFrames out)."""
