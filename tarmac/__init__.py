"""Flight-delay analytics as Spark DataFrame, SQL, ML and streaming jobs."""
