"""Event (structured log) analytics as Spark DataFrame operators and streaming jobs."""
