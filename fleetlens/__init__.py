"""Fleet telemetry analytics as Spark DataFrame operators."""
