"""voltwarden: Spark-first analytics for the integrity of datacenter telemetry."""
