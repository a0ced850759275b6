"""roadtrace: Spark jobs for vehicle and smartphone motion telemetry at fleet scale."""
