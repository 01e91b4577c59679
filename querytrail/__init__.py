"""DNS query telemetry, policy matching and reporting as plain Spark DataFrame functions."""
