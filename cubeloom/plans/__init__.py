"""Jobs composed of operators, and the queries that are registered with the driver."""
