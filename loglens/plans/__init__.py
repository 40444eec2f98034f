"""Job plans: fixture views over the driver tables, the query catalogue, full jobs."""
