"""marketlake: market-data, factor, signal and portfolio analytics as Spark jobs."""
