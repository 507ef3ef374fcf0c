"""barlake: market-style time-series analytics on Spark."""
