"""grovecast: streaming vector and time-series analytics on Spark."""
