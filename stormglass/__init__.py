"""Early-warning indicators over panels of time series, written for Spark."""
