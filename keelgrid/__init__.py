"""Vessel-track analytics on Spark: operators from DataFrame to DataFrame."""
