"""Listings analytics on Spark: cleaning, versioned and feature tables, regression models, run and version logs."""
