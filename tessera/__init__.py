"""Curated-evidence analytics on Spark: DataFrame operators with SQL oracles."""
