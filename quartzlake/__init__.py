"""Market-data quality and analytics on Spark: every operator is a DataFrame-to-DataFrame function."""
