"""Change-data capture and reverse ETL on Spark."""
