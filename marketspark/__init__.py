"""Market-data reconciliation, point-in-time joins and panel research on Spark DataFrames."""
