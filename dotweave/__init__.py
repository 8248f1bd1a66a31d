"""Point-cloud analytics on Spark: DataFrame operators from spot tables to a cell-by-gene table."""
