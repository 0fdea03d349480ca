"""Historical grid, series and entity analytics as Spark DataFrame operators."""
