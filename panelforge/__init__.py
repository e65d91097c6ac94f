"""Panel analytics on Spark: entity by period panels from case records and sensor readings."""
