"""Decision-data analytics on PySpark."""
