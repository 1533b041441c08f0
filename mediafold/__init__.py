"""Media and embedding analytics on PySpark."""
