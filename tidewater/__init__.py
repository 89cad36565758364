"""Stream and batch analytics on PySpark."""
