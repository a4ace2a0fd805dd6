"""Schema-evolution analytics on PySpark."""
