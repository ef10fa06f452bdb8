"""Event-market analytics and corpus preparation on PySpark."""
