"""Decision-benchmark analytics as PySpark DataFrame operators."""
