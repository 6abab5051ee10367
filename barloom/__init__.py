"""barloom: Spark-first analytics for intraday price panels."""
