"""iqlake: DataFrame-first analytics for complex-baseband (I/Q) records on Spark."""
