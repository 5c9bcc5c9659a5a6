"""Feature stages, delay models, evaluation and search on pyspark.ml."""
