"""Evaluation analytics on Spark: DataFrame-first operators for text-reconstruction studies."""
