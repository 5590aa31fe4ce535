"""Lanternway: trajectory map matching and training-data operators on PySpark."""
