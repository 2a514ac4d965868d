"""Tessera: image analytics and training-data operators on PySpark."""
