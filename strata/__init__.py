"""Layered (bronze / silver / gold) event analytics on PySpark DataFrames."""
