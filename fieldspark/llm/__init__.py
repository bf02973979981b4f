"""Training-data operators on Spark DataFrames.

Each module holds one operator with a general interface; ``queries`` applies them to
the given tables. Nothing outside this package imports it.
"""
