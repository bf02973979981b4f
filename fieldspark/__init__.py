"""Crop-yield and earth-observation analytics on Spark DataFrames.

Layers: ``functions`` return Columns, ``operators`` take and return DataFrames,
``plans`` hold the shuffle and skew patterns the operators share, ``sources``
read and write tables, ``streaming`` keeps results up to date incrementally.
"""
