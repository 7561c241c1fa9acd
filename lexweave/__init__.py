"""Spark-native document analytics and hybrid retrieval.

Every operator is a function from DataFrames (or Columns) to DataFrames (or
Columns); nothing here collects rows to the driver unless a docstring says so
and gives the bound.
"""
