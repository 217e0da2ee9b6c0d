"""Sievework: Spark-native data preparation, profiling and text classification.

Every operator is a function from DataFrames to a DataFrame (or to a Column
that replaces one), so Catalyst sees a single declarative plan.
"""
