"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when
it can be imported. Every operator takes DataFrames and column names and returns
DataFrames; ``catalog`` holds the thin ``opN_<name>`` queries.
"""
